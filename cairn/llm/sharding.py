"""Sharding by histogram sort: probe, count exactly, refine, exchange once.

Documents are ordered by ``(hash of the text, doc_id)``, so that equal texts
lie side by side and a large group of them can still be cut between two ids.
Each round sums, over all partitions, the bytes below a few candidate
boundaries for every open splitter; a splitter closes once the bytes below it
are within tolerance of its share, or no key is left between its brackets.
Only then do the documents move, once, each to its shard.

A shard of more than ``part_bytes`` has inner splitters, found in the same
rounds (at most ``most_parts`` of them all): its parts are sorted by a task
each, and a part's slots begin behind those of the parts before it.

Law ``bytes``: a document's size is its UTF-8 bytes plus one.

Defined cases: a null text is empty; a null id sorts lowest; rows equal in id
and text stay together; an empty table gives an empty result; other columns
are carried along, whatever their names, but for those named like an output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._store import documents, fresh_names, materialise, text_of

LOW = -(2**63)
SPAN = 2**64
Key = tuple[int, int]


def _number(key: Key) -> int:
    return (key[0] - LOW) * SPAN + key[1] - LOW


def _key(number: int) -> Key:
    return number // SPAN + LOW, number % SPAN + LOW


def place(bounds: list[Key], key_hash: str = "key_hash", key_id: str = "key_id") -> Column:
    """How many of the sorted bounds lie below the row's key: two short scans instead of a long one."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda keys: "array(" + ",".join(f"named_struct('h', {_long(h)}, 'i', {_long(i)})" for h, i in keys) + ")"
    below = lambda keys: f"size(filter({keys}, b -> b < named_struct('h', {key_hash}, 'i', {key_id})))"
    coarse = below(array([g[-1] for g in groups]))
    fine = below(f"try_element_at(array({','.join(map(array, groups))}), {coarse} + 1)")
    return F.expr(f"least({coarse} * {step}, {len(bounds)}) + if({coarse} < {len(groups)}, {fine}, 0)")


def _long(value: int) -> str:
    return f"{value}L" if value > LOW else f"({value + 1}L - 1L)"


@dataclass
class Bracket:
    """The splitter lies at or above ``low`` (bytes there: ``under``) and at or below ``high`` (``upto``)."""

    target: float
    low: int
    under: int
    high: int
    upto: int
    found: int | None = None

    def probes(self) -> list[int]:
        width = self.high - self.low
        share = (self.target - self.under) / max(1, self.upto - self.under)
        at = self.low + int(width * min(1.0, max(0.0, share)))
        return sorted({min(self.high, max(self.low, p)) for p in (at - width // 64, at, at + width // 64, self.low + width // 2)})

    def learn(self, probe: int, seen: int, slack: float) -> None:
        """``seen`` bytes have keys at or below ``probe``."""
        if abs(seen - self.target) <= slack and self.found is None:
            self.found = probe
        if seen <= self.target and probe >= self.low:
            self.low, self.under = probe, seen
        elif seen > self.target and probe <= self.high:
            self.high, self.upto = probe, seen

    def tighten(self, cells: list[tuple[int, int]]) -> None:
        """To the outermost keys seen above ``low``, up to ``high``; with one key left there is nothing to refine."""
        inside = [(max(lo, self.low + 1), min(hi, self.high)) for lo, hi in cells if lo <= self.high and hi > self.low]
        if not inside:
            self.found = self.low if self.found is None else self.found
            return
        first, last = min(lo for lo, _ in inside), max(hi for _, hi in inside)
        self.low, self.high = max(self.low, first - 1), last
        if first == last and self.found is None:
            self.found = self.low if self.target - self.under <= self.upto - self.target else self.high


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.0005) -> list[Key]:
    """Upper keys of all parts but the last, for ``keys(key_hash, key_id, size)``.

    ``tolerance`` is in shares of an even part. What the driver holds is four
    probes for each splitter, whatever the input.
    """
    pair = F.struct("key_hash", "key_id")
    total, least, most = keys.agg(F.sum("size"), F.min(pair), F.max(pair)).first()
    if not total:
        return []
    slack = tolerance * total / shards
    first, last = _number(tuple(least)) - 1, _number(tuple(most))
    open_: list[Bracket] = [Bracket(total * t / shards, first, 0, last, total) for t in range(1, shards)]
    brackets = list(open_)
    while open_:
        asked = sorted({p for b in open_ for p in b.probes()})
        cells = keys.groupBy(place([_key(p) for p in asked]).alias("cell")).agg(F.sum("size").alias("bytes"), F.min(pair).alias("least"), F.max(pair).alias("most"))
        held = {r["cell"]: r for r in cells.collect()}  # a row for each cell between probes
        seen, ends = 0, []
        for cell, probe in enumerate([*asked, None]):
            if cell in held:
                seen += held[cell]["bytes"]
                ends.append((_number(tuple(held[cell]["least"])), _number(tuple(held[cell]["most"]))))
            else:
                ends.append(None)
            if probe is not None:
                for b in open_:
                    b.learn(probe, seen, slack)
        for b in open_:
            b.tighten([e for e in ends if e])
        open_ = [b for b in open_ if b.found is None]
    return [_key(b.found) for b in brackets]


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.0005, part_bytes: int = 64 << 20, most_parts: int = 1024) -> DataFrame:
    """``docs`` with ``size, law, shard, slot``; each partition is sorted, and those of a shard follow one another."""
    text = text_of()
    carried = docs.drop("size", "law", "shard", "slot")
    key_hash, key_id, part = fresh_names(docs, "key_hash", "key_id", "part")
    keyed = carried.withColumns({key_hash: F.xxhash64(text), key_id: F.coalesce("doc_id", F.lit(LOW)), "size": F.octet_length(text).cast("long") + 1})
    keys = materialise(keyed.select(F.col(key_hash).alias("key_hash"), F.col(key_id).alias("key_id"), "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    inner = max(1, min(most_parts // shards, -(-total // (shards * part_bytes))))
    cuts = splitters(keys, shards * inner, tolerance)
    held = {r["part"]: r["n"] for r in keys.groupBy(place(cuts).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
    before = [sum(held.get(q, 0) for q in range(p - p % inner, p)) for p in range(shards * inner)]
    dealt = keyed.withColumn(part, place(cuts, f"`{key_hash}`", f"`{key_id}`").cast("int")).repartitionById(shards * inner, F.col(part))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(key_hash, key_id)).cast("long") - 1
    base = F.element_at(F.array(*map(F.lit, before)), F.col(part) + 1)
    return dealt.withColumns({"slot": nth + base, "shard": (F.col(part) / inner).cast("int"), "law": F.lit("bytes")}).drop(key_hash, key_id, part)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", F.crc32(text_of().cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
