"""Filter interaction audit: what five filters do alone, together and in every order.

A document's failures are five flags. One pass sums, for each part of the
corpus, the products of the flags of all 32 intersections of filters (the empty
product counts all documents): joint-failure counts ``n(S)``, of all documents,
of good and of toxic ones. Whatever the orders ask follows from these 96 numbers
by inclusion-exclusion, never from the documents again:

* documents that pass every filter of ``S``: the sum of ``(-1)^|T| n(T)`` over
  the subsets ``T`` of ``S``;
* documents that fail exactly ``S`` (Möbius inversion): the sum of
  ``(-1)^(|T| - |S|) n(T)`` over its supersets ``T``;
* the game ``v(S)``, documents that ``S`` removes, has the Harsanyi dividends
  ``(-1)^(|S| + 1) n(S)``; a filter's Shapley value is the sum of its sets'
  dividends, each divided by the set's size. Times 120 it is a whole number,
  which is what it removes, summed over all orders.

Failing: ``A`` under 200 words; ``B`` distinct words under half of the words;
``C`` ``[A-Z]`` over a fiftieth of the code points; ``D`` any of ``#$%&*|``;
``E`` a smaller id has the same text. Texts leave their documents as two 64-bit
hashes; a text's least id is an aggregate with partial sums, and texts that very
many documents share get it by broadcast (``spread_join``).

Everything is Catalyst expressions. Defined cases: a null text is empty, a null
source the part ``''``; a null id is smaller than none and has no smaller one,
and no labels; of rows that share id and text none makes another fail; a
document is good (toxic) if any of its labels says so; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._store import documents, materialise, spread_join, text_of

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
GROUPS = ("all", "good", "toxic")
SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """The failures that a text alone decides."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text).cast("long"),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, A, B, C, D, E`` of every document, flags as booleans."""
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flagged = rows.select("doc_id", "part", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("hash"), *(flag.alias(name) for name, flag in text_flags(F.col("text")).items()))
    flagged = materialise(flagged, "failures")
    # only texts of several documents can have a smaller id
    firsts = flagged.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    placed = spread_join(flagged, materialise(firsts, "first-ids"), "hash", "copies", "left")
    return placed.select("doc_id", "part", *FILTERS[:-1], F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, false where no label says so; rows without an id are not exchanged."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = said.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    no = F.lit(False)
    named = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    return named.unionByName(rows.filter("doc_id IS NULL").withColumns({"good": no, "toxic": no}))


def joint_failures(rows: DataFrame) -> DataFrame:
    """``part, all, good, toxic``: for each group the 32 sums of products of flags, by the set's bits (``A`` is bit 0)."""
    flag = {name: F.col(name).cast("long") for name in FILTERS}
    weight = {"all": F.lit(1).cast("long"), "good": F.col("good").cast("long"), "toxic": F.col("toxic").cast("long")}

    def product(group: str, s: int) -> Column:
        out = weight[group]
        for bit, name in enumerate(FILTERS):
            out = out * flag[name] if s >> bit & 1 else out
        return out

    sums = rows.groupBy("part").agg(*(F.sum(product(g, s)).alias(f"{g}{s}") for g in GROUPS for s in SETS))
    return sums.select("part", *(F.array(*(F.col(f"{g}{s}") for s in SETS)).alias(g) for g in GROUPS))


def _signed(counts: str, within: Callable[[Column], Column], weight: Callable[[Column], Column]) -> Column:
    """Sum of ``weight(|t|)`` times the counts of the sets ``t`` for which ``within`` holds, even sets positive and odd ones negative."""

    def add(total: Column, t: Column) -> Column:
        size = F.bit_count(t)
        n = F.get(counts, t) * weight(size)
        return total + F.when(~within(t), 0).when(size % 2 == 0, n).otherwise(-n)

    return F.aggregate(_all_sets(), F.lit(0).cast("long"), add)


def _all_sets() -> Column:
    return F.sequence(F.lit(0), F.lit(len(SETS) - 1))


def inverted(joint: DataFrame) -> DataFrame:
    """``part, all, pass_all, pass_good, pass_toxic, alone, shapley``: survivors by set of filters, unique failures and 120 Shapley values by filter."""
    passing = lambda g: F.transform(_all_sets(), lambda s: _signed(g, lambda t: t.bitwiseAND(F.bitwise_not(s)) == 0, lambda size: F.lit(1)))
    singles = F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda bit: F.call_function("shiftleft", F.lit(1), bit))
    holding = lambda weight: F.transform(singles, lambda s: -_signed("all", lambda t: t.bitwiseAND(s) != 0, weight))
    alone, shapley = holding(lambda size: F.lit(1)), holding(lambda size: F.call_function("div", F.lit(120), F.greatest(size, F.lit(1))))
    return joint.select("part", "all", *(passing(g).alias(f"pass_{g}") for g in GROUPS), alone.alias("alone"), shapley.alias("shapley"))


def every_step() -> list[tuple[str, int, int, int, int]]:
    """``(order, step, filter, set before, set after)`` of all 120 orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[k] for k in order), step, f, before, before | 1 << f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step, with the counts named in the module's text."""
    found = inverted(joint_failures(labelled(failures(docs), labels)))
    steps = F.expr(f"array({', '.join(map(str, every_step()))})")
    rows = found.select("*", F.inline(steps).alias("order", "step", "filter", "before", "after"))
    lost = lambda g: F.get(f"pass_{g}", F.col("before")) - F.get(f"pass_{g}", F.col("after"))
    failing = F.get("all", F.expr("shiftleft(1, filter)"))
    return rows.select(
        "part", F.col("order").alias("filter_order"), "step",
        F.get("pass_all", F.col("after")).alias("kept"), lost("all").alias("removed"), (failing - lost("all")).alias("redundant"),
        F.get("alone", F.col("filter")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("filter")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Simulates every order on the counts of each exact set of failures; shares no step with the plan above.
OP11_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), first AS (
  SELECT text, min(doc_id) AS first FROM doc GROUP BY text
), label AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END) AS fails
  FROM doc JOIN first USING (text) LEFT JOIN label USING (doc_id)
), exact AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM flagged GROUP BY part, fails
), grow(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || f FROM grow, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f)
  WHERE length(filter_order) < 5 AND NOT contains(filter_order, f)
), steps AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM grow, unnest([1, 2, 3, 4, 5]) AS u(step) WHERE length(filter_order) = 5
), hit AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, fails, contains(fails, f) AS here,
         before <> '' AND fails <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '_' ELSE before END || ']') AS earlier
  FROM exact, steps
), counted AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT here AND NOT earlier), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE here AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE here AND earlier), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (WHERE here AND NOT earlier), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (WHERE here AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
