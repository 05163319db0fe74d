"""Secret scans: regular patterns, and weak candidates that only their neighbours make credible.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they match.
Weak candidates are parts of one credential that mean nothing alone: a bare
access identifier, a bare secret of mixed characters, an endpoint. They are
linked by an interval join within a scope: every part spans ``scope`` code
points around itself, and a weak part is reported only if a part of a
complementary kind (base matches count too) lies within and is other text: parts
that overlap are no two parts, and a weak part that overlaps an endpoint is text
of that endpoint, such as the path of an address, and no part of its own.

A document gives one row for each match: the length of what stands between it
and the match before, and its own. Running sums over a document's matches place
them, and the interval join is a sweep over the places where parts begin and
end: each looks at the last end before it and the first beginning after it of
each kind of part. No pairs are formed, and time is linear in the matches.

Spans are code points, end exclusive. Everything is Catalyst expressions.

Defined cases: a null text is empty; a null id is kept; rows repeated in id and
text are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._store import documents, materialise, text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs: what the shorter forms ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+`` match and their least lengths keep.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")

WEAK_ACCESS = r"(?<![A-Za-z0-9])(?:A3T[A-Z0-9]|ABIA|ACCA|AGPA|AIDA|AKIA|AROA|ASIA)[A-Z0-9]{8,}(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])(?=[0-9A-Z+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>]{4,}"
#: The role of each kind in a credential.
ROLES = {"assign": "secret", "access": "access", "hex": "secret", "weak_access": "access", "weak_secret": "secret", "endpoint": "endpoint"}


SPANS = "array<struct<start:int,kind:int,end:int>>"


def pieces(text: Column, pattern: str, least: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<gap, long, ok>>`` of a pattern's leftmost matches, in order: what precedes each, its length, and whether it passes ``least``."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("p"))
    measured = F.transform(both, lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("long"), (least(x["m"]) if least else F.lit(True)).alias("ok")))
    return F.when(F.rlike(text, F.lit(pattern)), measured).otherwise(F.array().cast("array<struct<gap:int,long:int,ok:boolean>>"))


def _long_enough(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 12


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak_access": WEAK_ACCESS, "weak_secret": WEAK_SECRET, "endpoint": ENDPOINT}


def scan(docs: DataFrame, scope: int = 240) -> DataFrame:
    """``doc_id, base, all``: arrays of ``(start, kind, end)``, sorted; ``kind`` indexes ``KINDS``."""
    text = F.col("text")
    found = [pieces(text, PATTERNS[k], _long_enough if k == "assign" else None).alias(k) for k in KINDS]
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("row"), *found)
    rows = materialise(rows, "secret-matches")
    parts = placed(rows)
    linked = link(parts, scope)
    spans = parts.filter("kind < 3").unionByName(linked).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("every"))
    spans = spans.withColumnsRenamed({"doc_id": "l_id", "row": "l_row"})
    both = rows.select("doc_id", "row").join(spans, [rows["doc_id"].eqNullSafe(spans["l_id"]), rows["row"] == spans["l_row"]], "left")
    every = F.coalesce("every", F.array().cast(SPANS))
    return both.select("doc_id", F.filter(every, lambda x: x["kind"] < 3).alias("base"), every.alias("all"))


def placed(rows: DataFrame) -> DataFrame:
    """``doc_id, row, start, kind, end`` of the matches that count, once for rows of equal id and text."""
    some = rows.filter(" OR ".join(f"size({k}) > 0" for k in KINDS)).dropDuplicates(["doc_id", "row"])
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(k).alias("own")) for n, k in enumerate(KINDS))))
    each = some.select("doc_id", "row", every.alias("k")).select("doc_id", "row", F.col("k.kind").alias("kind"), F.posexplode("k.own").alias("nth", "p"))
    so_far = Window.partitionBy("doc_id", "row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the documents' order of columns is that of the windows below, which then need no exchange
    dealt = each.repartition("doc_id", "row").select("doc_id", "row", "kind", "nth", "p.gap", "p.long", "p.ok")
    ends = dealt.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(so_far).cast("int")).filter("ok")
    return ends.select("doc_id", "row", (F.col("end") - F.col("long")).alias("start"), "kind", "end")


def link(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts that have a complementary part, of other text, within ``scope``."""
    role = F.element_at(F.array(*[F.lit(("access", "secret", "endpoint").index(ROLES[k])) for k in KINDS]), F.col("kind") + 1)
    endpoint = KINDS.index("endpoint")
    own = Window.partitionBy("doc_id", "row")
    # endpoints do not overlap each other, so the last one that began ends last, and the next one begins first
    before = own.orderBy("start", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = own.orderBy(F.col("start").desc(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    address = F.col("kind") == endpoint
    swept = parts.withColumns({"within": F.max(F.when(address, F.col("end"))).over(before), "next": F.min(F.when(address, F.col("start"))).over(after)})
    inside = F.col("kind").isin(3, 4) & ((F.coalesce("within", F.lit(0)) > F.col("start")) | (F.coalesce("next", F.col("end")) < F.col("end")))
    alone = swept.filter(~inside).select("doc_id", "row", "start", "kind", "end", role.alias("role"))
    # two events for each part; at one place ends come before beginnings
    event = F.explode(F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("begins")), F.struct(F.col("start").alias("at"), F.lit(1).alias("begins"))))
    events = alone.select("*", event.alias("e")).select("doc_id", "row", "start", "kind", "end", "role", "e.at", "e.begins")
    left = own.orderBy("at", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = own.orderBy(F.col("at").desc(), F.col("begins").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = {}
    for r in range(3):
        sides[f"left{r}"] = F.max(F.when((F.col("begins") == 0) & (F.col("role") == r), F.col("at"))).over(left)
        sides[f"right{r}"] = F.min(F.when((F.col("begins") == 1) & (F.col("role") == r), F.col("at"))).over(right)
    near = F.lit(False)
    for r in range(3):
        gap = F.when(F.col("begins") == 1, F.col("at") - F.col(f"left{r}")).otherwise(F.col(f"right{r}") - F.col("at"))
        near = near | ((F.col("role") != r) & F.coalesce(gap <= scope, F.lit(False)))
    weak = events.withColumns(sides).filter((F.col("kind") >= 3) & near)
    return weak.groupBy("doc_id", "row", "start", "kind", "end").agg(F.count(F.lit(1)).alias("sides")).drop("sides")


def _joined(column: str) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return scan(documents(spark, sf_dir)).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"),
    )
