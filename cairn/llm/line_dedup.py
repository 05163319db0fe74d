"""Line dedup: drop lines that recur in many documents, all but the last document's.

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased. Keys of ``least_chars`` code points or more that at least
``least_docs`` documents hold lose their lines in all of them but the one with
the largest id.

Only 128-bit hashes leave a document. A row for each line, ``(hash, document,
position)``, is range-partitioned by hash with a secondary sort by document,
last first, and position. One pass over a partition streams each key's
documents: the first occurrence is in the keeper, and the verdict on every
later one comes from the stream itself. What returns to a document is a bitmap
of lines to drop, in 64-bit words of which only those with a bit set exist;
texts are never exchanged for the search.

A key that a third of all lines have is one group of that stream, so hot keys
(a frequent-items sketch finds those with over a ten-thousandth of all lines)
leave it: their distinct documents and keepers are aggregated with partial sums
in every task, and the at most 10,000 verdicts are broadcast to the lines.

Defined cases: a null or empty text is one empty line; a null id is held as the
lowest; rows that share an id count as one document (its lines are then judged
row by row, equal rows alike); an empty table stays empty; other columns are
carried along, whatever their names, but for ``n_lines`` and ``n_dropped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._store import HOT_KEYS, documents, fresh_names, hot_limit, materialise, text_of

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)))


def _hashed(text: Column, least_chars: int) -> Column:
    """``(a, b, at)`` of each line long enough: two 64-bit hashes of its key, its position."""
    at = F.transform(line_keys(text), lambda k, i: F.when(F.length(k) >= least_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"), i.alias("at"))))
    return F.array_compact(at)


def hot_keys(lines: DataFrame) -> DataFrame:
    """``a`` of the keys with over a ten-thousandth of all lines; the sketch's errors only move a key between two ways to one result."""
    each = lines.select(F.explode("own.a").alias("a"))
    found, rows = each.agg(F.expr(f"approx_top_k(a, {HOT_KEYS}, {10 * HOT_KEYS})"), F.count(F.lit(1))).first()
    return lines.sparkSession.createDataFrame([(r["item"],) for r in found or [] if r["count"] > hot_limit(rows)], "a long")


def streamed(lines: DataFrame, least_docs: int) -> DataFrame:
    """``id, row, at`` of lines to drop, from the range-partitioned stream of ``lines(id, row, a, b, at)``."""
    ranged = lines.repartitionByRange("a", "b").sortWithinPartitions("a", "b", F.col("id").desc(), "at")
    key = Window.partitionBy("a", "b")
    by_doc = key.orderBy(F.col("id").desc())
    walked = ranged.withColumns({"nth": F.dense_rank().over(by_doc), "keeper": F.first("id").over(by_doc)})
    judged = walked.withColumn("docs", F.max("nth").over(key))
    return judged.filter((F.col("docs") >= least_docs) & (F.col("id") < F.col("keeper"))).select("id", "row", "at")


def drop_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``id, row, words array<struct<word, bits>>, n_dropped`` for each document that loses lines; ``row`` tells rows of one id apart by text.

    Bit ``i % 64`` of word ``i / 64`` is set where line ``i`` goes.
    """
    lines = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), text_of().alias("text")).select("id", F.xxhash64("text").alias("row"), _hashed(F.col("text"), least_chars).alias("own"))
    lines = materialise(lines.filter(F.size("own") > 0), "line-hashes")
    each = lines.select("id", "row", F.explode("own").alias("k")).select("id", "row", F.col("k.a").alias("a"), F.col("k.b").alias("b"), F.col("k.at").alias("at"))
    hot = F.broadcast(hot_keys(lines))
    gone = streamed(each.join(hot, "a", "left_anti"), least_docs)
    crowded = each.join(hot, "a", "left_semi")
    verdicts = crowded.groupBy("a", "b").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keeper")).filter(F.col("docs") >= least_docs)
    gone = gone.unionByName(crowded.join(F.broadcast(verdicts), ["a", "b"]).filter(F.col("id") < F.col("keeper")).select("id", "row", "at"))
    words = gone.groupBy("id", "row", (F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
    return words.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` thinned, and ``n_lines`` (before) and ``n_dropped``."""
    carried = docs.drop("n_lines", "n_dropped")
    id_, row, words, gone, lines, dense = fresh_names(docs, "id", "row", "words", "gone", "lines", "dense")
    own = carried.withColumns({id_: F.coalesce("doc_id", F.lit(-(2**63))), row: F.xxhash64(text_of())})
    maps = drop_bitmaps(docs, least_chars, least_docs).select(F.col("id").alias(id_), F.col("row").alias(row), F.col("words").alias(words), F.col("n_dropped").alias(gone))
    both = own.join(maps.hint("shuffle_hash"), [id_, row], "left")
    bits = F.map_from_entries(words)
    every_word = F.transform(F.sequence(F.lit(0), F.element_at(words, -1)["word"]), lambda w: F.coalesce(F.try_element_at(bits, w), F.lit(0).cast("long")))
    marked = both.withColumns({lines: F.split(text_of(), "\n", -1), dense: F.when(F.col(words).isNotNull(), every_word)})
    word = lambda i: F.coalesce(F.try_element_at(F.col(dense), (i / 64).cast("int") + 1), F.lit(0).cast("long"))
    kept = F.filter(lines, lambda x, i: F.call_function("getbit", word(i), i % 64) == 0)
    thinned = {"text": F.when(F.col(words).isNull(), text_of()).otherwise(F.array_join(kept, "\n")), "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(gone, F.lit(0).cast("long"))}
    return marked.withColumns(thinned).drop(id_, row, words, gone, lines, dense)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    thinned = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return thinned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH line AS (
  SELECT d.doc_id, i AS pos, s[i] AS line,
         translate(regexp_replace(s[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d, unnest(range(1, len(s) + 1)) AS u(i)
), often AS (
  SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT line.*, keeper IS NOT NULL AND doc_id < keeper AS gone FROM line LEFT JOIN often USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
