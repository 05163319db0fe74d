"""SQL functions against the builders of the same columns."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import sql
from cairn.functions import text as T
from cairn.operators import chunking, filters

TEXTS = ["", None, " one\r\n\r\n\r\n\r\ntwo \t x. Three! 四五六。 v 1.2", "a" * 1900, "word " * 400, "规定 and ABC_9 x 7", "2024-1-5", "2024/13/40", "2024年3月9日 noon", "Version: 2.1 ", "版本：3", " wide ", "x\n"]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").createOrReplaceTempView("cairn_texts")
    return spark.table("cairn_texts")


def same(one, two):
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_scalars(spark, rows):
    mine = spark.sql("SELECT id, cairn_normalize(text) a, cairn_preview(text, 40) b, cairn_doc_id('kb', text) c, cairn_version(text) d, cairn_to_day(text) e, cairn_tokens(text) f FROM cairn_texts")
    same(mine, rows.select("id", T.normalize("text").alias("a"), T.preview("text", 40).alias("b"), T.doc_id(F.lit("kb"), F.col("text")).alias("c"), T.normalize_version("text").alias("d"), T.parse_date("text").alias("e"), T.bm25_tokens("text").alias("f")))


def test_table_functions(spark, rows):
    mine = spark.sql("SELECT id, c.* FROM cairn_texts, LATERAL cairn_chunk_fixed(text, 800, 120) AS c")
    same(mine, rows.select("id", F.posexplode(chunking.fixed_windows("text", 800, 120)).alias("chunk_index", "chunk")))
    same(spark.sql("SELECT id, s.* FROM cairn_texts, LATERAL cairn_sentences(text) AS s"), rows.select("id", F.posexplode(T.sentences("text")).alias("nth", "sentence")))
    same(spark.sql("SELECT id, s.* FROM cairn_texts, LATERAL cairn_terms(text) AS s"), rows.select("id", F.posexplode(T.bm25_tokens("text")).alias("nth", "term")))
    assert spark.sql("SELECT count(*) FROM cairn_texts, LATERAL cairn_lines(text)").first()[0] == sum((t or "").count("\n") + 1 for t in TEXTS if t is not None)
    with pytest.raises(Exception, match="greater than overlap"):
        spark.sql("SELECT * FROM cairn_chunk_fixed('some text', 5, 5)").collect()


def test_filters(spark, rows):
    held = "doc_type string, version string, effective_date string"
    chunks = [("Policy", "v1", "2024-01-01"), (None, "version: v1", "2024/6/1"), ("", None, None), ("manual", "v2", "2024年3月9日")]
    wanted = [(None, None, None, None, None), (["policy"], None, None, None, False), (["policy"], None, None, None, True), ([], "V1", None, None, None), (["manual", "x"], "", "2024-02-01", None, None), (None, None, "2024-01-01", "2024-05-01", True)]
    pairs = [(*c, *w) for c in chunks for w in wanted]
    table = spark.createDataFrame(pairs, f"{held}, doc_types array<string>, w string, a string, b string, soft boolean")
    table.createOrReplaceTempView("cairn_pairs")
    mine = spark.sql("SELECT doc_type, version, effective_date, doc_types, w, a, b, soft, cairn_matches(doc_type, version, effective_date, doc_types, w, a, b, soft) AS ok FROM cairn_pairs")
    given = F.struct("doc_types", F.col("w").alias("version"), F.col("a").alias("date_from"), F.col("b").alias("date_to"), "soft")
    same(mine, table.withColumn("ok", filters.matches(given, F.col("doc_type"), F.col("version"), F.col("effective_date"))))


def test_functions_of_a_database(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS cairn_sql_test")
    names = sql.register(spark, "", "cairn_sql_test")
    assert "cairn_sql_test.preview" in names
    assert spark.sql("SELECT cairn_sql_test.preview('a  b', 9)").first()[0] == "a b"
    spark.sql("DROP DATABASE cairn_sql_test CASCADE")
