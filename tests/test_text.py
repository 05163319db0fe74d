from pyspark.sql import functions as F

from cairn.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_normalize(spark):
    assert one(spark, T.normalize("t"), t=" a\t\tb\r\nc\rd\n\n\n\n e　") == "a b\nc\nd\n\n e"


def test_headings_and_sections(spark):
    text = "intro\n# One\nbody\n### Deep  \nx\n## Two\n\n####### no\n"
    assert one(spark, T.headings("t"), t=text) == ["One", "Deep", "Two"]
    found = one(spark, T.sections("t", F.lit("Doc")), t=text)
    assert [(s.title, s.level, s.path, s.text) for s in found] == [
        ("Doc", 1, ["Doc"], "intro"), ("One", 1, ["Doc", "One"], "# One\nbody"), ("Deep", 3, ["Doc", "One", "Deep"], "### Deep\nx"), ("Two", 2, ["Doc", "One", "Two"], "## Two\n\n####### no"),
    ]
    assert one(spark, T.sections("t", F.lit("Doc")), t=" \n ") == []
    assert [s.text for s in one(spark, T.sections("t", F.lit("Doc")), t="a \nb\n")] == ["a\nb"]


def test_metadata(spark):
    text = "owner: Ann\n部门：研发\n2024/3/5 then 2023-1-2, Version 2.0"
    row = one(spark, T.document_metadata(F.lit("kb/Leave_Policy-v2 2024 final.md"), F.lit(""), "t", F.lit(None).cast("string")), t=text)
    assert (row.kb_id, row.doc_type, row.effective_date, row.version, row.owner, row.department) == ("default", "policy", "2023-1-2", "Version 2.0", "Ann", "研发")
    assert one(spark, T.source_key(F.lit("a/b.txt"), "t"), t="Report v1.2 2023 final.pdf") == "report"


def test_dates(spark):
    cases = {"2024年3月5日": "2024-03-05", "2024/3/5": "2024-03-05", "2024-13-01": None, "x": None, "": None}
    for raw, want in cases.items():
        got = one(spark, T.parse_date("t"), t=raw)
        assert (str(got) if got else None) == want
    assert one(spark, T.parse_rank_date("t"), t="2024年3月5日") is None
    assert str(one(spark, T.parse_rank_date("t"), t=" 2024/3/5 ")) == "2024-03-05"


def test_versions(spark):
    assert one(spark, T.normalize_version("t"), t=" Version：2.0 ") == "2.0"
    assert one(spark, T.normalize_version("t"), t="版本") is None
    assert one(spark, T.version_key("t"), t="v1.12-b3") == [1, 12, 3]


def test_previews(spark):
    assert one(spark, T.preview("t", 10), t="abc  def\nghij") == "abc def..."
    assert one(spark, T.page_preview("t", 10), t=" \n") == "No summary available."
    assert one(spark, T.summary("t"), t="# Head\n\nshort\n\n" + "a long enough paragraph " * 2) == ("a long enough paragraph " * 2).strip()


def test_previews_of_long_white_space(spark):
    """White space of every kind is one blank, at the ends none; a preview reads on where the beginning is mostly white."""
    kinds = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    assert one(spark, T.strip("t"), t=f"{kinds}a{kinds}b\x1c\u200b{kinds}") == f"a{kinds}b\x1c\u200b"
    assert one(spark, T.collapse("t"), t="".join(f"{k}a {k}b" for k in kinds) + kinds) == " ".join("ab" * len(kinds)).replace("a b", "a b")
    assert one(spark, T.preview("t", 10), t=" " * 500 + "abc" + "\n" * 500 + "defghijk" + " " * 90) == "abc def..."
    assert one(spark, T.preview("t", 10), t="abc" + " " * 500) == "abc"
    assert one(spark, T.summary("t", 30), t="\n\n".join(["short", " # not this heading, long as it is", "x" * 19, "\u3000y y" + " y" * 300, "never read here at all"])) == "y y" + " y" * 12 + "..."


def test_counted_sections(spark):
    for text in ("", " \n", "a", "# A\nb\n# C", "a\n# A", "\n\n# A\n\n## B\nx", "\u3000# A", "a # b", "#A"):
        assert one(spark, T.section_count("t"), t=text) == len(one(spark, T.sections("t", F.lit("T")), t=text)), text


def test_fields_of_every_form_are_found(spark):
    said = {
        T.effective_date: ("on 1999-1-2.", "2024/12/31", "x2020年1月2日"),
        T.version: ("V2", "a v1.2.3 b", "VERSION  3", "version\t4", "版本a", "版本：7"),
        T.owner: ("OWNER: a", "owner：a", "负责人:a", "维护人：a", "维护团队: a"),
        T.department: ("Department: a", "DEPARTMENT：a", "部门:a", "所属部门：a"),
    }
    for field, texts in said.items():
        for text in texts:
            assert one(spark, field("t"), t=f"some words, {text}"), text
        for text in ("", "vv2x", "a: b", "1998", "verse 1", "owner", "12-12-12", None):
            assert one(spark, field("t"), t=text) is None, text


def test_metadata_makes_no_sections(spark):
    """Their number is counted without their texts."""
    meta = T.document_metadata(F.lit("a.txt"), F.lit("A"), F.col("t"), F.lit("kb"))
    row = one(spark, meta, t="before\n# A\nowner: me\n## B")
    assert row.section_count == 3 and row.headings == ["A", "B"] and row.owner == "me"
    plan = spark.createDataFrame([("x",)], "t string").select(meta)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_eval_normalize(spark):
    assert one(spark, T.eval_normalize("t"), t=" **Ten days** a year [doc:3]。 ") == "Tendaysayear"
    assert one(spark, T.eval_normalize("t"), t=None) == ""


def test_safe_float(spark):
    for raw, want in {"1.5": 1.5, "nan": 0.0, "x": 0.0, None: 0.0}.items():
        assert one(spark, T.safe_float("t"), t=raw) == want


def test_tokens(spark):
    assert one(spark, T.bm25_tokens("t"), t="Hello, a 1 22 休假x y_z!") == ["hello", "a", "22", "x", "y_z", "休", "假", "休假"]
    assert one(spark, T.token_estimate("t"), t="休假abcde") == 3
    assert one(spark, T.sentences("t"), t="A b. C!D 。 ") == ["A b.", "C!", "D 。"]
    assert sorted(one(spark, T.query_terms("t"), t="Go to 年假政策 x")) == sorted(["go", "to", "年假", "假政", "政策", "年假政", "假政策", "年假政策"])


def test_ids(spark):
    assert one(spark, T.doc_id(F.lit("kb"), "t"), t="a/b").startswith("doc-") and len(one(spark, T.doc_id(F.lit("kb"), "t"), t="a/b")) == 28
    assert one(spark, T.topic_slug(F.lit("k b"), "t"), t="Leave Policy!") == "k-b--leave-policy"
    assert one(spark, T.topic_slug(F.lit("kb"), "t"), t="休假") == "kb--topic"
    assert [one(spark, T.scope_id("t"), t=x) for x in ("-a b-", "!!", "", None)] == ["a-b", "default", "default", "default"]
    assert [one(spark, T.parse_bool("t"), t=x) for x in (" Yes ", "on", "0", "", None)] == [True, True, False, False, False]
    assert one(spark, T.json_text("t"), t='a"b') == '"a\\"b"' and one(spark, T.json_text(F.lit(None).cast("int")), t="") == "null"
    assert one(spark, T.modality("t"), t="x/Y.PNG") == "image"
    assert one(spark, T.mime_type("t"), t="a.mov") == "video/quicktime"


def test_source_keys_with_years_kept(spark):
    rows = spark.createDataFrame([("src0/1.txt", "Document 1999"), ("src0/2.txt", "Document v2 final")], "path string, title string")
    assert [r[0] for r in rows.select(T.source_key("path", "title", None)).collect()] == ["document 1999", "document v2 final"]
    assert [r[0] for r in rows.select(T.source_key("path", "title")).collect()] == ["document", "document"]
