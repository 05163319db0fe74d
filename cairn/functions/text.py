"""Scalar text functions as Column builders: normalising, document metadata, dates, versions, previews.

Python's ``strip`` and ``\\s`` mean Unicode white space, hence ``(?U)`` in the
patterns here, and the characters given to ``trim``, which alone drops spaces only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = r"一-鿿㐀-䶿豈-﫿"
#: Unicode white space.
SPACE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Markers of document types, in order of precedence.
DOC_TYPES = {
    "faq": ("faq", "q&a", "常见问题", "问答"),
    "policy": ("policy", "政策", "制度", "办法", "规范"),
    "handbook": ("handbook", "手册", "员工手册"),
    "guide": ("guide", "guideline", "指南", "指引"),
    "procedure": ("procedure", "流程", "操作步骤", "操作规程"),
    "contract": ("contract", "agreement", "合同", "协议"),
    "form": ("form", "template", "表单", "模板"),
}

# Patterns of dates, versions and fields, in order of precedence.
DATES = (
    r"((?:19|20)\d{2}-\d{1,2}-\d{1,2})",
    r"((?:19|20)\d{2}/\d{1,2}/\d{1,2})",
    r"((?:19|20)\d{2}年\d{1,2}月\d{1,2}日)",
)
VERSIONS = (
    r"(?i)\b(v\d+(?:\.\d+)*)\b",
    r"(?i)\b(version\s+\d+(?:\.\d+)*)\b",
    r"(版本[:：]?\s*[A-Za-z0-9._-]+)",
)
OWNERS = (r"(?i)(?:owner|负责人)[:：]\s*([^\n]+)", r"(?:维护人|维护团队)[:：]\s*([^\n]+)")
DEPARTMENTS = (r"(?i)(?:department|部门)[:：]\s*([^\n]+)", r"(?:所属部门)[:：]\s*([^\n]+)")
# Fixed value: what a text has that any of these patterns finds; looked for in one pass, of a class that most characters are not in.
TOLD = r"[12vV:](?:(?<=[12])[09]\d\d[-/年]\d|(?<=[vV])(?:\d|[eE][rR][sS][iI][oO][nN]\s+\d)|(?<=[rRtT人队门]:))"
TOLD_WIDE = ("：", "版本")
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
KEY_NOISE = r"(?i)(\b(?:v(?:ersion)?\s*\d+(?:\.\d+)*)\b|\b(?:19|20)\d{2}\b|\b(?:final|latest|draft)\b)"

# What names of scopes, topics and files replace; what an exact match leaves out, in order.
NAME_NOISE = r"[^a-zA-Z0-9._-]+"
EVAL_NOISE = (r"\*\*|__|`", r"(?U)\s*\[[^\[\]]+:[^\[\]]+\](?=[。！？.!?]?\s*$)", r"(?U)[。！？.!?]+\s*$", r"(?U)\s+")

# Extensions by modality, and MIME types by extension.
MODALITIES = {
    "image": {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"},
    "audio": {"mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac", "ogg": "audio/ogg", "flac": "audio/flac"},
    "video": {"mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mpeg": "video/mpeg", "mpg": "video/mpeg"},
}


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: str | Column) -> Column:
    return F.btrim(col(value), F.lit(SPACE))


def rstrip(value: str | Column) -> Column:
    return F.rtrim(col(value), F.lit(SPACE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` has it in lambdas, where Catalyst shares nothing."""
    return F.element_at(F.transform(F.array(value), use), 1)


def flat(rows: DataFrame, name: str) -> Column:
    """A column of texts or of lists of texts as text: lists joined by blanks, anything else empty."""
    kind = rows.schema[name].dataType.typeName()
    if kind == "array":
        return F.coalesce(F.array_join(F.col(name).cast("array<string>"), " ", "None"), F.lit(""))
    return F.coalesce(F.col(name), F.lit("")) if kind == "string" else F.lit("")


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def collapse(value: str | Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(col(value), r"(?U)\s(?:\s+|(?<! ))", " "))  # a blank alone stays


def beginning(value: Column, limit: int) -> Column:
    """Collapsed; of a text that is longer than the limit then, maybe only a beginning that is longer, too."""
    early = lambda text: once(collapse(F.left(text, F.lit(4 * limit))), lambda x: F.when(F.length(x) > limit, x).otherwise(collapse(text)))
    return once(value, lambda text: F.when(F.length(text) <= 4 * limit, collapse(text)).otherwise(early(text)))


def normalize(value: str | Column) -> Column:
    """LF line ends, single blanks, at most one empty line, stripped."""
    text = F.regexp_replace(col(value), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def lines(value: str | Column) -> Column:
    """Lines at all line separators that text may have; a last separator opens no line."""
    near, far = "\r\x0b\x0c\x1c\x1d\x1e\x85", ("\u2028", "\u2029")  # those of one byte in Latin-1, and others
    odd = col(value).rlike(f"[{near}]") | any_marker(col(value), far)
    text = F.when(odd, F.regexp_replace(col(value), f"\r\n|[{near}{''.join(far)}]", "\n")).otherwise(col(value))
    return F.split(F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text), "\n", -1)


def headings(value: str | Column) -> Column:
    """Titles of Markdown headings in order."""
    found = F.filter(F.transform(F.filter(lines(value), lambda x: F.contains(x, F.lit("#"))), strip), lambda x: x.rlike(HEADING))
    named = F.transform(found, lambda x: F.regexp_extract(x, HEADING, 2))
    return F.when(~F.contains(col(value), F.lit("#")), F.array().cast("array<string>")).otherwise(named)


def first_of(value: str | Column, patterns: tuple[str, ...]) -> Column:
    """First group of the first of these ``patterns`` (of dates, versions and fields) that matches, stripped; null if none does."""
    return F.when(F.rlike(col(value), F.lit(TOLD)) | any_marker(col(value), TOLD_WIDE), F.coalesce(*[F.when(F.rlike(col(value), F.lit(p)), strip(F.regexp_extract(col(value), p, 1))) for p in patterns]))


def effective_date(value: str | Column) -> Column:
    return blank_to_null(first_of(value, DATES))


def version(value: str | Column) -> Column:
    return blank_to_null(first_of(value, VERSIONS))


def owner(value: str | Column) -> Column:
    return blank_to_null(first_of(value, OWNERS))


def department(value: str | Column) -> Column:
    return blank_to_null(first_of(value, DEPARTMENTS))


def any_marker(value: Column, markers: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(value, F.lit(m))
    return hit


def doc_type(path: str | Column, title: str | Column, text: str | Column) -> Column:
    """First document type whose markers occur in path, title or the text's first 500 characters."""
    where = F.lower(F.concat_ws("\n", col(path), col(title), F.substring(col(text), 1, 500)))
    chain = None
    for name, markers in DOC_TYPES.items():
        chain = (F.when if chain is None else chain.when)(any_marker(where, markers), name)
    return chain.otherwise("document")


def source_key(path: str | Column, title: str | Column, noise: str | None = KEY_NOISE) -> Column:
    """What versions of one source share: without extension and ``noise`` (version, year and state), lower-cased."""
    stem = F.coalesce(blank_to_null(strip(title)), F.element_at(F.split(col(path), "/"), -1))
    stem = F.regexp_replace(stem, r"\.[A-Za-z0-9]+$", "")
    stem = stem if noise is None else F.regexp_replace(stem, "(?U)" + noise, " ")
    stem = F.regexp_replace(stem, r"[_\-/]+", " ")
    return F.coalesce(blank_to_null(F.lower(collapse(stem))), F.lit("document"))


def preview(value: str | Column, limit: int) -> Column:
    """Collapsed, and cut with an ellipsis at the limit."""
    return once(beginning(col(value), limit), lambda text: F.when(F.length(text) <= limit, text).otherwise(F.concat(rstrip(F.substring(text, 1, limit - 3)), F.lit("..."))))


def page_preview(value: str | Column, limit: int) -> Column:
    return once(preview(F.coalesce(col(value), F.lit("")), limit), lambda x: F.when(x != "", x).otherwise(F.lit("No summary available.")))


def limit_body(value: str | Column, limit: int = 2200) -> Column:
    text = strip(value)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(rstrip(F.substring(text, 1, limit - 3)), F.lit("...")))


def normalize_date(value: str | Column) -> Column:
    """ISO form of ``y-m-d``, ``y/m/d`` or the CJK form; else null. No check that the day exists."""
    raw = strip(value)
    iso = lambda p: F.concat_ws("-", F.lpad(F.regexp_extract(raw, p, 1).cast("int").cast("string"), 4, "0"), *(F.lpad(F.regexp_extract(raw, p, i).cast("int").cast("string"), 2, "0") for i in (2, 3)))
    cjk = r"^((?:19|20)\d{2})年(\d{1,2})月(\d{1,2})日"
    dash, slash = r"^(\d{1,9})-(\d{1,9})-(\d{1,9})$", r"^(\d{1,9})/(\d{1,9})/(\d{1,9})$"
    return F.when(raw.rlike(cjk), iso(cjk)).when(raw.rlike(dash), iso(dash)).when(raw.rlike(slash), iso(slash))


def parse_date(value: str | Column) -> Column:
    return F.try_to_date(normalize_date(value), "yyyy-MM-dd")


def parse_rank_date(value: str | Column) -> Column:
    """The reranker's dates: no CJK form."""
    raw = strip(value)
    shape = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$"
    same = raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{4}/\d{1,2}/\d{1,2}$")
    iso = F.concat_ws("-", F.regexp_extract(raw, shape, 1), *(F.lpad(F.regexp_extract(raw, shape, i), 2, "0") for i in (2, 3)))
    return F.try_to_date(F.when(same, iso), "yyyy-MM-dd")


def normalize_version(value: str | Column) -> Column:
    text = F.lower(strip(value))
    for word in ("版本", "version", "：", ":"):
        text = F.replace(text, F.lit(word), F.lit(""))
    return blank_to_null(strip(text))


def version_key(value: str | Column) -> Column:
    """All integers of a version, to be ordered as arrays."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(value), F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def eval_normalize(value: str | Column) -> Column:
    """For exact match: no emphasis marks, trailing citation, closing punctuation or white space."""
    text = strip(F.coalesce(col(value), F.lit("")))
    for noise in EVAL_NOISE:
        text = F.regexp_replace(text, noise, "")
    return text


def safe_float(value: str | Column, default: float = 0.0) -> Column:
    number = col(value).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(default))


def token_estimate(value: str | Column) -> Column:
    """CJK characters count one, others a quarter."""
    cjk = F.regexp_count(col(value), F.lit(r"[一-鿿]"))
    return F.floor(cjk + (F.length(col(value)) - cjk) / 4).cast("int")


def sentences(value: str | Column) -> Column:
    """Stripped pieces behind sentence marks, empty ones left out."""
    return F.filter(F.transform(F.split(col(value), r"(?U)(?<=[。！？.!?])\s*", -1), strip), lambda x: x != "")


def safe_component(value: str | Column, default: str) -> Column:
    text = F.regexp_replace(strip(F.coalesce(col(value), F.lit(""))), NAME_NOISE, "-")
    text = F.regexp_replace(text, r"^[.\-_]+|[.\-_]+$", "")
    return F.coalesce(blank_to_null(F.left(text, F.lit(160))), F.lit(default))


def _dashed(value: Column) -> Column:
    """Runs of other characters than those of file names as a dash, none at the ends; null if nothing is left."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(value, NAME_NOISE, "-"), r"^-+|-+$", ""))


def scope_id(kb: str | Column) -> Column:
    """A knowledge base as part of a name."""
    return F.coalesce(_dashed(col(kb)), F.lit("default"))


def topic_slug(kb: str | Column, topic: str | Column) -> Column:
    return F.concat(scope_id(kb), F.lit("--"), F.coalesce(_dashed(F.lower(col(topic))), F.lit("topic")))


def summary(value: str | Column, limit: int = 600) -> Column:
    """Paragraphs of 20 characters or more that are no headings, until the limit is reached; previewed."""
    least = 20
    joined = lambda acc, x: F.when(F.length(x) < least, acc).when(acc == "", x).otherwise(F.concat_ws(" ", acc, x))

    def step(acc: Column, block: Column) -> Column:
        return F.when((F.length(acc) >= limit) | strip(block).startswith("#"), acc).otherwise(once(beginning(block, max(limit, least)), lambda x: joined(acc, x)))

    return page_preview(F.aggregate(F.split(col(value), "\n\n", -1), F.lit(""), step), limit)


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def modality(path: str | Column) -> Column:
    ext = suffix(path)
    chain = None
    for name, types in MODALITIES.items():
        chain = (F.when if chain is None else chain.when)(ext.isin(*types), name)
    return chain.otherwise("text")


def mime_type(path: str | Column) -> Column:
    """Of a media file; another extension is an error."""
    known = F.create_map(*[F.lit(x) for types in MODALITIES.values() for pair in types.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(path)), F.raise_error(F.concat(F.lit("no MIME type for "), col(path))))


def relative_path(path: str | Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(col(path).startswith(prefix), F.substring(col(path), len(prefix) + 1, 2**31 - 1)).otherwise(col(path))


def doc_id(kb: str | Column, path: str | Column) -> Column:
    """Stable id of a source in a knowledge base."""
    return F.concat(F.lit("doc-"), F.left(F.sha2(F.concat_ws("|", col(kb), col(path)), 256), F.lit(24)))


def sections(value: str | Column, title: str | Column) -> Column:
    """``array<struct<title, level, path, text>>`` in order.

    A heading of level n keeps the n - 1 outermost headings open; skipped levels
    are not filled. Bodies begin with their heading line; empty ones go. One
    fold over the headings; a body is a slice of the lines, each copied once.
    """
    kind = "struct<title: string, level: int, path: array<string>, text: string>"
    head = col(title)
    empty, headed = _shape(value)

    def read(line: Column) -> Column:
        bare = strip(line)
        opens = F.contains(line, F.lit("#")) & bare.rlike(HEADING)
        return F.when(opens, F.struct(bare.alias("text"), F.lit(True).alias("opens"))).otherwise(F.struct(rstrip(line).alias("text"), F.lit(False).alias("opens")))

    start = F.struct(F.array(F.struct(head.alias("title"), F.lit(1).alias("level"), F.array(head).alias("path"), F.lit(0).alias("at"))).alias("done"), F.array().cast("array<string>").alias("stack"))

    def step(acc: Column, line: Column) -> Column:
        level, name = F.length(F.regexp_extract(line["text"], HEADING, 1)), F.regexp_extract(line["text"], HEADING, 2)
        stack = F.concat(F.slice(acc["stack"], F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(name))
        opened = F.struct(name.alias("title"), level.alias("level"), F.concat(F.array(head), stack).alias("path"), line["at"].alias("at"))
        return F.struct(F.concat(acc["done"], F.array(opened)).alias("done"), stack.alias("stack"))

    def cut(rows: Column) -> Column:
        heads = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("at"), x["text"].alias("text"), x["opens"].alias("opens"))), lambda x: x["opens"])
        opened = F.aggregate(heads, start, step, lambda acc: acc["done"])

        def bodies(done: Column) -> Column:
            until = lambda i: F.coalesce(F.get(done, i + 1)["at"], F.size(rows))
            body = lambda s, i: strip(F.array_join(F.transform(F.slice(rows, s["at"] + 1, until(i) - s["at"]), lambda x: x["text"]), "\n"))
            return F.transform(done, lambda s, i: F.struct(s["title"].alias("title"), s["level"].alias("level"), s["path"].alias("path"), body(s, i).alias("text")))

        return F.filter(once(opened, bodies), lambda s: s["text"] != "")

    folded = once(F.transform(lines(value), read), cut)
    none = F.array().cast(f"array<{kind}>")
    # without a heading there is one section, and no fold over the lines
    whole = F.array(F.struct(head.alias("title"), F.lit(1).alias("level"), F.array(head).alias("path"), strip(F.array_join(F.transform(lines(value), rstrip), "\n")).alias("text")))
    return F.when(empty, none).when(headed, folded).otherwise(whole)


def _shape(value: str | Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it may have headings."""
    return ~col(value).rlike(r"(?U)\S"), F.contains(col(value), F.lit("#")) & F.rlike(col(value), F.lit(r"(?m)^\s*#{1,6}\s+\S"))


def section_count(value: str | Column) -> Column:
    """The number of ``sections``: one for each heading, and for what stands before the first."""
    empty, headed = _shape(value)
    first = F.regexp_extract(col(value), "(?U)\\A[\\s\x1c-\x1e]*([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1)  # the first line that is not blank
    return F.when(empty, 0).when(headed, F.size(headings(value)) + F.when(strip(first).rlike(HEADING), 0).otherwise(1)).otherwise(1)


def document_metadata(path: str | Column, title: str | Column, text: str | Column, kb: str | Column) -> Column:
    return F.struct(
        F.coalesce(col(kb), F.lit("default")).alias("kb_id"), doc_type(path, title, text).alias("doc_type"), source_key(path, title).alias("source_key"), headings(text).alias("headings"),
        section_count(text).alias("section_count"), effective_date(text).alias("effective_date"), version(text).alias("version"), owner(text).alias("owner"), department(text).alias("department"),
    )


def bm25_tokens(value: str | Column) -> Column:
    """Words of two characters or more, or letters; CJK characters and their neighbouring pairs."""
    text, word = F.lower(col(value)), F.lit(r"[\p{L}\p{N}_]{2,}|\p{L}")  # a run of word characters is taken whole, or is one character
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    cjk = F.flatten(F.transform(runs, lambda r: F.concat(ngrams(r, 1), ngrams(r, 2))))
    mixed = F.concat(F.regexp_extract_all(F.regexp_replace(text, f"[{CJK}]+", " "), word, F.lit(0)), cjk)
    return F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(F.regexp_extract_all(text, word, F.lit(0)))


#: Characters that have the same case and kind in every engine, however old its tables.
PLAIN = r"\x{0}-\x{12f}\x{131}-\x{24f}"


def bm25_parts(value: str | Column) -> tuple[Column, Column]:
    """``plain``, a text that a task may split itself, or else ``tokens``, those of ``bm25_tokens``."""
    text = F.coalesce(col(value), F.lit(""))
    other = text.rlike(f"[^{PLAIN}]")
    return F.when(~other, text).alias("plain"), F.when(other, bm25_tokens(text)).alias("tokens")


def ngrams(run: Column, size: int) -> Column:
    """All substrings of a length."""
    count = F.length(run) - size + 1
    some = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(run, i, F.lit(size)))
    return F.when(count >= 1, some).otherwise(F.array().cast("array<string>"))


def query_terms(value: str | Column) -> Column:
    """Distinct words of two characters or more, and CJK substrings of two to four."""
    words = F.transform(F.filter(F.regexp_extract_all(col(value), F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 2), F.lower)
    runs = F.regexp_extract_all(col(value), F.lit(f"[{CJK}]+"), F.lit(0))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, lambda r: F.concat(*[ngrams(r, n) for n in (2, 3, 4)])))))


def parse_bool(value: str | Column, default: bool = False) -> Column:
    """A setting's text as a boolean; blank or null is the default, another text false."""
    text = F.lower(strip(col(value)))
    return F.coalesce(blank_to_null(text).isin("1", "true", "yes", "on"), F.lit(default))


def json_text(value: str | Column) -> Column:
    """Any value as JSON text, nulls kept."""
    return F.to_json(F.struct(col(value).alias("v")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(col(value).alias("v")), {"ignoreNullFields": "false"})) - 6)
