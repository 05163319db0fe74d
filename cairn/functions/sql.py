"""The text functions for those who write SQL: scalar functions, and table functions for LATERAL joins.

Their bodies are SQL, so that a query that calls them is one plan without
Python. ``register`` makes them functions of the session, or of a database
where they outlive it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cairn.functions.text import CJK

#: A table function's generator may call no other function, so the body stands in two.
TOKENS = rf"""
        concat(filter(regexp_extract_all(regexp_replace(lower(value), '[{CJK}]+', ' '), r'[\p{{{{L}}}}\p{{{{N}}}}_]+', 0), x -> length(x) > 1 OR x RLIKE r'^\p{{{{L}}}}$'),
               flatten(transform(regexp_extract_all(lower(value), '[{CJK}]+', 0), run -> concat(
                 transform(sequence(1, length(run)), i -> substring(run, i, 1)),
                 filter(transform(sequence(1, length(run)), i -> substring(run, i, 2)), x -> length(x) = 2)))))"""
#: Name, parameters, what it returns, and the body.
FUNCTIONS = (
    ("strip", "value STRING", "STRING", r"regexp_replace(value, r'(?U)^\s+|\s+$', '')"),
    ("normalize", "value STRING", "STRING", r"""
        {p}strip(regexp_replace(regexp_replace(regexp_replace(value, r'\r\n?', '\n'), r'[ \t]+', ' '), r'\n{{3,}}', '\n\n'))"""),
    ("collapse", "value STRING", "STRING", r"{p}strip(regexp_replace(value, r'(?U)\s+', ' '))"),
    ("preview", "value STRING, most INT", "STRING", r"""
        CASE WHEN length({p}collapse(value)) <= most THEN {p}collapse(value)
             ELSE concat(regexp_replace(substring({p}collapse(value), 1, most - 3), r'(?U)\s+$', ''), '...') END"""),
    ("doc_id", "kb STRING, path STRING", "STRING", "concat('doc-', left(sha2(concat_ws('|', kb, path), 256), 24))"),
    ("version", "value STRING", "STRING", r"""
        nullif({p}strip(replace(replace(replace(replace(lower({p}strip(value)), '版本', ''), 'version', ''), '：', ''), ':', '')), '')"""),
    ("iso_date", "value STRING", "STRING", r"""
        CASE WHEN {p}strip(value) RLIKE r'^((?:19|20)\d{{2}})年(\d{{1,2}})月(\d{{1,2}})日'
             THEN {p}three({p}strip(value), r'^((?:19|20)\d{{2}})年(\d{{1,2}})月(\d{{1,2}})日')
             WHEN {p}strip(value) RLIKE r'^(\d{{1,9}})-(\d{{1,9}})-(\d{{1,9}})$' THEN {p}three({p}strip(value), r'^(\d{{1,9}})-(\d{{1,9}})-(\d{{1,9}})$')
             WHEN {p}strip(value) RLIKE r'^(\d{{1,9}})/(\d{{1,9}})/(\d{{1,9}})$' THEN {p}three({p}strip(value), r'^(\d{{1,9}})/(\d{{1,9}})/(\d{{1,9}})$') END"""),
    ("to_day", "value STRING", "DATE", "try_to_date({p}iso_date(value), 'yyyy-MM-dd')"),
    ("matches", """doc_type STRING, version STRING, effective_date STRING,
                   doc_types ARRAY<STRING>, wanted_version STRING, date_from STRING, date_to STRING, soft BOOLEAN""", "BOOLEAN", """
        coalesce(
          (coalesce(size(doc_types), 0) <= 0 OR (coalesce(soft, false) AND coalesce(doc_type, '') = '')
           OR (coalesce(doc_type, '') <> '' AND exists(doc_types, x -> lower(x) = lower(doc_type))))
          AND (coalesce(wanted_version, '') = '' OR {p}version(matches.version) <=> {p}version(wanted_version))
          AND (({p}to_day(date_from) IS NULL AND {p}to_day(date_to) IS NULL)
               OR ({p}to_day(effective_date) IS NOT NULL
                   AND ({p}to_day(date_from) IS NULL OR {p}to_day(effective_date) >= {p}to_day(date_from))
                   AND ({p}to_day(date_to) IS NULL OR {p}to_day(effective_date) <= {p}to_day(date_to)))), false)"""),
    ("ngrams", "run STRING, n INT", "ARRAY<STRING>", """
        CASE WHEN length(run) >= n THEN transform(sequence(1, greatest(length(run) - n + 1, 1)), i -> substring(run, i, n)) ELSE array() END"""),
    ("tokens", "value STRING", "ARRAY<STRING>", TOKENS),
    ("chunk_fixed", "value STRING, size INT, overlap INT", "TABLE (chunk_index INT, chunk STRING)", """
        SELECT pos, {p}strip(substring(value, col + 1, size)) FROM posexplode(
          CASE WHEN length(value) > 0 THEN sequence(0, greatest(length(value) - 1, 0), if(size > overlap, size - overlap, raise_error('size must be greater than overlap')))
               ELSE array() END)"""),
    ("sentences", "value STRING", "TABLE (nth INT, sentence STRING)", r"""
        SELECT pos, col FROM posexplode(filter(transform(split(value, r'(?U)(?<=[。！？.!?])\s*', -1), x -> regexp_replace(x, r'(?U)^\s+|\s+$', '')), x -> x <> ''))"""),
    ("lines", "value STRING", "TABLE (nth INT, line STRING)", r"SELECT pos, col FROM posexplode(split(value, '\n', -1))"),
    ("terms", "value STRING", "TABLE (nth INT, term STRING)", f"SELECT pos, col FROM posexplode({TOKENS})"),
)
#: Used by others, so made first.
HELPERS = (
    ("three", "value STRING, shape STRING", "STRING", """
        concat_ws('-', lpad(cast(cast(regexp_extract(value, shape, 1) AS INT) AS STRING), 4, '0'), lpad(cast(cast(regexp_extract(value, shape, 2) AS INT) AS STRING), 2, '0'),
                  lpad(cast(cast(regexp_extract(value, shape, 3) AS INT) AS STRING), 2, '0'))"""),
)


def register(spark: SparkSession, prefix: str = "cairn_", database: str | None = None) -> list[str]:
    """Creates the functions, of the session or of ``database``; their names."""
    made, kind = [], "TEMPORARY FUNCTION" if database is None else "FUNCTION"
    where = "" if database is None else f"{database}."
    for name, parameters, returns, body in HELPERS + FUNCTIONS:
        full = f"{where}{prefix}{name}"
        text = body.format(p=f"{where}{prefix}").replace(f"{name}.", f"{prefix}{name}.")
        spark.sql(f"CREATE OR REPLACE {kind} {full}({parameters}) RETURNS {returns} RETURN {text}")
        made.append(full)
    return made
