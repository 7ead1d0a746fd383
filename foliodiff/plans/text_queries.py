"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodiff.functions import text as t
from foliodiff.plans import sql
from foliodiff.plans import workloads as w


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(t.normalize_text(F.col("text")), 256).alias("digest"))


def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(t.normalize_key(F.col("text")), 256).alias("digest"))


def equality_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy(F.sha2(t.equality_key(F.col("text")), 256).alias("digest")).agg(F.count("*").alias("n"))


def token_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy(F.sha2(F.array_join(t.tokens(F.col("text")), " "), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(t.escape_html(F.col("html")), 256).alias("digest"))


def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", t.one_line(F.col("text"), 120).alias("line"))


def humanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.frame(spark, sf_dir, w.MANIFEST).select("doc_id", t.humanize(F.element_at(F.split("path", "/"), -1)).alias("name"))


def a1_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.col("doc_id") * 7 % 18278).cast("int")
    return _documents(spark, sf_dir).select("doc_id", c.alias("c")).select(
        "doc_id", t.cell_address(F.col("doc_id"), F.col("c")).alias("address"), t.column_index(t.column_letters(F.col("c"))).cast("long").alias("back")
    )


def is_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.frame(spark, sf_dir, w.CELLS_REF).select("doc", "r", "c", t.is_numeric(F.col("value")).alias("numeric"))


def word_diff_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, white space as it stands; line feeds and backslashes within a segment are escaped."""
    docs = _documents(spark, sf_dir).select("doc_id", "lang", F.col("text").alias("a"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang"), F.col("a").alias("b"))
    mark = lambda s: F.when(s["added"], "+").when(s["removed"], "-").otherwise("=")
    text = lambda s: F.replace(F.replace(s["value"], F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    flat = F.transform(t.word_diff(F.col("a"), F.col("b")), lambda s: F.concat(mark(s), text(s)))
    return docs.join(other, ["doc_id", "lang"]).select("doc_id", F.array_join(flat, "\n").alias("diff"))


_WORDS = "regexp_extract_all({x}, '[^ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+')"
_ONE = "trim(" + sql.sub("text", r"[ \t\n\r\f\v]+", " ") + ")"
_LINE = "CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END"

QUERIES = {
    "normalize_text": (normalize_text, f"SELECT doc_id, sha256({sql.normalize_text('text')}) AS digest FROM documents"),
    "normalize_key": (normalize_key, f"SELECT doc_id, sha256({sql.normalize_key('text')}) AS digest FROM documents"),
    "equality_key": (equality_key, f"SELECT sha256({sql.equality_key('text')}) AS digest, count(*) AS n FROM documents GROUP BY 1"),
    "token_key_dupes": (token_key, f"SELECT sha256(array_to_string({sql.token_key('text')}, ' ')) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"),
    "escape_html": (escape_html, "SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages"),
    "one_line": (one_line, f"SELECT doc_id, {_LINE.format(x=_ONE, n=120)} AS line FROM documents"),
    "humanize_names": (
        humanize,
        "SELECT doc_id, trim(array_to_string(list_transform(regexp_extract_all("
        + "regexp_replace(regexp_replace(string_split(path, '/')[-1], '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda p: upper(p[1]) || p[2:]), '')) AS name FROM "
        + w.oracle(w.MANIFEST),
    ),
    "a1_roundtrip": (a1_roundtrip, f"SELECT doc_id, {sql.cell_address('doc_id', '(doc_id * 7 % 18278)')} AS address, doc_id * 7 % 18278 AS back FROM documents"),
    "is_numeric": (is_numeric, f"SELECT doc, r, c, {sql.is_numeric('value')} AS numeric FROM {w.oracle(w.CELLS_REF)}"),
    "word_diff_whole": (
        word_diff_whole,
        f"""
WITH p AS (SELECT d.doc_id, {_WORDS.format(x='d.text')} AS x, {_WORDS.format(x='e.text')} AS y FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 AND e.lang = d.lang),
q AS (SELECT doc_id, unnest(range(1, greatest(len(x), len(y)) + 1)) AS i, unnest(x) AS u, unnest(y) AS v FROM p),
r AS (SELECT doc_id, i, replace(replace(u, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n') AS u, replace(replace(v, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n') AS v FROM q),
s AS (SELECT doc_id, i, CASE WHEN u = v THEN '=' || u WHEN u IS NULL THEN '+' || v WHEN v IS NULL THEN '-' || u ELSE '-' || u || chr(10) || '+' || v END AS part FROM r),
g AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY i) AS diff FROM s GROUP BY doc_id)
SELECT p.doc_id, coalesce(diff, '') AS diff FROM p LEFT JOIN g ON g.doc_id = p.doc_id
""",
    ),
}
#: The same query by its former name.
QUERIES["word_diff_positional"] = QUERIES["word_diff_whole"]
