"""Line deduplication by overlapping windows of three consecutive lines.

Lines are the `\\n`-split pieces of a text; those of white space alone are no part of any window and are always kept.
A window is three consecutive other lines, compared without outer white space. Of a window that occurs more than once
anywhere, all occurrences but the first (smallest document id, then position) are marked; marked windows merge, and
every line that one covers is removed.

Windows are hashed to 128 bits. First occurrences are a pre-aggregated minimum, one row a hash, joined back to the
windows many-to-one, which adaptive execution can split where a window is popular. Marks are gathered by document, so
no group is larger than a document. Only built-in expressions.

A null text has no lines and stays null; documents of fewer than three lines stay as they are. Documents are known by id
and text: rows that repeat both count once and share the result; null ids come first. Columns of the input that are named
as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import doc_keys
from .common import unused

WIDTH = 3
OUTER = " \t\r\x0b\f"


def _filled(lines: Column) -> Column:
    """array<struct<i, line>>: positions and trimmed texts of the lines that hold more than white space."""
    trimmed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(OUTER)).alias("line")))
    return F.filter(trimmed, lambda x: x["line"] != "")


def windows(docs: DataFrame) -> DataFrame:
    """(d1, d2, at, h1, h2) of every window; docs has d1, d2 and text."""

    def hashed(f: Column) -> Column:
        n = F.size(f)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), lambda i: i + WIDTH <= n)

        def one(i: Column) -> Column:
            lines = [F.get(f, i + k)["line"] for k in range(WIDTH)]
            return F.struct(i.alias("at"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(1), *lines[::-1]).alias("h2"))

        return F.transform(starts, one)

    found = F.transform(F.array(_filled(F.split("text", "\n"))), hashed)[0]
    return docs.filter(F.col("text").isNotNull()).select("d1", "d2", F.explode(found).alias("w")).select("d1", "d2", "w.*")


def marked(docs: DataFrame) -> DataFrame:
    """(d1, d2, starts): the windows of each document that occur earlier."""
    every = windows(docs)
    first = every.groupBy("h1", "h2").agg(F.min(F.struct("d1", "at")).alias("first"), F.max(F.struct("d1", "at")).alias("last")).filter("first < last")
    late = every.join(first, ["h1", "h2"]).filter(F.struct("d1", "at") > F.col("first"))
    return late.groupBy("d1", "d2").agg(F.collect_set("at").alias("starts"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines (lines with more than white space), n_removed and kept_text."""
    d1, d2 = doc_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = docs.select(d1.alias("d1"), d2.alias("d2"), F.col(f"`{text}`").alias("text"))
    starts = marked(keyed)
    base = docs.drop("n_lines", "n_removed", "kept_text")
    k1, k2, at, out = unused(base, "k1", "k2", "starts", "gone")
    named = starts.select(F.col("d1").alias(k1), F.col("d2").alias(k2), F.col("starts").alias(at))
    joined = base.withColumns({k1: d1, k2: d2}).join(named, [k1, k2], "left")
    lines = F.split(F.col(f"`{text}`"), "\n")

    def removed(filled: Column) -> Column:
        ranks = F.array_distinct(F.flatten(F.transform(at, lambda s: F.array(*[s + k for k in range(WIDTH)]))))
        return F.transform(ranks, lambda r: F.get(filled, r)["i"])

    gone = F.when(F.col(at).isNull(), F.array().cast("array<int>")).otherwise(F.transform(F.array(_filled(lines)), removed)[0])
    kept = F.transform(F.array(lines), lambda a: F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col(out)), lambda i: F.get(a, i)))[0]
    return (
        joined.withColumns({out: gone, "n_lines": F.coalesce(F.size(_filled(lines)), F.lit(0)).cast("long")})
        .withColumns(
            {
                "n_lines": F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.col("n_lines")).cast("long"),
                "n_removed": F.size(out).cast("long"),
                "kept_text": F.when(F.size(out) == 0, F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n")),
            }
        )
        .drop(k1, k2, at, out)
    )


#: DuckDB SQL of dedup over documents: doc_id, n_lines, n_removed and the SHA-256 of the kept text.
SQL = """
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, unnest(lines) AS raw_line, generate_subscripts(lines, 1) AS i FROM raw
), trimmed AS (
  SELECT *, trim(raw_line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM line
), filled AS (
  SELECT doc_id, i, line, row_number() OVER w AS r, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2
  FROM trimmed WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), started AS (
  SELECT doc_id, r, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, r) > 1 AS late FROM filled WHERE l2 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, r + k AS r FROM started, (SELECT unnest([0, 1, 2]) AS k) WHERE late
), judged AS (
  SELECT t.doc_id, t.i, t.raw_line, f.r IS NOT NULL AS is_filled, g.r IS NOT NULL AS is_gone
  FROM trimmed t LEFT JOIN filled f ON t.doc_id = f.doc_id AND t.i = f.i LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.r = g.r
)
SELECT d.doc_id, coalesce(sum(is_filled::INT), 0)::BIGINT AS n_lines, coalesce(sum(is_gone::INT), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(raw_line, chr(10) ORDER BY i) FILTER (WHERE NOT is_gone), '') END) AS kept_sha256
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id, d.text
"""
