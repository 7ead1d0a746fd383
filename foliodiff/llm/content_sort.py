"""Exact duplicates by sorting contents: splitters, sorted ranges, comparison of neighbours.

Texts are normalised, cut into ranges by sampled splitters (`repartitionByRange`), sorted inside each range by Spark's external sort, and
every text is compared as a whole with its neighbour. Range keys are the first characters and a 64-bit hash of the normalised text, so that
splitters stay short however long texts are; the sort itself goes on to the whole text, so equal means equal, not equally hashed.

Texts with many copies are found first by an exact count. A hash with more than a HEAVY-th of all rows has at most HEAVY others like it, which is
small enough to broadcast at any size; its rows are dealt over that many ranges by id, and the few leaders of these ranges are compared once more.

Defined results. A null text counts as empty; empty texts equal each other. The row with the largest (or, by parameter, smallest) id of a group
stays; null ids come last, and of rows with the same text and id exactly one, no matter which, stays. Texts of any length are compared whole.
Empty tables give no rows. Extra columns are left out of the result, except those named in keep; ids may be of any type that sorts.
Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fixed, stored

#: Hashes with more than this share of all rows are spread over several ranges.
HEAVY = 1_000
#: Characters of a text in a range key.
HEAD = 16


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_largest: bool = True) -> DataFrame:
    """One row a document: id, text (normalised), keep_id, group_size, kept."""
    return _grouped(docs, text, id_col, keep_largest, F.col("_text").alias("text"))


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_largest: bool = True) -> DataFrame:
    """As dedup, with the SHA-256 of the normalised text in place of the text: id, text_sha256, keep_id, group_size, kept."""
    return _grouped(docs, text, id_col, keep_largest, F.sha2("_text", 256).alias("text_sha256"))


def survivors(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_largest: bool = True) -> DataFrame:
    """The normalised texts that stay, with their ids."""
    return dedup(docs, text, id_col, keep_largest).filter("kept").select("id", "text")


def _grouped(docs: DataFrame, text: str, id_col: str, keep_largest: bool, shown: Column) -> DataFrame:
    rows = fixed(docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))).withColumn("_hash", F.xxhash64("_text"))
    total = max(1, rows.count())
    heavy = rows.groupBy("_hash").count().filter(F.col("count") * HEAVY > total)  # fewer than HEAVY rows
    heavy = heavy.select("_hash", F.ceil(F.col("count") * HEAVY / total).alias("_spread"))
    dealt = rows.join(F.broadcast(heavy), "_hash", "left").withColumn("_part", F.pmod(F.xxhash64("id"), "_spread"))  # null: not spread
    key = ["_head", "_hash", "_part"]
    ranged = dealt.select("id", "_text", F.left("_text", F.lit(HEAD)).alias("_head"), "_hash", "_part").repartitionByRange(*key)
    first = F.desc_nulls_last("id") if keep_largest else F.asc_nulls_last("id")
    order = Window.partitionBy(*key).orderBy("_text", first)
    compared = ranged.withColumn("_leads", ~F.lag("_text").over(order).eqNullSafe(F.col("_text")))
    runs = compared.withColumn("_run", F.sum(F.col("_leads").cast("long")).over(order)).withColumn("_leader", F.last(F.when(F.col("_leads"), F.struct("id")), ignorenulls=True).over(order))
    slim = runs.select("id", *key, "_run", "_leads", "_leader", shown, F.when(F.col("_leads") & F.col("_part").isNotNull(), F.col("_text")).alias("_proof"))
    # the copies of a leader are counted without their texts
    local = stored(slim.withColumn("_copies", F.count("*").over(Window.partitionBy(*key, "_run"))))

    # leaders of spread hashes: fewer than 2 * HEAVY ranges, each with one leader a text
    same = Window.partitionBy("_hash", "_proof")
    leaders = local.filter(F.col("_proof").isNotNull()).withColumn("_best", F.row_number().over(same.orderBy(first)) == 1)
    leaders = leaders.withColumn("_all", F.sum("_copies").over(same)).withColumn("_of", F.max(F.when(F.col("_best"), F.col("_leader"))).over(same))
    joined = local.drop("_proof").join(leaders.select("_head", "_hash", "_part", "_run", "_best", "_all", "_of"), [*key, "_run"], "left")
    return joined.select(
        "id",
        "text" if "text" in local.columns else "text_sha256",
        F.coalesce("_of", "_leader")["id"].alias("keep_id"),
        F.coalesce("_all", "_copies").alias("group_size"),
        (F.col("_leads") & F.coalesce("_best", F.lit(True))).alias("kept"),
    )


SQL = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
