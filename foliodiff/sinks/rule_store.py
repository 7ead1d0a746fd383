"""Ignore rules in a folder of Parquet files: every edit appends, nothing is rewritten, and the current rules follow from all edits.

An edit is (edit, scope, key, rule_id, ord): added, removed or cleared; ord is its time in microseconds, and also the age of a
rule in the cascade. Edits of one time count in the order removed, cleared, added. A store without edits has no rules.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "edit string, scope string, key string, rule_id string, ord long"


def _append(edits: DataFrame, path: str) -> None:
    edits.select("edit", "scope", "key", "rule_id", "ord").write.mode("append").parquet(path)


def _now(at: int | None):
    return F.lit(time.time_ns() // 1000 if at is None else at).cast("long")


def add(path: str, rules: DataFrame, at: int | None = None) -> None:
    """Adds rules (scope, key), each under an id of its own."""
    _append(rules.select(F.lit("added").alias("edit"), "scope", "key", F.expr("uuid()").alias("rule_id"), _now(at).alias("ord")), path)


def remove(path: str, rule_ids: DataFrame, at: int | None = None) -> None:
    """Removes the rules (rule_id); unknown ids are no fault."""
    none = F.lit(None).cast("string")
    _append(rule_ids.select(F.lit("removed").alias("edit"), none.alias("scope"), none.alias("key"), "rule_id", _now(at).alias("ord")), path)


def clear(spark: SparkSession, path: str, at: int | None = None) -> None:
    none = F.lit(None).cast("string")
    _append(spark.range(1).select(F.lit("cleared").alias("edit"), none.alias("scope"), none.alias("key"), none.alias("rule_id"), _now(at).alias("ord")), path)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(scope, key, rule_id, ord) of the rules in force, as apply_rules() takes them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "scope string, key string, rule_id string, ord long")
    edits = spark.read.schema(SCHEMA).parquet(path)
    cleared = edits.agg(F.max(F.when(F.col("edit") == "cleared", F.col("ord"))).alias("cleared"))  # one row
    gone = edits.filter("edit = 'removed'").select("rule_id").distinct()
    kept = edits.filter("edit = 'added'").join(gone, "rule_id", "left_anti").join(F.broadcast(cleared))
    return kept.filter("cleared IS NULL OR ord >= cleared").select("scope", "key", "rule_id", "ord")
