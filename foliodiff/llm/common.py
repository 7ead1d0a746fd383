"""Shared pieces of the training-text operators: tokens, keys, durable intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, one for each of names."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        found.append(name)
    return found


def checkpoint_ready(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: the cluster's own, or one made here for local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="foliodiff-checkpoint-")
        sc.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet beside the checkpoints and read back: compressed, pruned by column, cut anew into tasks.

    The shuffle files of the write have served then, and go at once.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/foliodiff-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def fixed(df: DataFrame) -> DataFrame:
    """df if it only selects from files, else stored(df): a task that runs again then reads the same rows in the same order."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.match(r"[\s:+-]*(\w+)", line).group(1) for line in plan.splitlines() if line.strip()}
    return df if nodes <= {"Project", "Filter", "Relation"} else stored(df)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
