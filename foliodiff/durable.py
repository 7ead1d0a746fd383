"""Intermediates that are written once and read back, where a plan would otherwise compute them again for every use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows that spread() gives one task: what a task sorts stays the same however large the input is.
TASK_ROWS = 200_000
#: Spark's setting for shuffle files that go when their query has ended; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What written() wrote within the innermost steps().
_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without it gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="foliodiff-shared-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: it survives lost executors and is pruned by column.

    The shuffle files of the write have served then, and go at once. The files themselves stay, but for those that steps() deletes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliodiff-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What written() writes within goes at the end, but for the files that frames read which were given to the function that this yields.

    So a chain of steps takes the disk of one step, not of all. Whatever leaves the block must have been given to that function: other frames
    would find their files gone. steps() may stand within steps(): what the inner one keeps is the outer one's.
    """
    made: list[str] = []
    kept: set[str] = set()  # names of folders

    def keep(df: DataFrame) -> DataFrame:
        kept.update(file.rsplit("/", 2)[-2] for file in df.inputFiles())
        return df

    outer = _made.get()
    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        for name in made:
            if name.rpartition("/")[2] not in kept:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            elif outer is not None:
                outer.append(name)


def spread(df: DataFrame, *by: str, of: DataFrame | None = None) -> DataFrame:
    """df by key in as many tasks as its rows need, and no fewer than shuffles make. Rows are counted first; by number, as sizes in bytes say little of texts that compress well.

    of: what df was filtered from; its rows are counted instead where that is cheaper.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df if of is None else of).count() // TASK_ROWS)), *by)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle and sort: small files may hold millions of like rows, which would pass through the driver as a broadcast."""
    return df.hint("merge")
