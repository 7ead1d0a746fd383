"""Reports as they arrive in a folder: the scan of sources.files over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodiff.functions import names
from foliodiff.sources.files import SCHEMA, _parsed, magic

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of sources.files.SCHEMA; each file is read once, however often the query restarts."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    some = found.filter(names.extension(F.col("path")).isin(*names.KINDS)).select("path", F.col("length").alias("size"), "content", magic(F.col("content")).alias("detected"))
    return some.mapInArrow(_parsed, SCHEMA)
