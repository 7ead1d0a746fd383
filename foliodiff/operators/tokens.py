"""Matching of prose by its tokens: same words in any order, and statements that gather several cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.functions.text import tokens


def match_by_tokens(base: DataFrame, comp: DataFrame) -> DataFrame:
    """(pair_id, base_idx, comp_idx): rows (pair_id, idx, value) of equal token multisets, the k-th with the k-th."""

    def ranked(side: DataFrame, name: str) -> DataFrame:
        keyed = side.withColumn("key", F.array_join(tokens(F.col("value")), " ")).filter("key <> ''")
        n = F.row_number().over(W.partitionBy("pair_id", "key").orderBy("idx"))
        return keyed.select("pair_id", "key", n.alias("n"), F.col("idx").alias(f"{name}_idx"))

    return ranked(base, "base").join(ranked(comp, "comp"), ["pair_id", "key", "n"]).select("pair_id", "base_idx", "comp_idx")


def gathers(prose: Column, cells: Column) -> Column:
    """The prose says what the cells hold: all its tokens are theirs, and it has as many as they have different ones, at most twice."""
    said, held = tokens(prose), F.array_distinct(F.flatten(F.transform(cells, tokens)))
    return (F.size(F.array_except(said, held)) == 0) & F.size(said).between(F.size(held), 2 * F.size(held)) & (F.size(said) > 0)
