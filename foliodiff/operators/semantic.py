"""Matching of content elements (pair_id, idx, kind, label, value) of two documents: keys, values, gathered cells, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.durable import shuffled, spread, written
from foliodiff.functions.text import aggressive, normalize_key, tokens

#: Kinds that are known by a key, kinds that are cells, and kinds that are running text.
KEYED = ("key_value", "heading", "table_cell", "table_header")
CELLS = ("key_value", "table_cell", "table_header")
PROSE = ("prose", "list_item")


def value_key(x: Column) -> Column:
    """Equal for values that match: characters without width dropped, case ignored, separators as spaces, null as empty."""
    return aggressive(F.regexp_replace(F.coalesce(x, F.lit("")), "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]", ""))


def _pair_up(items: DataFrame, phase: str, key: str, eligible: Column) -> DataFrame:
    """The k-th open item of a key on one side takes the k-th on the other."""
    open_ = items.withColumn("_open", F.col("match").isNull() & eligible)
    ranked = open_.withColumn("_n", F.row_number().over(W.partitionBy("pair_id", "side", "_open", key).orderBy("idx")))
    both = F.count("*").over(W.partitionBy("pair_id", "_open", key, "_n")) == 2
    hit = F.col("_open") & both
    named = ranked.withColumn("_hit", hit)
    return named.withColumns({"match": F.when(F.col("_hit"), F.concat_ws("|", key, "_n")).otherwise(F.col("match")), "phase": F.when(F.col("_hit"), phase).otherwise(F.col("phase"))}).drop("_open", "_n", "_hit")


def _gather(items: DataFrame) -> DataFrame:
    """The first running text of a side that says what all open cells of the other side hold takes all of them.

    What cells hold are the words of their labels and values. The text has no other words, at least as many words as cells have different ones, and at most
    twice as many. Every word of a text is looked up among the words of the cells it faces: one pass over words, whatever the number of texts.
    """
    open_ = items.filter("match IS NULL")
    cell = F.col("kind").isin(*CELLS)
    facing = F.when(cell, F.when(F.col("side") == "base", "comp").otherwise("base")).otherwise(F.col("side"))
    held, said = F.array_distinct(F.concat(tokens(F.col("label")), tokens(F.coalesce("value", F.lit(""))))), tokens(F.coalesce("value", F.lit("")))
    words = open_.filter(F.col("kind").isin(*CELLS, *PROSE)).select("pair_id", facing.alias("side"), "idx", cell.alias("cell"), F.explode(F.when(cell, held).otherwise(said)).alias("word"))
    same = W.partitionBy("pair_id", "side", "word")
    known = words.withColumns({"known": F.max("cell").over(same), "new": F.col("cell") & (F.row_number().over(same.orderBy(F.desc("cell"))) == 1)})
    counted = known.withColumn("n_held", F.count_if(F.col("new")).over(W.partitionBy("pair_id", "side"))).filter("NOT cell")
    texts = counted.groupBy("pair_id", "side", "idx").agg(F.count("*").alias("n"), F.min("known").alias("known"), F.first("n_held").alias("n_held")).filter("known AND n BETWEEN n_held AND 2 * n_held")
    first = lambda s: F.min(F.when(F.col("side") == s, F.col("idx"))).alias(f"_{s}")
    joined = items.join(shuffled(texts.groupBy("pair_id").agg(first("base"), first("comp"))), "pair_id", "left")
    side, prose, is_open = F.col("side"), F.col("kind").isin(*PROSE), F.col("match").isNull()
    by = lambda s: is_open & F.col(f"_{s}").isNotNull() & (((side == s) & prose & (F.col("idx") == F.col(f"_{s}"))) | ((side != s) & cell))
    match = F.when(by("base"), "base gathers").when(by("comp"), "comp gathers").otherwise(F.col("match"))
    phase = F.when(by("base") | by("comp"), "gathered").otherwise(F.col("phase"))
    told = joined.withColumns({"_m": match, "_p": phase})
    return told.withColumns({"match": F.col("_m"), "phase": F.col("_p")}).drop("_m", "_p", "_base", "_comp")


def match_elements(base: DataFrame, comp: DataFrame) -> DataFrame:
    """(pair_id, side, idx, phase, partner, status) of every element of both documents; side is base or comp.

    Phases, each on what the ones before left: `key`, elements of KEYED kinds by normalised label; `value`, any kinds by equal
    value; `gathered`, one running text against all cells of the other side; `tokens`, running texts of the same words. Within
    a key the k-th element takes the k-th. status is identical, changed (by key only), missing (base) or added (comp).
    partner is the other side's idx; null for a gathering text, which has several, and for unmatched elements.

    Both documents are one frame, written once; phases are windows over it, partitioned by pair, so no phase recomputes another. Null
    labels and values are empty ones; empty values match each other by value but not by tokens. idx is unique within a side.
    """
    sides = [x.select("pair_id", F.lit(side).alias("side"), "idx", "kind", F.coalesce("label", F.lit("")).alias("label"), "value") for x, side in ((base, "base"), (comp, "comp"))]
    items = sides[0].unionByName(sides[1]).withColumns(
        {"key": normalize_key(F.col("label")), "same": value_key(F.col("value")), "words": F.array_join(tokens(F.coalesce("value", F.lit(""))), " "), "match": F.lit(None).cast("string"), "phase": F.lit(None).cast("string")}
    )
    items = written(items)
    found = _pair_up(spread(items, "pair_id"), "key", "key", F.col("kind").isin(*KEYED))
    found = _pair_up(found, "value", "same", F.lit(True))
    found = _gather(found)
    found = _pair_up(found, "tokens", "words", F.col("kind").isin(*PROSE) & (F.col("words") != ""))
    mates = W.partitionBy("pair_id", "phase", "match")
    other = F.max(F.when(F.col("side") == "base", F.col("idx"))).over(mates), F.max(F.when(F.col("side") == "comp", F.col("idx"))).over(mates)
    gathering = (F.col("phase") == "gathered") & F.col("kind").isin(*PROSE)
    partner = F.when(F.col("match").isNull() | gathering, None).when(F.col("side") == "base", F.col("_c")).otherwise(F.col("_b"))
    status = (
        F.when(F.col("match").isNull(), F.when(F.col("side") == "base", "missing").otherwise("added"))
        .when((F.col("phase") == "key") & (F.col("_lo") != F.col("_hi")), "changed")
        .otherwise("identical")
    )
    told = found.withColumns({"_b": other[0], "_c": other[1], "_lo": F.min("same").over(mates), "_hi": F.max("same").over(mates)})
    return told.select("pair_id", "side", "idx", "phase", partner.alias("partner"), status.alias("status"))
