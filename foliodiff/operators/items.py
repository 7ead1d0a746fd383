"""Named values of documents: extraction from lines, deduplication, matching of two versions, difference records.

Items are rows (pair_id, idx, kind, label, value); idx is the order in the document, which decides ties everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.durable import shuffled
from foliodiff.functions.text import equality_key, normalize_key, normalize_text

#: Kinds whose unmatched rows are reported; prose and cells without a partner are not.
REPORTED = ("field_value", "heading")


def extract_pair(line: Column) -> Column:
    """struct<field, value> of a line `Field: value`, `Field = value`, `Field    value` or `Field 123`; null otherwise."""
    text = F.btrim(line, F.lit(" \t\r\n\f\x0b"))
    forms = (
        "^([A-Za-z][^:|=]{0,79}?)[ \t]*:[ \t]*([^|]+)$",
        "^([A-Za-z][^:|=]{0,79}?)[ \t]*=[ \t]*([^|]+)$",
        "^([A-Za-z][A-Za-z ]{0,29}?)[ \t]{2,}([^ \t].*)$",
        "^([A-Za-z][A-Za-z ]{1,28}[A-Za-z]) ([0-9][0-9,.:/-]*)$",
    )
    out = None
    for form in forms:
        found = F.struct(F.trim(F.regexp_extract(text, form, 1)).alias("field"), F.trim(F.regexp_extract(text, form, 2)).alias("value"))
        out = F.when(text.rlike(form), found) if out is None else out.when(text.rlike(form), found)
    return out


def deduplicate(items: DataFrame) -> DataFrame:
    """Of field values, the shortest of each key, first on ties; of other kinds, the first of each key and normalised value.

    Items may bring their key; without one it is the normalised label.
    """
    if "key" not in items.columns:
        items = items.withColumn("key", normalize_key(F.col("label")))
    same = F.when(F.col("kind") == "field_value", F.lit("")).otherwise(normalize_text(F.col("value")))
    size = F.when(F.col("kind") == "field_value", F.length("value")).otherwise(0)
    best = items.groupBy("pair_id", "kind", "key", same.alias("_same")).agg(F.min(F.struct(size.alias("size"), "idx", "label", "value")).alias("best"))
    return best.select("pair_id", "kind", "key", "best.idx", "best.label", "best.value")


def _ranked(items: DataFrame, side: str) -> DataFrame:
    keyed = items.filter(F.col("kind").isin(*REPORTED)).withColumn("key", normalize_key(F.col("label")))
    n = F.row_number().over(W.partitionBy("pair_id", "key").orderBy("idx"))  # occurrences of one key in one document
    return keyed.select("pair_id", "key", n.alias("n"), *(F.col(c).alias(f"{side}_{c}") for c in ("idx", "kind", "label", "value")))


def match_by_key(base: DataFrame, comp: DataFrame) -> DataFrame:
    """The k-th occurrence of a key against the k-th: one full outer join. status: identical, changed, missing or added."""
    joined = _ranked(base, "base").join(shuffled(_ranked(comp, "comp")), ["pair_id", "key", "n"], "full_outer")
    status = (
        F.when(F.col("comp_idx").isNull(), "missing")
        .when(F.col("base_idx").isNull(), "added")
        .when(equality_key(F.col("base_value")) == equality_key(F.col("comp_value")), "identical")
        .otherwise("changed")
    )
    return joined.withColumn("status", status)


def difference_records(matched: DataFrame) -> DataFrame:
    """One record a difference, with type, location signature and a sentence that describes it."""
    label = F.coalesce("base_label", "comp_label")
    kind = F.col("status")
    dtype = (
        F.when(kind == "missing", "missing_content")
        .when(kind == "added", "added_content")
        .when(F.col("base_kind") == "field_value", "value_mismatch")
        .when(F.col("base_kind") == "table_cell", "cell_changed")
        .otherwise("text_changed")
    )
    signature = F.when(kind == "missing", F.concat(F.lit("missing|"), "key")).when(kind == "added", F.concat(F.lit("added|"), "key")).otherwise(F.concat_ws("|", "base_kind", "key", F.col("n").cast("string")))
    described = (
        F.when(kind == "missing", F.concat(label, F.lit(" is missing; it was \""), "base_value", F.lit('".')))
        .when(kind == "added", F.concat(label, F.lit(" was added: \""), "comp_value", F.lit('".')))
        .otherwise(F.concat(label, F.lit(" changed from \""), "base_value", F.lit("\" to \""), "comp_value", F.lit('".')))
    )
    return matched.filter("status <> 'identical'").select(
        "pair_id", dtype.alias("difference_type"), signature.alias("location_signature"), label.alias("location_label"),
        F.coalesce("base_value", F.lit("")).alias("reference_text"), F.coalesce("comp_value", F.lit("")).alias("version_text"), described.alias("description"),
    )
