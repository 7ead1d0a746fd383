"""Comparison of named fields over any number of versions: (group_id, version, ord, label, value); version 0 is the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.functions.pairs import FIELD_LINE
from foliodiff.functions.text import is_numeric, normalize_key


BLANK = " \t\r\n\f\x0b"



def compare_versions(entries: DataFrame, n_versions: int) -> DataFrame:
    """One record for each (key, occurrence) at which a version differs from the reference.

    One shuffle by (group, key): what the reference holds, the ranking and the aggregate all keep that partitioning. A missing
    or empty value is the same. Noise is left out: where the reference is empty and all versions that have a value agree, save
    for a numbered field (`Name #2`) that the reference lacks altogether, an extra record. kinds and texts are arrays by
    version, from 1.
    """
    keyed = entries.withColumn("key", normalize_key(F.col("label")))
    keyed = keyed.withColumn("known", F.max(F.col("version") == 0).over(W.partitionBy("group_id", "key")))
    ranked = keyed.withColumn("n", F.row_number().over(W.partitionBy("group_id", "key", "version").orderBy("ord")))
    value = [F.coalesce(F.max(F.when(F.col("version") == v, F.col("value"))), F.lit("")) for v in range(n_versions)]
    wide = ranked.groupBy("group_id", "key", "n").agg(
        F.min(F.struct("version", "ord", "label"))["label"].alias("label"), F.first("known").alias("known"), value[0].alias("reference_text"), F.array(*value[1:]).alias("texts")
    )
    ref = F.col("reference_text")
    present = F.array_distinct(F.filter("texts", lambda x: x != ""))
    differs = F.exists("texts", lambda x: x != ref)
    extra_record = F.col("label").rlike(" #[0-9]+$") & ~F.col("known")
    kinds = F.transform("texts", lambda x: F.when(x == ref, "unchanged").when(x == "", "removed").when(ref == "", "added").otherwise("changed"))
    return wide.filter(differs & ~((ref == "") & (F.size(present) == 1) & ~extra_record)).drop("known").withColumn("kinds", kinds)


def text_entries(lines: DataFrame) -> DataFrame:
    """Entries (doc, ord, key, label, value) of text lines (doc, line_no, line), line_no from 1.

    A line `Label: value` or `Label = value` is a field. Any other line with text is prose: its key is its number among the
    document's prose lines, so prose meets prose by position. Null and blank lines are no entries. One shuffle by document
    for the numbering.
    """
    line = F.btrim("line", F.lit(BLANK))
    some = lines.select("doc", F.col("line_no").alias("ord"), line.alias("line")).filter("line <> ''").withColumn("is_field", F.col("line").rlike(FIELD_LINE))
    label = F.when(F.col("is_field"), F.btrim(F.regexp_extract("line", FIELD_LINE, 1), F.lit(BLANK))).otherwise(F.concat(F.lit("Text · Line "), F.col("ord").cast("string")))
    value = F.when(F.col("is_field"), F.btrim(F.regexp_extract("line", FIELD_LINE, 2), F.lit(BLANK))).otherwise(F.col("line"))
    before = F.count_if(~F.col("is_field")).over(W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    key = F.when(F.col("is_field"), normalize_key(label)).otherwise(F.concat(F.lit("text#"), before.cast("string")))
    return some.select("doc", "ord", key.alias("key"), label.alias("label"), value.alias("value"))


def sheet_presence(ref: DataFrame, ver: DataFrame) -> DataFrame:
    """(doc, difference_type, sheet, other) where the sheets (doc, pos, sheet) of two versions differ; pos counts from 0.

    A sheet beyond the number of reference sheets is added. A reference sheet is removed if the version has none at its
    position and none of its name. Other names at one position are a rename. Documents without reference sheets give nothing:
    a text is no missing sheet; nor do documents without sheets in the version.
    """
    both = ref.select("doc").distinct().join(ver.select("doc").distinct(), "doc")
    a, b = (x.select("doc", "pos", F.col("sheet").alias(name)).distinct().join(both, "doc", "left_semi") for x, name in ((ref, "old"), (ver, "new")))
    sizes = a.groupBy("doc").agg((F.max("pos") + 1).alias("n"))
    placed = a.join(b, ["doc", "pos"], "full_outer").join(sizes, "doc")
    names = b.select("doc", F.col("new").alias("old"), F.lit(True).alias("elsewhere")).distinct()
    judged = placed.join(names, ["doc", "old"], "left")
    kind = (
        F.when(F.col("old").isNull() & (F.col("pos") >= F.col("n")), "sheet_added")
        .when(F.col("new").isNull() & F.col("elsewhere").isNull(), "sheet_removed")
        .when(F.col("old") != F.col("new"), "sheet_renamed")
    )
    found = judged.withColumn("difference_type", kind).filter("difference_type IS NOT NULL")
    return found.select("doc", "difference_type", F.coalesce("old", "new").alias("sheet"), F.when(F.col("difference_type") == "sheet_renamed", F.col("new")).otherwise("").alias("other"))


def header_changes(ref: DataFrame, ver: DataFrame) -> DataFrame:
    """(doc, pos, c, old, new): header cells (row 0) that hold other text at the same position; numbers and blanks are no names.

    Cells are (doc, sheet_idx, sheet, r, c, value). One join on positions of first rows.
    """
    heads = [x.filter("r = 0").select("doc", F.col("sheet_idx").alias("pos"), "c", F.btrim("value", F.lit(BLANK)).alias(name)).filter(F.col(name) != "") for x, name in ((ref, "old"), (ver, "new"))]
    return heads[0].join(heads[1], ["doc", "pos", "c"]).filter((F.col("old") != F.col("new")) & ~is_numeric(F.col("old")))


def changed_and_kept(found: DataFrame) -> DataFrame:
    """Records of compare_versions with the versions (from 1) that changed and those that did not."""
    of = lambda wanted: F.filter(F.transform("kinds", lambda k, i: F.when((k == "unchanged") != F.lit(wanted), i + 1)), lambda x: x.isNotNull())
    return found.withColumns({"changed": of(True), "kept": of(False)})
