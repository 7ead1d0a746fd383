"""Content elements of texts for the older engine: (doc, idx, kind, key, label, value, location), and the records of what two texts differ in.

Only the order of line_no counts. One shuffle, by document; everything else is windows over it, so documents are sorted, may spill and are never one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.durable import shuffled, spread, written
from foliodiff.functions.pairs import COLON, EQUALS, KEY_VALUE, cells_of, pair, trim
from foliodiff.functions.text import normalize_key
from foliodiff.operators.run import sentence
from foliodiff.operators.semantic import match_elements

NAME = "^[A-Za-z][A-Za-z ]*$"


def cells_in_turn(lines: DataFrame) -> DataFrame:
    """(doc, place, line): a table whose cells stand on lines of their own gets pipes; places count from 1.

    From the first two lines that may be column names (letters, fewer than 30) on, if all lines behind them are labels (at most 50 letters, no plain
    number) and values in turn to the end of the text, without blank ones; a last line without a partner stays.
    """
    by_line = W.partitionBy("doc").orderBy("line_no")
    text = trim(F.coalesce("line", F.lit("")))
    rows = lines.select("doc", "line", text.alias("text"), (F.row_number().over(by_line) - 1).alias("place"), F.lead(text).over(by_line).alias("below"))
    name = lambda x: F.length(x).between(1, 29) & x.rlike(NAME)
    bad = F.col("below").isNotNull() & ((F.col("text") == "") | (F.col("below") == "") | (F.length("text") > 50) | F.col("text").rlike("^[0-9.]+$"))
    side = W.partitionBy("doc", F.col("place") % 2).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    known = rows.withColumns({"_bad": F.coalesce(F.max(F.when(bad, F.col("place"))).over(side), F.lit(-1)), "_n": F.count("*").over(W.partitionBy("doc"))})
    starts = name(F.col("text")) & F.coalesce(name(F.col("below")), F.lit(False)) & (F.col("_bad") < F.col("place") + 2) & (F.col("place") + 3 < F.col("_n"))
    placed = known.withColumn("_from", F.min(F.when(starts, F.col("place"))).over(W.partitionBy("doc")))
    inside = F.col("_from").isNotNull() & (F.col("place") >= F.col("_from"))
    label = inside & ((F.col("place") - F.col("_from")) % 2 == 0) & F.col("below").isNotNull()
    value = inside & ((F.col("place") - F.col("_from")) % 2 == 1)
    kept = placed.filter(~F.coalesce(value, F.lit(False))).select("doc", "place", F.when(label, F.concat_ws(" | ", "text", "below")).otherwise(F.col("line")).alias("line"))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy("place")))


def text_elements(lines: DataFrame) -> DataFrame:
    """Elements of text lines (doc, line_no, line): rows of pipe tables first (a header row as prose, then label and value of the first two cells), then headings, list
    items, fields and prose. Headers, list items and prose are numbered together. Null and blank lines and lines of rules give nothing."""
    so_far = W.partitionBy("doc").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = cells_in_turn(spread(lines.select("doc", "line_no", "line"), "doc")).select("doc", "place", trim(F.coalesce("line", F.lit(""))).alias("line"))
    rows = rows.withColumn("cells", cells_of(F.col("line")))
    rows = rows.withColumn("table", F.size(F.filter("cells", lambda c: c != "")) >= 2)
    opens = F.col("table") & ~F.coalesce(F.lag("table").over(W.partitionBy("doc").orderBy("place")), F.lit(False))
    rows = rows.withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(so_far))
    header = F.col("opens") & F.forall("cells", lambda c: c.rlike("^[A-Za-z]"))
    line, first, second = F.col("line"), F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    group = lambda form, k: trim(F.regexp_extract(line, form, k))
    heading, item = "^#{1,6}[ \t]+(.+)$", "^[-•*][ \t]+(.+)$"
    shape = (
        F.when(F.col("table"), F.when(header, "header").when((first != "") & (second != ""), "row"))
        .when((line == "") | line.rlike("^[|\\-+:]+$"), None)
        .when(line.rlike(heading), "heading")
        .when(line.rlike(item), "list_item")
        .when(line.rlike(KEY_VALUE), "field")
        .otherwise("prose")
    )
    shaped = rows.withColumn("shape", shape).filter("shape IS NOT NULL")
    order = W.partitionBy("doc").orderBy(F.desc("table"), "place")
    counted = F.col("shape").isin("header", "list_item", "prose")
    numbered = shaped.withColumns({"idx": F.row_number().over(order) - 1, "n": F.count_if(counted).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1})
    s, at = F.col("shape"), F.col("place").cast("string")
    whole = F.when(s == "header", F.array_join("cells", " | ")).otherwise(line)
    value = F.when(s == "row", second).when(s == "heading", group(heading, 1)).when(s == "list_item", group(item, 1)).when(s == "field", group(KEY_VALUE, 2)).otherwise(whole)
    label = F.when(s == "row", first).when(s == "field", group(KEY_VALUE, 1)).when(s == "list_item", F.concat(F.lit("List item · Line "), at)).otherwise(whole)
    kind = F.when(s.isin("row", "field"), "key_value").when(s.isin("header", "prose"), "prose").otherwise(s)
    told = numbered.select("doc", "idx", kind.alias("kind"), "shape", "n", label.alias("label"), value.alias("value"), F.concat(F.lit("Line "), at).alias("location"))
    number = lambda name: F.concat(F.lit(name), F.col("n").cast("string"))
    key = F.when(s == "header", number("header#")).when(s == "list_item", number("list#")).when(s == "prose", number("text#")).when(s == "heading", normalize_key(F.col("value"))).otherwise(normalize_key(F.col("label")))
    return told.select("doc", "idx", "kind", key.alias("key"), "label", "value", "location")


def with_stated_pairs(elements: DataFrame) -> DataFrame:
    """Elements with prose that states a field in place of it: `Field | value` (further cells are left out), `Field: value` or `Field = value`.

    A row of pipes whose parts are all names (letters first, no digits, fewer than 30) is a header and states nothing; with pipes no other form is tried.
    """
    text = trim(F.col("value"))
    parts = F.filter(cells_of(text), lambda p: p != "")
    names = F.forall(parts, lambda p: (F.length(p) < 30) & p.rlike("^[A-Za-z]") & ~p.rlike("[0-9]"))
    said = lambda form: F.when(text.rlike(form), pair(trim(F.regexp_extract(text, form, 1)), trim(F.regexp_extract(text, form, 2))))
    found = F.when(text.contains("|"), F.when((F.size(parts) >= 2) & ~names, pair(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))).otherwise(F.coalesce(said(COLON), said(EQUALS)))
    stated = elements.withColumn("_p", F.when(F.col("kind") == "prose", found))
    has = F.col("_p").isNotNull()
    pick = lambda a, b: F.when(has, a).otherwise(b)
    return stated.select(
        *(c for c in elements.columns if c not in ("kind", "key", "label", "value", "location")), pick(F.lit("key_value"), F.col("kind")).alias("kind"), pick(normalize_key(F.col("_p.field")), F.col("key")).alias("key"),
        pick(F.col("_p.field"), F.col("label")).alias("label"), pick(F.col("_p.value"), F.col("value")).alias("value"), "location",
    )


def element_records(base: DataFrame, comp: DataFrame, b_format: Column, c_format: Column) -> DataFrame:
    """(pair_id, side, idx, difference_type, location_signature, location_label, reference_text, version_text, description) of elements (pair_id, idx, kind,
    key, label, value, location) of two texts: changed ones, and all without a partner. Prose that states a field is read as one first. idx is the baseline's, of added ones the version's."""
    base, comp = (written(with_stated_pairs(side)) for side in (base, comp))
    found = match_elements(base, comp).filter("status <> 'identical' AND (side = 'base' OR status = 'added')")
    told = lambda side, name: side.select("pair_id", F.col("idx").alias(f"_{name}"), F.struct("kind", "key", "label", "value", "location").alias(name))
    own = F.when(F.col("side") == "base", F.col("idx"))
    other = F.when(F.col("side") == "base", F.col("partner")).otherwise(F.col("idx"))
    both = found.withColumns({"_base": own, "_comp": other}).join(shuffled(told(base, "base")), ["pair_id", "_base"], "left").join(shuffled(told(comp, "comp")), ["pair_id", "_comp"], "left")
    b, c, status = (lambda name: F.col(f"base.{name}")), (lambda name: F.col(f"comp.{name}")), F.col("status")
    kind = (
        F.when(status == "missing", "missing_content").when(status == "added", "added_content").when(b("kind").isin("key_value", "heading"), "value_mismatch").when(b("kind").isin("table_cell", "table_header"), "cell_changed").otherwise("text_changed")
    )
    signature = F.when(status == "missing", F.concat(F.lit("missing|"), b("key"))).when(status == "added", F.concat(F.lit("added|"), c("key"))).otherwise(F.concat_ws("|", F.lit("semantic"), b("key"), b("location")))
    place = lambda x: F.when(x("location") == "", "location unknown").otherwise(x("location"))
    parts = {"b_format": F.upper(b_format), "c_format": F.upper(c_format), "label": b("label"), "value": b("value"), "place": place(b), "c_label": c("label"), "c_value": c("value"), "c_place": place(c)}
    named = both.withColumn("difference_type", kind)
    return named.select(
        "pair_id", "side", "idx", "difference_type", signature.alias("location_signature"), F.coalesce(b("label"), c("label")).alias("location_label"), F.coalesce(b("value"), F.lit("")).alias("reference_text"),
        F.coalesce(c("value"), F.lit("")).alias("version_text"), sentence(parts).alias("description"),
    )
