"""Spreadsheets as cells (doc, sheet_idx, sheet, r, c, value), 0-based. An empty value is no cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.functions.pairs import COLON
from foliodiff.functions.text import cell_address, column_index, column_letters, is_numeric, normalize_key

SHEET = ["doc", "sheet_idx", "sheet"]
BLANK = " \t\r\n\f\x0b"
#: A row that may be a label.
LABEL_ROW = r"^[A-Za-z]+(?: [A-Za-z]+)*$"


def filled(cells: DataFrame) -> DataFrame:
    return cells.filter(F.btrim(F.coalesce("value", F.lit("")), F.lit(" \t\r\n\f\x0b")) != "")


def comparable_sheets(cells: DataFrame) -> DataFrame:
    """Without sheets of notes on the comparison itself."""
    return cells.filter(~F.lower("sheet").contains("validation") & ~F.lower("sheet").contains("notes"))


def detect_header(cells: DataFrame) -> DataFrame:
    """(sheet, has_header): row 0 has two filled cells or more, the first starts with a letter, and none is a number."""
    row = filled(cells).filter("r = 0")
    first = F.min(F.struct("c", "value"))["value"]
    return row.groupBy(*SHEET).agg(((F.count("*") >= 2) & first.rlike("^[ \t]*[A-Za-z]") & ~F.bool_or(is_numeric(F.col("value")))).alias("has_header"))


def grid_items(cells: DataFrame) -> DataFrame:
    """Every filled cell as an item that is known by its address."""
    return filled(cells).select(*SHEET, "r", "c", F.concat(F.lit("cell_"), "r", F.lit("_"), "c").alias("key"), cell_address(F.col("r"), F.col("c")).alias("label"), "value")


def table_items(cells: DataFrame) -> DataFrame:
    """Filled cells below the header as (header, value); the n-th value of a header after the first is marked `#n`."""
    some = filled(cells)
    head = some.filter("r = 0").select(*SHEET, "c", F.col("value").alias("header"))
    named = some.filter("r > 0").join(head, [*SHEET, "c"], "left").withColumn("header", F.coalesce("header", column_letters(F.col("c"))))
    n = F.row_number().over(W.partitionBy(*SHEET, "header").orderBy("r", "c")) - 1
    return named.withColumn("n", n).select(
        *SHEET, "r", "c", normalize_key(F.when(F.col("n") > 0, F.concat("header", F.lit(" #"), "n")).otherwise(F.col("header"))).alias("key"), "header", "value"
    )


def used_size(cells: DataFrame) -> DataFrame:
    """(sheet, n_rows, n_cols) up to the last filled cell."""
    return cells.filter("value <> ''").groupBy(*SHEET).agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))


def structure_changes(ref: DataFrame, ver: DataFrame) -> DataFrame:
    """Rows and columns that a sheet gained or lost, one record each."""
    a = used_size(ref).select("doc", "sheet", F.col("n_rows").alias("ar"), F.col("n_cols").alias("ac"))
    b = used_size(ver).select("doc", "sheet", F.col("n_rows").alias("br"), F.col("n_cols").alias("bc"))
    both = a.join(b, ["doc", "sheet"])
    kinds = F.array(
        F.struct(F.when(F.col("br") > F.col("ar"), "rows_added").when(F.col("br") < F.col("ar"), "rows_removed").alias("difference_type"), F.abs(F.col("br") - F.col("ar")).alias("n")),
        F.struct(F.when(F.col("bc") > F.col("ac"), "cols_added").when(F.col("bc") < F.col("ac"), "cols_removed").alias("difference_type"), F.abs(F.col("bc") - F.col("ac")).alias("n")),
    )
    return both.select("doc", "sheet", F.inline(kinds)).filter("difference_type IS NOT NULL")


def cell_changes(ref: DataFrame, ver: DataFrame) -> DataFrame:
    """A full outer join on addresses of the filled cells only; a header cell is a header change if it holds text on both sides."""
    keys = ["doc", "sheet", "r", "c"]
    a = ref.filter("value <> ''").select(*keys, F.col("value").alias("old"))
    b = ver.filter("value <> ''").select(*keys, F.col("value").alias("new"))
    both = a.join(b, keys, "full_outer").na.fill("", ["old", "new"]).filter(F.col("old") != F.col("new"))
    blank = F.btrim("new", F.lit(" \t\r\n\f\x0b")) == ""
    header = (F.col("r") == 0) & (F.btrim("old", F.lit(" ")) != "") & ~is_numeric(F.col("old")) & ~blank
    return both.filter(~((F.col("old") == "") & blank)).select(
        "doc", "sheet", cell_address(F.col("r"), F.col("c")).alias("address"), F.when(header, "header_changed").otherwise("cell_changed").alias("difference_type"), "old", "new"
    )


def align_sheets(ref: DataFrame, ver: DataFrame) -> DataFrame:
    """(doc, sheet_idx, sheet, other_idx, other, how) of every reference sheet, and of sheets that the version has beyond them.

    In the order of the reference, a sheet claims the first unclaimed sheet of its name, once a name, else the unclaimed one at its
    position (`renamed` if the names differ), else none (`removed`). Version sheets that no one claimed are `added` if they stand behind as many sheets as the
    reference has. So a sheet is claimed once, and of several sheets with one name each has its own row. The fold goes over the names of one workbook's sheets.
    """
    listed = lambda side, name: side.select(*SHEET).distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sheet_idx", "sheet"))).alias(name))
    none = F.array().cast("array<struct<sheet_idx:int,sheet:string>>")
    both = listed(ref, "own").join(listed(ver, "others"), "doc", "full_outer").select("doc", F.coalesce("own", none).alias("own"), F.coalesce("others", none).alias("others"))

    def claim(state: Column, sheet: Column) -> Column:
        free = F.filter("others", lambda o: ~F.array_contains(state["taken"], o["sheet_idx"]))
        named = F.get(F.filter(free, lambda o: (o["sheet"] == sheet["sheet"]) & ~F.array_contains(state["names"], o["sheet"])), F.lit(0))
        found = F.coalesce(named, F.get(F.filter(free, lambda o: o["sheet_idx"] == sheet["sheet_idx"]), F.lit(0)))
        how = F.when(found.isNull(), "removed").when(found["sheet"] == sheet["sheet"], "same").otherwise("renamed")
        row = F.struct(sheet["sheet_idx"].alias("sheet_idx"), sheet["sheet"].alias("sheet"), found["sheet_idx"].alias("other_idx"), F.coalesce(found["sheet"], F.lit("")).alias("other"), how.alias("how"))
        return F.struct(
            F.when(found.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(found["sheet_idx"]))).alias("taken"),
            F.when(named.isNull(), state["names"]).otherwise(F.concat(state["names"], F.array(sheet["sheet"]))).alias("names"),
            F.concat(state["rows"], F.array(row)).alias("rows"),
        )

    row_type = "struct<sheet_idx:int,sheet:string,other_idx:int,other:string,how:string>"
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("names"), F.array().cast(f"array<{row_type}>").alias("rows"))
    claimed = both.withColumn("claims", F.aggregate("own", start, claim))
    extra = F.filter("others", lambda o: ~F.array_contains(F.col("claims.taken"), o["sheet_idx"]) & (o["sheet_idx"] >= F.size("own")))
    added = F.transform(extra, lambda o: F.struct(F.lit(None).cast("int").alias("sheet_idx"), F.lit("").alias("sheet"), o["sheet_idx"].alias("other_idx"), o["sheet"].alias("other"), F.lit("added").alias("how")).cast(row_type))
    return claimed.select("doc", F.inline(F.concat("claims.rows", added)))


def compare_sheets(ref: DataFrame, ver: DataFrame) -> DataFrame:
    """(doc, difference_type, location_signature, location_label, sheet, address, reference_text, version_text): all differences of two workbooks.

    Sheets renamed, added and removed by align_sheets; rows and columns that matched sheets gained or lost; cells, where a text in the first row
    that has another text now is a changed header. A removed sheet loses its cells too. Empty and missing cells are the same. sheet and address are null where none is meant.
    Cells meet by one full outer join of filled cells on (doc, sheet, row, column), so a workbook of any size spreads by its cells. Null values are
    empty; an empty side gives added or removed sheets.
    """
    ref, ver = (side.withColumn("value", F.coalesce("value", F.lit(""))) for side in (ref, ver))
    claims = align_sheets(ref, ver)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    none, name = F.lit(None).cast("string"), F.col("sheet")
    quoted = lambda c: text("Sheet “", c, "”")

    size = used_size(ref).select("doc", "sheet_idx", F.col("n_rows").alias("ar"), F.col("n_cols").alias("ac"))
    other_size = used_size(ver).select("doc", F.col("sheet_idx").alias("other_idx"), F.col("n_rows").alias("br"), F.col("n_cols").alias("bc"))
    sized = claims.join(size, ["doc", "sheet_idx"], "left").join(other_size, ["doc", "other_idx"], "left").na.fill(0, ["ar", "ac", "br", "bc"])

    def record(kind: str, when: Column, signature: Column, label: Column, sheet: Column, old: Column, new: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("difference_type"), signature.alias("location_signature"), label.alias("location_label"), sheet.alias("sheet"), none.alias("address"), old.alias("reference_text"), new.alias("version_text")))

    how, other, matched = F.col("how"), F.col("other"), F.col("how").isin("same", "renamed")
    extent = lambda rows, cols: text(F.col(rows), " rows × ", F.col(cols), " cols")
    changes = []
    for word, unit, a, b, gained, lost in (("rows", "rows", "ar", "br", "rows appended", "rows removed"), ("cols", "columns", "ac", "bc", "columns added", "columns removed")):
        old, new = F.col(a), F.col(b)
        for kind, when, label, sign in ((f"{word}_added", new > old, gained, "+"), (f"{word}_removed", new < old, lost, "−")):
            changes.append(record(kind, matched & when, text("sheet|", name, f"|{word}"), text(quoted(name), f" · {label}"), none, text(old, f" {unit}"), text(new, f" {unit} ({sign}", F.abs(new - old), ")")))
    by_sheet = F.array(
        record("sheet_renamed", how == "renamed", text("sheet|", name, "|name"), text(quoted(name), " · name differs"), name, name, other),
        record("sheet_added", how == "added", text("sheet|", other), text(quoted(other), " added"), none, F.lit("(not present in reference)"), extent("br", "bc")),
        record("sheet_removed", how == "removed", text("sheet|", name), text(quoted(name), " removed"), none, extent("ar", "ac"), F.lit("(sheet not present)")),
        *changes,
    )
    of_sheets = sized.select("doc", F.inline(F.filter(by_sheet, lambda x: x.isNotNull())))

    at = ["doc", "sheet_idx", "r", "c"]
    a = ref.filter("value <> ''").select(*at, F.col("value").alias("old"))
    place = claims.filter(matched).select("doc", "sheet_idx", "other_idx")
    b = ver.filter("value <> ''").select("doc", F.col("sheet_idx").alias("other_idx"), "r", "c", F.col("value").alias("new")).join(place, ["doc", "other_idx"]).select(*at, "new")
    cells = a.join(b, at, "full_outer").na.fill("", ["old", "new"]).filter("old <> new")
    blank = F.btrim("new", F.lit(BLANK)) == ""
    header = (F.col("r") == 0) & (F.btrim("old", F.lit(BLANK)) != "") & ~is_numeric(F.col("old")) & ~blank
    names = claims.filter("sheet_idx IS NOT NULL").select("doc", "sheet_idx", "sheet")
    address = cell_address(F.col("r"), F.col("c"))
    told = cells.filter(~((F.col("old") == "") & blank)).join(names, ["doc", "sheet_idx"]).withColumns({"address": address, "header": header})
    of_cells = told.select(
        "doc", F.when(F.col("header"), "header_changed").otherwise("cell_changed").alias("difference_type"),
        F.when(F.col("header"), text("sheet|", name, "|header|", F.col("address"))).otherwise(text("sheet|", name, "|", F.col("address"))).alias("location_signature"),
        F.when(F.col("header"), text(quoted(name), " · Column “", F.col("old"), "”")).otherwise(text(quoted(name), " · ", F.col("address"))).alias("location_label"),
        "sheet", "address", F.col("old").alias("reference_text"), F.col("new").alias("version_text"),
    )
    return of_sheets.unionByName(of_cells)


def sheet_items(cells: DataFrame) -> DataFrame:
    """Items (doc, idx, kind, key, label, value, location) of workbooks, the same for every layout; idx counts from 0 in reading order.

    A sheet headed `Field`, `Value` lists fields; one with another header row is read by columns; of the rest, sheets of one column are read as
    labels and values, and others cell by cell. Sheets of notes on the comparison are left out. cells is read several times: write what is costly to derive.
    """
    cells = comparable_sheets(cells)
    headers = detect_header(cells).filter("has_header").select(*SHEET)
    headed, bare = cells.join(headers, SHEET, "left_semi"), cells.join(headers, SHEET, "left_anti")
    top = filled(headed).filter("r = 0 AND c < 2").groupBy(*SHEET).agg(F.max(F.when(F.col("c") == 0, F.lower(F.btrim("value", F.lit(BLANK))))).alias("a"), F.max(F.when(F.col("c") == 1, F.lower(F.btrim("value", F.lit(BLANK))))).alias("b"))
    listing = top.filter("a = 'field' AND b = 'value'").select(*SHEET)
    wide = filled(bare).groupBy(*SHEET).agg(F.max("c").alias("last")).filter("last > 0").select(*SHEET)
    a1 = cell_address(F.col("r"), F.col("c"))
    trimmed = F.btrim("value", F.lit(BLANK)).alias("value")
    field = F.lit("field_value").alias("kind")
    n = F.when(F.col("n") > 0, F.concat("header", F.lit(" #"), "n")).otherwise(F.col("header"))
    by_column = table_items(headed.join(listing, SHEET, "left_anti")).withColumn("n", F.row_number().over(W.partitionBy(*SHEET, "header").orderBy("r", "c")) - 1)
    parts = [
        pair_table_items(headed).select(*SHEET, "r", F.lit(0).alias("c"), field, "key", "label", "value"),
        by_column.select(*SHEET, "r", "c", field, "key", F.btrim(n, F.lit(BLANK)).alias("label"), trimmed),
        single_column_items(bare).select(*SHEET, "r", F.lit(0).alias("c"), "kind", "key", "label", "value"),
        grid_items(bare.join(wide, SHEET, "left_semi")).select(*SHEET, "r", "c", F.lit("table_cell").alias("kind"), "key", "label", trimmed),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    idx = F.row_number().over(W.partitionBy("doc").orderBy("sheet_idx", "r", "c")) - 1
    return every.select("doc", idx.alias("idx"), "kind", "key", "label", "value", F.concat("sheet", F.lit(" · "), a1).alias("location"))


def pair_table_items(cells: DataFrame) -> DataFrame:
    """(sheet, r, key, label, value) of sheets headed `Field`, `Value`: one field a row whose first two cells are filled.

    The header's case does not matter. Cells are trimmed; empty and null ones are no cells. Other sheets give nothing.
    """
    some = filled(cells).filter("c < 2").withColumn("value", F.btrim("value", F.lit(BLANK)))
    rows = some.groupBy(*SHEET, "r").agg(F.max(F.when(F.col("c") == 0, F.col("value"))).alias("label"), F.max(F.when(F.col("c") == 1, F.col("value"))).alias("value"))
    headed = rows.filter((F.col("r") == 0) & (F.lower("label") == "field") & (F.lower("value") == "value")).select(*SHEET)
    pairs = rows.filter("r > 0 AND label IS NOT NULL AND value IS NOT NULL").join(headed, SHEET, "left_semi")
    return pairs.select(*SHEET, "r", normalize_key(F.col("label")).alias("key"), "label", "value")


def single_column_items(cells: DataFrame) -> DataFrame:
    """(sheet, r, kind, key, label, value) of sheets with cells in the first column only.

    A short row of letters and the row just below it, if short and without colon and pipe, are a field; rows are paired from
    the top, so in a run of rows that may all be labels every other one is. Of other rows, `Label: value` is a field, and
    the rest are cells known by address. Windows over one sheet's filled rows, no Python.
    """
    some = filled(cells).withColumn("value", F.btrim("value", F.lit(BLANK)))
    narrow = some.groupBy(*SHEET).agg(F.max("c").alias("last")).filter("last = 0").select(*SHEET)
    rows = some.join(narrow, SHEET, "left_semi")
    w = W.partitionBy(*SHEET).orderBy("r")
    below = F.when(F.lead("r").over(w) == F.col("r") + 1, F.lead("value").over(w))
    may_value = (F.length(below) < 50) & ~below.contains(":") & ~below.contains("|")
    starts = F.coalesce((F.length("value") < 30) & F.col("value").rlike(LABEL_ROW) & may_value, F.lit(False))
    marked = rows.withColumns({"_below": below, "_starts": starts})
    fresh = ~F.col("_starts") | ~F.coalesce(F.lag("_starts").over(w) & (F.lag("r").over(w) == F.col("r") - 1), F.lit(False))
    run = marked.withColumn("_run", F.sum(fresh.cast("int")).over(w))
    nth = F.row_number().over(W.partitionBy(*SHEET, "_run").orderBy("r"))
    picked = run.withColumn("_label", F.col("_starts") & (nth % 2 == 1))
    used = F.coalesce(F.lag("_label").over(w) & (F.lag("r").over(w) == F.col("r") - 1), F.lit(False))
    left = picked.withColumn("_used", used).filter("NOT _used")
    colon = ~F.col("_label") & F.col("value").rlike(COLON)
    label = F.when(F.col("_label"), F.col("value")).when(colon, F.btrim(F.regexp_extract("value", COLON, 1), F.lit(BLANK)))
    value = F.when(F.col("_label"), F.col("_below")).when(colon, F.btrim(F.regexp_extract("value", COLON, 2), F.lit(BLANK))).otherwise(F.col("value"))
    is_field = F.col("_label") | colon
    return left.select(
        *SHEET, "r", F.when(is_field, "field_value").otherwise("table_cell").alias("kind"), F.when(is_field, normalize_key(label)).otherwise(F.concat(F.lit("cell_"), "r", F.lit("_0"))).alias("key"),
        F.coalesce(label, cell_address(F.col("r"), F.col("c"))).alias("label"), value.alias("value"),
    )


def sheet_lines(cells: DataFrame) -> DataFrame:
    """(doc, line_no, line): workbooks as text. A line `[name]` opens each sheet; its rows follow, cells joined by tabs, without empty ones at the end.

    Rows up to the last filled one are told, empty ones too; line numbers count from 0. One row is one value, a sheet never is. Rows that have no cell are made from the
    next filled row's distance to the one before it.
    """
    some = cells.filter("value <> ''")
    rows = some.groupBy(*SHEET, "r").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("x"))
    width = F.array_max(F.transform("x", lambda v: v["c"]))
    places = F.map_from_entries("x")
    line = F.array_join(F.transform(F.sequence(F.lit(0), width), lambda c: F.coalesce(F.element_at(places, c), F.lit(""))), "\t")
    before = F.coalesce(F.lag("r").over(W.partitionBy(*SHEET).orderBy("r")), F.lit(-1))
    gaps = rows.select(*SHEET, "r", line.alias("line"), (F.col("r") - before - 1).alias("gap"))
    filled_in = gaps.select(*SHEET, "r", F.explode(F.concat(F.array_repeat(F.lit(""), F.col("gap")), F.array("line"))).alias("line"), "gap").withColumn("at", F.row_number().over(W.partitionBy(*SHEET, "r").orderBy(F.col("line") != "")))
    names = cells.select(*SHEET).distinct().select(*SHEET, F.lit(-1).alias("r"), F.concat(F.lit("["), "sheet", F.lit("]")).alias("line"), F.lit(0).alias("at"))
    every = filled_in.select(*SHEET, "r", "line", "at").unionByName(names)
    number = F.row_number().over(W.partitionBy("doc").orderBy("sheet_idx", "sheet", "r", "at")) - 1
    return every.select("doc", number.alias("line_no"), "line")


def cell_locations(records: DataFrame, ref: DataFrame) -> DataFrame:
    """records of compare_sheets with location: of a changed cell its sheet and the header of its column, else the first filled cell of its row, else its address; of others their label.

    Headers and first cells come from the reference by two many-to-one joins.
    """
    letters, number = F.regexp_extract("address", "^([A-Z]+)", 1), F.regexp_extract("address", "([0-9]+)$", 1)
    at = records.withColumns({"_c": F.when(F.col("address").isNotNull(), column_index(letters)), "_r": F.when(F.col("address").isNotNull(), number.cast("int") - 1)})
    some = filled(ref).withColumn("_text", F.btrim("value", F.lit(BLANK)))
    one = some.groupBy("doc", "sheet", "c", "r").agg(F.min(F.struct("sheet_idx", "_text"))["_text"].alias("_text"))  # of sheets with one name the first
    heads = one.filter("r = 0").select("doc", "sheet", F.col("c").alias("_c"), F.col("_text").alias("_head"))
    firsts = one.groupBy("doc", "sheet", F.col("r").alias("_r")).agg(F.min(F.struct("c", "_text"))["_text"].alias("_first"))
    found = at.join(heads, ["doc", "sheet", "_c"], "left").join(firsts, ["doc", "sheet", "_r"], "left")
    told = F.concat("sheet", F.lit(" → "), F.coalesce("_head", "_first", "address"))
    return found.withColumn("location", F.when((F.col("difference_type") == "cell_changed") & F.col("address").isNotNull(), told).otherwise(F.col("location_label"))).drop("_c", "_r", "_head", "_first")
