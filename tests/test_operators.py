import random

from pyspark.sql import functions as F

from foliodiff.operators import fields, grouping, items, layout, report, residue, rules, sheets, text_diff

ITEM = "pair_id long, idx int, kind string, label string, value string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def side(spark, *values, pair=1):
    return spark.createDataFrame([(pair, i, *v) for i, v in enumerate(values)], ITEM)


def field(label, value):
    return ("field_value", label, value)


STANDARD = [("Account", "1000"), ("Customer", "Hollis Works"), ("Region", "South"), ("Status", "Active")]


def test_mutations(spark):
    base = side(spark, *(field(*x) for x in STANDARD))
    comp = side(spark, field("Account", "1000"), field("region", "North"), field("Status", "ACTIVE"), field("Account Manager", "Tove Lind"))
    found = items.difference_records(items.match_by_key(base, comp))
    assert rows(found, "difference_type", "location_signature", "reference_text", "version_text") == [
        ("added_content", "added|account manager", "", "Tove Lind"),
        ("missing_content", "missing|customer", "Hollis Works", ""),
        ("value_mismatch", "field_value|region|1", "South", "North"),
    ]


def test_occurrences_pair_in_order(spark):
    base = side(spark, field("A", "1"), field("A", "2"), field("A", "3"))
    comp = side(spark, field("a", "1"), field("a", "x"))
    assert rows(items.match_by_key(base, comp), "n", "status") == [(1, "identical"), (2, "changed"), (3, "missing")]
    assert items.match_by_key(base.limit(0), comp.limit(0)).count() == 0


def test_deduplicate(spark):
    got = items.deduplicate(side(spark, field("Account", "1000"), field("account", "10"), field("Account", "99"), ("paragraph", "p", " x  y"), ("paragraph", "p", "x y"), ("paragraph", "p", "z")))
    assert rows(got, "kind", "idx") == [("field_value", 1), ("paragraph", 3), ("paragraph", 5)]


def test_residue_phases(spark):
    base = side(spark, ("paragraph", "", "Account | 1000"), ("paragraph", "", "Customer Hollis Works"), ("paragraph", "", "Print Sequence:"), ("paragraph", "", "unrelated text"))
    comp = side(spark, field("Account", "1000"), field("Customer", "Hollis Works"), field("Print Sequence", "Product"), field("ü", "other"))
    got = residue.match_residue(base, comp)
    assert rows(got, "base_idx", "comp_idx") == [(0, 0), (1, 1), (2, 2)]
    assert residue.match_residue(base.limit(0), comp.limit(0)).count() == 0


def cells(spark, grid, doc=1, sheet="Ward", at=0):
    return spark.createDataFrame([(doc, at, sheet, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "doc long, sheet_idx int, sheet string, r int, c int, value string")


def test_sheets(spark):
    ref = cells(spark, [["Goods", "Amount"], ["Bread sold", "31415"], ["Cost", ""]])
    ver = cells(spark, [["Goods", "Value"], ["Bread sold", "27182"], ["Cost", " "], ["Tax", "3"]])
    assert rows(sheets.cell_changes(ref, ver), "address", "difference_type") == [("A4", "cell_changed"), ("B1", "header_changed"), ("B2", "cell_changed"), ("B4", "cell_changed")]
    assert rows(sheets.structure_changes(ref, ver), "difference_type", "n") == [("rows_added", 1)]
    assert rows(sheets.detect_header(ref), "has_header") == [(True,)]
    assert rows(sheets.detect_header(cells(spark, [["1", "2"], ["Account", "1000"]])), "has_header") == [(False,)]
    assert rows(sheets.table_items(cells(spark, [["Name", "Amount"], ["x", "1"], ["y", "2"]])), "key", "value") == [("amount", "1"), ("amount 1", "2"), ("name", "x"), ("name 1", "y")]
    other = cells(spark, [["a"]], sheet="Other")
    assert rows(sheets.align_sheets(ref, other), "sheet", "other", "how") == [("Ward", "Other", "renamed")]
    assert rows(sheets.align_sheets(ref, other.limit(0)), "how") == [("removed",)]


def test_fields_over_versions(spark):
    data = [(1, v, 0, "Manager", x) for v, x in enumerate(("Tove", "Tove", "Edda"))] + [(1, 1, 1, "New", "n"), (1, 2, 1, "New", "n"), (1, 0, 2, "Gone", "g"), (1, 1, 2, "Gone", "g")]
    got = fields.compare_versions(spark.createDataFrame(data, "group_id long, version int, ord int, label string, value string"), 3)
    assert [(r.key, list(r.kinds)) for r in got.orderBy("key").collect()] == [("gone", ["unchanged", "removed"]), ("manager", ["unchanged", "changed"])]


def test_fields_without_a_reference_value(spark):
    schema = "group_id long, version int, ord int, label string, value string"
    # only one version has the field: noise; two versions that disagree: a difference; an extra numbered record: a difference
    data = [(1, 1, 0, "Only", "v1"), (2, 1, 0, "Both", "x"), (2, 2, 0, "Both", "y"), (3, 1, 0, "Contact #2", "z"), (4, 0, 0, "Contact #2", "a"), (4, 1, 0, "Contact #2", "a"), (4, 2, 0, "Contact #2", "a"), (4, 1, 1, "Contact #2", "b")]
    got = fields.compare_versions(spark.createDataFrame(data, schema), 3)
    assert rows(got, "group_id", F.array_join("texts", "|")) == [(2, "x|y"), (3, "z|")]
    assert fields.compare_versions(spark.createDataFrame([], schema), 3).count() == 0


def test_text_entries(spark):
    lines = ["Total: 5", "  ", None, "A plain line", "Owner = Kim", "1. not a field: no", "Owner: Lee"]
    got = fields.text_entries(spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(lines)], "doc long, line_no int, line string"))
    assert rows(got, "ord", "key", "label", "value") == [
        (1, "total", "Total", "5"), (4, "text#0", "Text · Line 4", "A plain line"), (5, "owner", "Owner", "Kim"), (6, "text#1", "Text · Line 6", "1. not a field: no"), (7, "owner", "Owner", "Lee"),
    ]


def test_sheet_presence_and_headers(spark):
    def sheets_of(*names):
        return spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "doc long, pos int, sheet string")

    assert rows(fields.sheet_presence(sheets_of("A", "B", "C"), sheets_of("A", "X")), "difference_type", "sheet", "other") == [("sheet_removed", "C", ""), ("sheet_renamed", "B", "X")]
    assert rows(fields.sheet_presence(sheets_of("A", "B"), sheets_of("B")), "difference_type", "sheet", "other") == [("sheet_renamed", "A", "B")]
    assert rows(fields.sheet_presence(sheets_of("A"), sheets_of("A", "B")), "difference_type", "sheet") == [("sheet_added", "B")]
    assert fields.sheet_presence(sheets_of("A"), sheets_of("A").limit(0)).count() == 0
    ref, ver = cells(spark, [["Goods", "Amount", "7", ""], ["a", "b"]]), cells(spark, [["Goods", "Value", "8", "New"], ["x", "y"]])
    assert rows(fields.header_changes(ref, ver), "c", "old", "new") == [(1, "Amount", "Value")]


def test_severities_of_all_types(spark):
    code, severity = report.code_and_severity(F.col("x"))
    kinds = spark.createDataFrame([(x,) for x in ("font_mismatch", "image_removed", "exact_match", "something_new")], "x string")
    assert rows(kinds.select("x", code.alias("c"), severity.alias("s")), "x", "c", "s") == [
        ("exact_match", "MATCH", "Low"), ("font_mismatch", "FONT_MISMATCH", "Low"), ("image_removed", "IMAGE_REMOVED", "High"), ("something_new", "SOMETHING_NEW", "Medium"),
    ]


def test_grouping(spark):
    files = [f"Package 1/Non-Phi/{n}" for n in ("salesreport_2608041001.docx", "salesreport_2608041000.docx", "SalesReport_v10.docx", "salesreport_v9.csv", "customer_report.docx", "note.txt")]
    manifest = spark.createDataFrame([(f, 1, False) for f in files], "path string, size long, failed boolean")
    each = grouping.versions(grouping.documents(manifest))
    groups = grouping.group_documents(each)
    assert rows(groups, "stem", "n_docs", F.array_join("formats", ",")) == [("customer_report", 1, "docx"), ("salesreport", 4, "csv,docx")]
    assert rows(grouping.default_baseline(each), "stem", "baseline") == [("customer_report", "docx"), ("salesreport", "docx")]
    five = spark.createDataFrame([(f"d/r_v{i}.{e}", 1, False) for i, e in enumerate(("pdf", "rtf", "docx", "xls", "csv"))], "path string, size long, failed boolean")
    chain = grouping.comparison_chain(grouping.versions(grouping.documents(five)))
    assert [(r.baseline_format, r.comparing_format) for r in chain.orderBy("ord").collect()] == [("pdf", "rtf"), ("pdf", "docx"), ("docx", "xlsx"), ("xlsx", "csv")]


def test_rule_cascade(spark):
    base = spark.createDataFrame([(f"d{i}", a, "r", f"loc{i}", "l", "x", "value_mismatch", "exact", "old", "new") for i, a in enumerate(("A", "a ", "B", "B"))],
        "diff_id string, account string, group_label string, location_signature string, location_label string, doc_type string, difference_type string, comparison_mode string, reference_text string, version_text string")
    found = rules.fingerprints(base)
    keys = {r.diff_id: r for r in found.collect()}
    assert keys["d0"].account_hash == keys["d1"].account_hash != keys["d2"].account_hash and len(keys["d0"].location_hash) == 64
    made = spark.createDataFrame([("location", keys["d0"].location_key, "first", 1), ("location", keys["d0"].location_key, "second", 2), ("account", keys["d1"].account_key, "old", 1), ("account", keys["d1"].account_key, "newer", 2)], "scope string, key string, rule_id string, ord long")
    got = rules.apply_rules(found, made, spark.createDataFrame([("d2",)], "occurrence string"))
    assert rows(got, "diff_id", "ignored_scope", "rule_id") == [("d0", "location", "first"), ("d1", "account", "newer"), ("d2", "occurrence", None), ("d3", None, None)]
    assert rows(rules.visible(got, search="NEW"), "diff_id") == [("d3",)]


def test_layout(spark):
    glyphs = spark.createDataFrame([(1, 1, "ab", 60.0, 500.0), (1, 2, "cd", 140.0, 502.5), (1, 3, "x", 61.0, 499.9)], "doc long, ord int, str string, x double, y double")
    got = layout.rows_of(glyphs)
    assert rows(got, "ord", "row") == [(1, 0), (2, 0), (3, 1)]
    assert rows(layout.gap_threshold(got), "threshold") == [(80.0,)]
    columns = spark.createDataFrame([(1, 0, 60.0), (1, 1, 161.0)], "doc long, column int, x0 double")
    assert rows(layout.nearest_column(got, columns), "ord", "column") == [(1, 0), (2, -1), (3, 0)]


def test_edit_scripts():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        steps = text_diff.edit_script(a, b)
        gone = {i for op, i, _ in steps if op == "-"}
        added = {}
        for op, i, j in steps:
            if op == "+":
                added.setdefault(i, []).append(b[j])
        out = []
        for i in range(len(a) + 1):
            out += added.get(i, [])
            if i < len(a) and i not in gone:
                out.append(a[i])
        assert out == b
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert len(steps) == len(a) + len(b) - 2 * lcs[-1][-1]


def test_line_differences(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, None, ["n"])], "pair_id long, old array<string>, new array<string>")
    assert rows(text_diff.line_differences(pairs), "pair_id", "op", "line", "text") == [(1, "+", 2, "x"), (1, "+", 3, "d"), (1, "-", 2, "b"), (2, "+", 0, "n")]


def test_pipe_tables(spark):
    from foliodiff.operators import tables

    text = ["Field | Value | Note", "Region | South | x", "plain", "Account: 1 | y", "North | 12", "South | 13"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc long, line_no int, line string")
    blocks = tables.pipe_blocks(lines)
    assert rows(blocks.groupBy("block").count(), "block", "count") == [(1, 2), (2, 2)]
    assert rows(tables.block_items(blocks), "block", "key", "value") == [(1, "field", "Region"), (1, "note", "x"), (1, "value", "South"), (2, "north", "12"), (2, "south", "13")]


def test_tokens(spark):
    from foliodiff.operators import tokens

    assert spark.range(1).select(tokens.gathers(F.lit("Account: 1000, Region South"), F.array(F.lit("account 1000"), F.lit("Region | South"))).alias("x")).head()["x"]
    assert not spark.range(1).select(tokens.gathers(F.lit("Account 1000 extra"), F.array(F.lit("account 1000"))).alias("x")).head()["x"]


def test_report_and_workbooks(spark):
    from foliodiff.operators import report
    from foliodiff.sinks import workbook
    from foliodiff.sources.office import xlsx_cells

    diffs = spark.createDataFrame([("a", "p", "r", k, None if i % 2 else "global", "<x>", "o", "n", "d") for i, k in enumerate(("missing_content", "value_mismatch", "odd"))],
        "account string, package_name string, report string, difference_type string, ignored_scope string, location_label string, reference_text string, version_text string, description string")
    found = report.issues(diffs)
    assert rows(found, "code", "severity", "status") == [("MISSING_CONTENT", "High", "Ignored"), ("ODD", "Medium", "Ignored"), ("VALUE_MISMATCH", "Medium", "Reported")]
    assert rows(report.issue_rollup(found), "account", "n_issues") == [("(all)", 1), ("a", 1), ("a", 1), ("a", 1)]
    (book,) = workbook.workbooks(found).collect()
    cells = xlsx_cells(bytes(book.content))
    assert book.n_issues == 3 and {c[1] for c in cells} == {"Executive Summary", "Reported Issues"} and any(c[4] == "<x>" for c in cells)
    assert workbook.workbooks(found, rows=1).count() > 1
    assert "&lt;x&gt;" in workbook.page_rows(found).head()["html"]


def test_arrivals(spark, tmp_path):
    from foliodiff.streaming.arrivals import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.csv").write_bytes(b"a,b\n")
    query = arrivals(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        (tmp_path / "in" / "s.rtf").write_bytes(b"{\\rtf1 Hi}")
        query.processAllAvailable()
        assert sorted(r.content_type for r in spark.table("arrived").collect()) == ["sheet", "text"]
    finally:
        query.stop()
