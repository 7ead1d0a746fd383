"""Whole runs: claims of sheets, records of workbooks, pairs of files, numbered records, and runs that go on from earlier ones."""

import random

import pytest
from pyspark.sql import functions as F

from foliodiff.operators import grouping, numbering, report, run, sheets

CELLS = "doc long, sheet_idx int, sheet string, r int, c int, value string"


def book(doc, *named):
    return [(doc, i, name, r, c, v) for i, (name, grid) in enumerate(named) for r, row in enumerate(grid) for c, v in enumerate(row)]


def plain_claims(own, others):
    """Sheets by position: what each sheet of own claims, then what is left over."""
    taken, named, out = set(), set(), []
    for i, name in enumerate(own):
        at = next((j for j, other in enumerate(others) if other == name and name not in named and j not in taken), None)
        if at is not None:
            named.add(name)
        elif i < len(others) and i not in taken:
            at = i
        if at is not None:
            taken.add(at)
        out.append((i, name, at, "" if at is None else others[at], "removed" if at is None else "same" if others[at] == name else "renamed"))
    return out + [(None, "", j, other, "added") for j, other in enumerate(others) if j not in taken and j >= len(own)]


def test_claims(spark):
    rng = random.Random(4)
    books = [([rng.choice("ABS") for _ in range(rng.randrange(5))], [rng.choice("ABST") for _ in range(rng.randrange(5))]) for _ in range(150)]
    books += [(["A", "B"], ["B"]), (["S", "S"], ["S", "S"])]
    frames = [spark.createDataFrame([x for d, sides in enumerate(books) for x in book(d, *((name, [["v"]]) for name in sides[k]))], CELLS) for k in (0, 1)]
    got = sheets.align_sheets(*frames).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *c)) for d, sides in enumerate(books) for c in plain_claims(*sides))
    of = lambda d: sorted((tuple(r)[1:] for r in got if r.doc == d), key=str)
    assert of(150) == [(0, "A", 0, "B", "renamed"), (1, "B", None, "", "removed")] and of(151) == [(0, "S", 0, "S", "same"), (1, "S", 1, "S", "same")]


def test_workbooks(spark):
    ref = book(1, ("Main", [["Name", "Sum"], ["a", "1"], ["b", ""]]), ("Gone", [["q"]])) + book(2, ("S", [["1"]]), ("S", [["2"]]))
    ver = book(1, ("Other", [["Name", "Total"], ["a", "2"], ["b", " "], ["c", "9", "z"]])) + book(2, ("S", [["1"]]), ("S", [["3"]]), ("New", [["e", None]]))
    got = {tuple(r) for r in sheets.compare_sheets(spark.createDataFrame(ref, CELLS), spark.createDataFrame(ver, CELLS)).select("doc", "difference_type", "location_signature", "reference_text", "version_text").collect()}
    assert got == {
        (1, "sheet_renamed", "sheet|Main|name", "Main", "Other"), (1, "sheet_removed", "sheet|Gone", "1 rows × 1 cols", "(sheet not present)"), (1, "cell_changed", "sheet|Gone|A1", "q", ""),
        (1, "rows_added", "sheet|Main|rows", "3 rows", "4 rows (+1)"), (1, "cols_added", "sheet|Main|cols", "2 columns", "3 columns (+1)"), (1, "header_changed", "sheet|Main|header|B1", "Sum", "Total"),
        (1, "cell_changed", "sheet|Main|B2", "1", "2"), (1, "cell_changed", "sheet|Main|A4", "", "c"), (1, "cell_changed", "sheet|Main|B4", "", "9"), (1, "cell_changed", "sheet|Main|C4", "", "z"),
        (2, "cell_changed", "sheet|S|A1", "2", "3"), (2, "sheet_added", "sheet|New", "(not present in reference)", "1 rows × 1 cols"),
    }
    none = spark.createDataFrame([], CELLS)
    assert sheets.compare_sheets(none, none).count() == 0


def test_items_of_workbooks(spark):
    cells = book(1, ("List", [["FIELD", "Value"], ["Owner", " Mara "], ["Town", ""]]), ("Table", [["Name", "Name", ""], ["x", "y", "z"]]), ("Validation", [["a", "b"], ["c", "d"]])) + book(2, ("One", [["Owner"], ["Mara"], ["Key: v"], ["12"]]), ("Grid", [["1", "2"]]))
    got = [tuple(r) for r in sheets.sheet_items(spark.createDataFrame(cells, CELLS)).orderBy("doc", "idx").collect()]
    assert got == [
        (1, 0, "field_value", "owner", "Owner", "Mara", "List · A2"), (1, 1, "field_value", "name", "Name", "x", "Table · A2"), (1, 2, "field_value", "name 1", "Name #1", "y", "Table · B2"), (1, 3, "field_value", "c", "C", "z", "Table · C2"),
        (2, 0, "field_value", "owner", "Owner", "Mara", "One · A1"), (2, 1, "field_value", "key", "Key", "v", "One · A3"), (2, 2, "table_cell", "cell_3_0", "A4", "12", "One · A4"),
        (2, 3, "table_cell", "cell_0_0", "A1", "1", "Grid · A1"), (2, 4, "table_cell", "cell_0_1", "B1", "2", "Grid · B1"),
    ]


FILES, LINES, GRID = "path string, size long, failed boolean, content_type string", "path string, line_no int, line string", "path string, sheet_idx int, sheet string, r int, c int, value string"


def folder(spark, **texts):
    """Frames of files: a list of lines is a text, a grid of rows is a workbook of one sheet, None is a file that failed."""
    files, lines, cells = [], [], []
    for name, body in texts.items():
        path = name.replace("__", "/").replace("_DOT_", ".")
        grid = body and isinstance(body[0], list)
        files.append((path, 1, body is None, None if body is None else "sheet" if grid else "text"))
        lines += [] if grid or body is None else [(path, i, x) for i, x in enumerate(body)]
        cells += [(path, 0, "Sheet1", r, c, v) for r, row in enumerate(body) for c, v in enumerate(row)] if grid else []
    return [spark.createDataFrame(rows, schema) for rows, schema in ((files, FILES), (lines, LINES), (cells, GRID))]


SETS = {
    "a__r_v1_DOT_docx": ["Owner: Mara", "Rate: 5", "Only here: yes", "Some plain words"],
    "a__r_v2_DOT_rtf": ["Owner: Olaf", "Rate: 5", "Newer: 1", "Some plain words"],
    "a__r_v1_DOT_xlsx": [["Field", "Value"], ["Owner", "Mara"], ["Rate", "6"], ["Only here", "yes"]],
    "a__r_v1_DOT_csv": [["Field", "Value"], ["Owner", "Mara"], ["Rate", "6"], ["Only here", "no"]],
    "b__t_v1_DOT_docx": ["first", "second", "third"],
    "b__t_v2_DOT_docx": ["first", "2nd", "third", "fourth"],
    "c__w_v1_DOT_xlsx": [["Name", "n"], ["x", "1"]],
    "c__w_v2_DOT_xlsx": [["Name", "n"], ["x", "2"]],
    "d__m_v1_DOT_pdf": ["Total: 5", "Left: a"],
    "d__m_v1_DOT_csv": [["Field", "Value"], ["Total", "7"], ["Left", "a"]],
    "e__alone_DOT_docx": ["Owner: Mara"],
    "e__lost_v1_DOT_docx": None,
    "e__lost_v2_DOT_docx": ["x"],
}


def told(records):
    return [(r.number, r.dir, r.baseline_format, r.comparing_format, r.difference_type, r.location_signature, r.reference_text, r.version_text) for r in records.orderBy("number").collect()]


def test_run(spark):
    records = run.compare_run(*folder(spark, **SETS))
    got = told(records)
    assert [r[0] for r in got] == list(range(1, len(got) + 1))
    assert {r[1:] for r in got} == {
        ("a", "docx", "rtf", "value_mismatch", "field_value|owner|Line 1", "Mara", "Olaf"), ("a", "docx", "rtf", "missing_content", "missing|only here", "yes", ""), ("a", "docx", "rtf", "added_content", "added|newer", "", "1"),
        ("a", "docx", "xlsx", "value_mismatch", "field_value|rate|Line 2", "5", "6"),
        ("a", "xlsx", "csv", "value_mismatch", "field_value|only here|Sheet1 · A4", "yes", "no"), ("a", "xlsx", "csv", "cell_changed", "sheet|Sheet1|B4", "yes", "no"),
        ("b", "docx", "docx", "text_changed", "L2", "second", "2nd"), ("b", "docx", "docx", "text_changed", "after-L3", "", "fourth"),
        ("c", "xlsx", "xlsx", "cell_changed", "sheet|Sheet1|B2", "1", "2"),
        ("d", "pdf", "csv", "cell_changed", "field|total|1", "5", "7"),
    }
    said = records.filter("location_signature = 'field_value|owner|Line 1'").first().description
    assert said.startswith('The baseline DOCX contains the field "Owner" with the value "Mara". The comparing RTF') and said.endswith("Baseline location: Line 1. Comparing location: Line 1.")


def test_chosen_baseline(spark):
    files, lines, cells = folder(spark, **SETS)
    chosen = spark.createDataFrame([("a", "R", "xlsx")], "dir string, stem string, baseline string")
    got = {(r.baseline_format, r.comparing_format) for r in run.pairs_of(files, chosen).filter("dir = 'a'").collect()}
    assert got == {("xlsx", "csv")}


def test_runs_go_on(spark, tmp_path, monkeypatch):
    store = run.RunStore(spark, f"{tmp_path}/store")
    first = told(store.run(*folder(spark, **SETS)))
    assert first == told(run.compare_run(*folder(spark, **SETS)))
    compared = []
    whole = run.compare_run
    monkeypatch.setattr(run, "compare_run", lambda files, *rest: compared.append({r.path for r in files.collect()}) or whole(files, *rest))
    changed = SETS | {"b__t_v2_DOT_docx": ["first", "second", "3rd"], "e__alone_v2_DOT_rtf": ["Owner: Olaf"]}
    del changed["c__w_v2_DOT_xlsx"]
    second = told(store.run(*folder(spark, **changed)))
    monkeypatch.undo()
    assert second == told(run.compare_run(*folder(spark, **changed))) != first
    assert compared == [{"b/t_v1.docx", "b/t_v2.docx", "c/w_v1.xlsx", "e/alone.docx", "e/alone_v2.rtf"}]
    # a run that broke off before its records were whole does not count
    (tmp_path / "store" / "3" / "manifest").mkdir(parents=True)
    assert told(run.RunStore(spark, f"{tmp_path}/store").records()) == second


def test_a_run_takes_the_disk_of_one_step(spark, monkeypatch):
    """Items are read and compared in slices; of all that a run writes on its way, only the numbered records are left, and no shuffle files."""
    from pathlib import Path

    from foliodiff import durable

    monkeypatch.setattr(run, "SLICE_ROWS", 9)
    shared = Path(durable.shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    records = run.compare_run(*folder(spark, **{name: SETS[name] for name in ("a__r_v1_DOT_docx", "a__r_v2_DOT_rtf", "a__r_v1_DOT_xlsx", "b__t_v1_DOT_docx", "b__t_v2_DOT_docx")}))
    left = set(shared.iterdir()) - before
    assert {Path(f).parent.name for f in records.inputFiles()} == {f.name for f in left} and len(left) == 1
    assert [r[1:] for r in told(records)] == [
        ("a", "docx", "rtf", "value_mismatch", "field_value|owner|Line 1", "Mara", "Olaf"), ("a", "docx", "rtf", "missing_content", "missing|only here", "yes", ""), ("a", "docx", "rtf", "added_content", "added|newer", "", "1"),
        ("a", "docx", "xlsx", "value_mismatch", "field_value|rate|Line 2", "5", "6"),
        ("b", "docx", "docx", "text_changed", "L2", "second", "2nd"), ("b", "docx", "docx", "text_changed", "after-L3", "", "fourth"),
    ]


def test_steps_keep_what_they_are_told_to(spark):
    from foliodiff.durable import steps, written

    with steps(spark) as keep:
        with steps(spark) as keep_inner:
            gone, passed, kept = (written(spark.range(n)) for n in (1, 2, 3))
            keep_inner(passed.union(kept))
        keep(kept)
    assert kept.count() == 3
    for df in (gone, passed):
        with pytest.raises(Exception, match="(?i)not.?found|not.?exist"):
            df.count()


def test_empty_run(spark):
    none = folder(spark)
    assert run.compare_run(*none).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice("abc"), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(parts)
    got = numbering.numbered(df, "g", F.desc("x"), "id")
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], -r[2], r[0]))]
    assert [(r.number, r.id) for r in got.orderBy("number").collect()] == list(enumerate(want, 1)) and got.columns == ["id", "g", "x", "number"]
    assert numbering.numbered(df.limit(0), "id").count() == 0


def test_errors_stand_at_the_nearest_group(spark):
    docs = spark.createDataFrame([("a/p/q/x_v2.docx", "bad"), ("a/p/y.rtf", ""), ("z/w.csv", "odd"), ("a/p/ok.csv", None)], "path string, error string")
    groups = spark.createDataFrame([("a/p", "a", "p", ""), ("a", "a", None, None)], "dir string, account string, package_name string, category string")
    assert {tuple(r) for r in report.error_rows(docs, groups).collect()} == {
        ("a", "p", "", "x", "x_v2.docx", "ParseError", "bad"), ("a", "p", "", "y", "y.rtf", "ParseError", "Unknown error"), ("(root)", "(root)", "", "w", "w.csv", "ParseError", "odd"),
    }


def test_figures_of_a_run(spark):
    from pyspark.sql import Observation

    docs = spark.createDataFrame([("x", False), ("x", False), ("y", True)], "account string, failed boolean")
    groups = spark.createDataFrame([(2,), (1,), (3,)], "n_comparable int")
    diffs = spark.createDataFrame([("a", "Reported"), ("a", "Ignored"), ("b", "Reported")], "difference_type string, status string")
    row = report.run_stats(docs, groups, diffs).first().asDict()
    assert row == {"files": 3, "parsed": 2, "failed": 1, "accounts": 2, "groups": 3, "comparable_groups": 2, "comparisons": 4, "differences": 3, "matches": 1, "ignored": 1, "types": {"a": 2, "b": 1}}
    assert report.run_stats(docs.limit(0), groups.limit(0), diffs.limit(0)).first()["types"] == {}
    seen = Observation()
    report.measured(diffs, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "differences": 3} and report.rates(4, 3, 2.0) == {"total_processing_ms": 2000.0, "files_per_second": 2.0, "comparisons_per_second": 1.5}


def test_first_names_of_a_level(spark):
    docs = spark.createDataFrame([(f"r/n{i:02}",) for i in range(30)] + [("r",)], "dir string")
    assert {tuple(r) for r in grouping.level_histogram(docs, shown=3).collect()} == {(1, 1, "r", 0), (2, 30, "n00,n01,n02", 27)}


def test_all_names_of_a_level(spark):
    docs = spark.createDataFrame([(f"r/n{i:02}",) for i in range(30)] * 2 + [("r",)], "dir string")
    assert {tuple(r) for r in grouping.level_histogram(docs).collect()} == {(1, 1, "r"), (2, 30, ",".join(f"n{i:02}" for i in range(30)))}
