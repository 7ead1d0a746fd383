"""Elements of texts for the older engine against a plain reading of the same rules; smaller parts of reports."""

import random
import re

from pyspark.sql import functions as F

from foliodiff.functions.text import stamp
from foliodiff.operators import elements, fields, grouping, rules, sheets

LINES = "doc long, line_no int, line string"


def plain_turns(lines):
    name = lambda s: 0 < len(s) < 30 and re.fullmatch("[A-Za-z][A-Za-z ]*", s)
    texts = [x.strip() for x in lines]
    for i in range(len(texts) - 3):
        pairs = list(zip(texts[i + 2 :: 2], texts[i + 3 :: 2], strict=False))
        if name(texts[i]) and name(texts[i + 1]) and all(k and v and len(k) <= 50 and not re.fullmatch("[0-9.]+", k) for k, v in pairs):
            rows = [f"{k} | {v}" for k, v in [(texts[i], texts[i + 1]), *pairs]]
            return lines[:i] + rows + lines[i + 2 * len(rows) :]
    return lines


def plain_elements(lines):
    """(kind, label, value, line) of a text, tables first."""
    lines = [x.strip() for x in plain_turns(lines)]
    cells = [[c.strip() for c in x.split("|")] for x in lines]
    table = [sum(c != "" for c in row) >= 2 for row in cells]
    tables, rest = [], []
    for i, x in enumerate(lines):
        at = f"Line {i + 1}"
        if table[i]:
            if (i == 0 or not table[i - 1]) and all(re.match("[A-Za-z]", c) for c in cells[i]):
                tables.append(("prose", " | ".join(cells[i]), " | ".join(cells[i]), at))
            elif cells[i][0] and cells[i][1]:
                tables.append(("key_value", cells[i][0], cells[i][1], at))
        elif x and not re.fullmatch(r"[|\-+:]+", x):
            if m := re.match(r"#{1,6}[ \t]+(.+)$", x):
                rest.append(("heading", x, m[1].strip(), at))
            elif m := re.match(r"[-•*][ \t]+(.+)$", x):
                rest.append(("list_item", f"List item · {at}", m[1].strip(), at))
            elif m := re.match(r"([A-Za-z][A-Za-z0-9 _/().\-&'*]+)[ \t]*[:=][ \t]*(.+)$", x):
                rest.append(("key_value", m[1].strip(), m[2].strip(), at))
            else:
                rest.append(("prose", x, x, at))
    return tables + rest


def test_elements_of_random_texts(spark):
    rng = random.Random(2)
    stock = ["Field", "Value", "Town", "Oslo 1", "12", "", "a | b", "Key | 7 | x", "| x |", "Owner: Mara", "Rate = 5", "# Part", "- point", "---", "plain words 1", "x: y", " | Town | Size", "1.5", "Name\tx"]
    texts = [[rng.choice(stock[: rng.choice((5, 19))]) for _ in range(rng.randrange(10))] for _ in range(500)]
    rows = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t)]
    got = elements.text_elements(spark.createDataFrame(rows, LINES)).orderBy("doc", "idx").collect()
    assert [[(r.kind, r.label, r.value, r.location) for r in got if r.doc == d] for d in range(500)] == [plain_elements(t) for t in texts]
    assert sum(plain_turns(t) != t for t in texts) > 30
    numbered = [r.key.rpartition("#") for r in got if r.doc == next(d for d in range(500) if len(plain_elements(texts[d])) > 7)]
    assert [int(n) for _, mark, n in numbered if mark] == list(range(sum(bool(mark) for _, mark, _ in numbered)))


def test_stated_pairs(spark):
    rows = [("prose", "Region | South 1 | more"), ("prose", "Field | Value"), ("prose", "Sum: 5"), ("prose", "Sum = 6"), ("prose", "a | b: 1"), ("list_item", "Sum: 5"), ("prose", "words")]
    df = spark.createDataFrame([(1, i, k, f"text#{i}", v, v, "Line 1") for i, (k, v) in enumerate(rows)], "doc long, idx int, kind string, key string, label string, value string, location string")
    got = [(r.kind, r.key, r.label, r.value) for r in elements.with_stated_pairs(df).orderBy("idx").collect()]
    assert got == [
        ("key_value", "region", "Region", "South 1"), ("prose", "text#1", "Field | Value", "Field | Value"), ("key_value", "sum", "Sum", "5"), ("key_value", "sum", "Sum", "6"), ("key_value", "a", "a", "b: 1"),
        ("list_item", "text#5", "Sum: 5", "Sum: 5"), ("prose", "text#6", "words", "words"),
    ]


def test_records(spark):
    sides = [[(1, i, x) for i, x in enumerate(t)] for t in (["Owner: Mara", "Rate: 5", "old words"], ["Owner: Olaf", "Rate: 5", "new words", "# Part"])]
    base, comp = (elements.text_elements(spark.createDataFrame(s, LINES)).withColumnRenamed("doc", "pair_id") for s in sides)
    got = {(r.difference_type, r.location_signature, r.reference_text, r.version_text) for r in elements.element_records(base, comp, F.lit("docx"), F.lit("rtf")).collect()}
    assert got == {("value_mismatch", "semantic|owner|Line 1", "Mara", "Olaf"), ("missing_content", "missing|text#0", "old words", ""), ("added_content", "added|text#0", "", "new words"), ("added_content", "added|part", "", "Part")}


def test_nothing(spark):
    empty = spark.createDataFrame([], LINES)
    assert elements.text_elements(empty).count() == 0
    assert elements.text_elements(spark.createDataFrame([(1, 0, None), (1, 1, "  "), (1, 2, "|||")], LINES)).count() == 0


def test_sheets_as_lines(spark):
    cells = spark.createDataFrame([(1, 0, "A", 0, 0, "x"), (1, 0, "A", 0, 2, "z"), (1, 0, "A", 3, 1, "y"), (1, 0, "A", 5, 0, ""), (1, 1, "B", 0, 0, "")], "doc long, sheet_idx int, sheet string, r int, c int, value string")
    assert [(r.line_no, r.line) for r in sheets.sheet_lines(cells).orderBy("line_no").collect()] == [(0, "[A]"), (1, "x\t\tz"), (2, ""), (3, ""), (4, "\ty"), (5, "[B]")]


def test_places_of_cells(spark):
    schema = "doc long, sheet_idx int, sheet string, r int, c int, value string"
    ref = [(1, 0, "S", 0, 0, "Name"), (1, 0, "S", 1, 0, "x"), (1, 0, "S", 1, 1, "2"), (1, 0, "S", 2, 2, "k")]
    ver = [(1, 0, "S", 0, 0, "Name"), (1, 0, "S", 1, 0, "y"), (1, 0, "S", 1, 1, "3"), (1, 0, "S", 2, 2, "k"), (1, 0, "S", 7, 5, "new")]
    a, b = (spark.createDataFrame(x, schema) for x in (ref, ver))
    got = {r.address: r.location for r in sheets.cell_locations(sheets.compare_sheets(a, b), a).collect() if r.address}
    assert got == {"A2": "S → Name", "B2": "S → x", "F8": "S → F8"}


def test_filters_and_switches(spark):
    diffs = spark.createDataFrame([("a", "g1", "l", "x", "Oslo", "t1", None), ("b", "g1", "l", "x", "oslo", "t1", "report"), ("c", "g2", "l", "Oslo", "y", "t2", None)], "diff_id string, group_label string, location_label string, reference_text string, version_text string, difference_type string, ignored_scope string")
    ids = lambda **by: {r.diff_id for r in rules.visible(diffs, **by).collect()}
    assert ids(search="OSLO") == {"a", "c"} and ids(search="oslo", group="g1", show_ignored=True) == {"a", "b"} and ids(difference_type="t2") == {"c"}
    groups = spark.createDataFrame([("d", "a", 2), ("d", "b", 2), ("d", "c", 1), ("d", "e", 3)], "dir string, stem string, n_comparable int")
    switches = spark.createDataFrame([("d", "a", True), ("d", "b", False)], "dir string, stem string, enabled boolean")
    assert {r.stem for r in grouping.enabled_groups(groups, switches).collect()} == {"a", "e"}
    assert [(r.number, r.stem) for r in grouping.in_order(groups).orderBy("number").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "e")]
    kinds = spark.createDataFrame([(["unchanged", "removed", "changed"],)], "kinds array<string>")
    assert [(r.changed, r.kept) for r in fields.changed_and_kept(kinds).collect()] == [([2, 3], [1])]
    assert spark.range(1).select(stamp(F.timestamp_seconds(F.lit(86_399)))).first()[0] == "1970-01-01-23-59-59"


def test_stamps_of_far_years(spark):
    seconds = [(253_402_300_799, "9999-12-31-23-59-59"), (253_402_300_800, "10000-01-01-00-00-00"), (3_100_000_000_000, "100205-02-02-15-06-40"), (-62_135_596_800, "0001-01-01-00-00-00"), (-62_167_219_201, "-1-12-31-23-59-59"), (None, None)]
    rows = spark.createDataFrame(seconds, "s long, told string").select(stamp(F.timestamp_seconds("s")).alias("mine"), "told").collect()
    assert all(r.mine == r.told for r in rows)
