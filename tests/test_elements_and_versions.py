"""Matched elements and many text versions against plain loops; the rule store; the report tree."""

import random
import re
import uuid

from foliodiff.operators import report, rules, semantic, text_diff
from foliodiff.sinks import rule_store

ELEMENT = "pair_id long, idx int, kind string, label string, value string"


def words(v):
    return sorted(t for t in re.sub(r"[|;,\-_:=/\\\s]+", " ", (v or "").lower()).split(" ") if t)


def same(v):
    return re.sub(r"[|;,\-_:=/\\\s]+", " ", (v or "").lower()).strip()


def key(s):
    return re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()


def plain_match(base, comp):
    """Element by element, first fit, phase after phase."""
    found = {}

    def phase(name, wanted, kinds):
        used = set()
        for i, (k, label, value) in enumerate(base):
            if ("base", i) in found or k not in kinds:
                continue
            for j, (k2, label2, value2) in enumerate(comp):
                if j not in used and ("comp", j) not in found and k2 in kinds and wanted((label, value), (label2, value2)):
                    used.add(j)
                    equal = "identical" if name != "key" or same(value) == same(value2) else "changed"
                    found["base", i], found["comp", j] = (name, j, equal), (name, i, equal)
                    break

    every = (*semantic.KEYED, *semantic.PROSE)
    phase("key", lambda a, b: key(a[0]) == key(b[0]), semantic.KEYED)
    phase("value", lambda a, b: same(a[1]) == same(b[1]), every)
    todo = []
    for side, mine, other, theirs in (("base", base, "comp", comp), ("comp", comp, "base", base)):
        cells = [j for j, (k, _, _) in enumerate(theirs) if k in semantic.CELLS and (other, j) not in found]
        held = {t for j in cells for t in words(theirs[j][1]) + words(theirs[j][2])}
        for i, (k, _, value) in enumerate(mine):
            said = words(value)
            if k in semantic.PROSE and (side, i) not in found and cells and said and set(said) <= held and len(held) <= len(said) <= 2 * len(held):
                todo.append((side, i, other, cells))
                break
    for side, i, other, cells in todo:
        found[side, i] = ("gathered", None, "identical")
        found.update({(other, j): ("gathered", i, "identical") for j in cells})
    phase("tokens", lambda a, b: words(a[1]) == words(b[1]) != [], semantic.PROSE)
    for side, items, lost in (("base", base, "missing"), ("comp", comp, "added")):
        for i in range(len(items)):
            found.setdefault((side, i), (None, None, lost))
    return found


def test_matched_elements(spark):
    rng = random.Random(7)
    rows, want = {"base": [], "comp": []}, {}
    for pair in range(400):
        sides = {}
        for side in rows:
            n = rng.randrange(7)
            sides[side] = [(rng.choice((*semantic.KEYED, *semantic.PROSE)), rng.choice(("Net sum", "net-sum", "Tax", None)), rng.choice(("a b", "B | a", "a", "c 1", "C-1", "c", "a b c 1", "1 c b a", "tax a", "net sum c", "a b net sum tax", "", None))) for _ in range(n)]
            rows[side] += [(pair, i, *e) for i, e in enumerate(sides[side])]
        want |= {(pair, *at): v for at, v in plain_match(sides["base"], sides["comp"]).items()}
    got = semantic.match_elements(spark.createDataFrame(rows["base"], ELEMENT), spark.createDataFrame(rows["comp"], ELEMENT)).collect()
    assert {(r.pair_id, r.side, r.idx): (r.phase, r.partner, r.status) for r in got} == want
    assert {v[0] for v in want.values()} == {None, "key", "value", "gathered", "tokens"}
    none = spark.createDataFrame([], ELEMENT)
    assert semantic.match_elements(none, none).count() == 0


def test_gathered_cells_count_labels(spark):
    """A line of a page says what a table's cells hold, names of fields too, in both directions."""
    line, cells = ("prose", "", "Ward 12 Nurse Nurse Mira Shift Late"), [("key_value", "Ward", "12"), ("table_cell", "Nurse", "Nurse Mira"), ("key_value", "Shift", "Late")]
    frame = lambda rows: spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ELEMENT)
    for base, comp in (([line], cells), (cells, [line])):
        got = semantic.match_elements(frame(base), frame(comp)).collect()
        assert {(r.phase, r.status) for r in got} == {("gathered", "identical")} and len(got) == 4
    # one cell more than the line says, and a word that no cell holds
    for base, comp in (([line], [*cells, ("key_value", "Bed", "7"), ("key_value", "Floor", "Upper Second")]), ([("prose", "", line[2] + " x")], cells)):
        assert {r.phase for r in semantic.match_elements(frame(base), frame(comp)).collect()} == {None}


def test_hunks():
    assert text_diff.hunks(list("abcd"), list("axyd")) == [(1, 3, ["x", "y"])]
    assert text_diff.hunks(list("ad"), list("abcd")) == [(1, 1, ["b", "c"])]
    assert text_diff.hunks([], []) == []
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        out, at = [], 0
        for start, end, added in text_diff.hunks(a, b):
            assert start > at or not at and not out
            out, at = out + a[at:start] + added, end
        assert out + a[at:] == b


def test_versions_of_text(spark):
    ref = ["one", "two", "three", "four"]
    versions = [
        (1, 1, ref, ["one", "2", "three", "four"]),  # a line changed
        (1, 2, ref, ["one", "three", "four", " ", "five"]),  # a line lost, two put in at the end
        (1, 3, ref, ref),
        (2, 1, ref, ["one", "two", " ", "three", "four"]),  # blank lines put in are no difference
        (3, 1, ref, None),
        (4, 1, None, None),
    ]
    got = text_diff.compare_versions(spark.createDataFrame(versions, "group_id long, version int, old array<string>, new array<string>")).collect()
    found = {(r.group_id, r.location_signature, r.version): (r.reference_text, r.kind, r.text) for r in got}
    assert found == {
        (1, "L2", 1): ("two", "changed", "2"), (1, "L2", 2): ("two", "removed", ""), (1, "L2", 3): ("two", "unchanged", "two"), (1, "after-L4", 2): ("", "added", "five"),
        **{(3, f"L{i + 1}", 1): (line, "removed", "") for i, line in enumerate(ref)},
    }
    assert len(got) == len(found)


def test_rule_store(spark, tmp_path):
    path = f"{tmp_path}/rules-{uuid.uuid4().hex}"
    now = lambda: {(r.scope, r.key) for r in rule_store.rules(spark, path).collect()}
    assert now() == set()
    rule_store.add(path, spark.createDataFrame([("report", "r1"), ("global", "g")], "scope string, key string"), at=1)
    rule_store.add(path, spark.createDataFrame([("location", "l")], "scope string, key string"), at=2)
    assert now() == {("report", "r1"), ("global", "g"), ("location", "l")}
    rule_store.remove(path, rule_store.rules(spark, path).filter("key = 'g'").select("rule_id"), at=3)
    assert now() == {("report", "r1"), ("location", "l")}
    assert rules.index_rules(rule_store.rules(spark, path)).count() == 2
    rule_store.clear(spark, path, at=4)
    rule_store.add(path, spark.createDataFrame([("account", "a")], "scope string, key string"), at=5)
    assert now() == {("account", "a")}


def test_report_tree_and_model(spark):
    groups = spark.createDataFrame([(1, "A 10", "", "x", "sum_10"), (2, "A 10", "", "", "sum_9"), (3, "A 9", "P", "", "last")], "group_id long, account string, package_name string, category string, stem string")
    found = spark.createDataFrame(
        [(1, "d1", "Reported"), (1, "d2", "Ignored"), (2, "d3", "Ignored"), (7, "d4", "Reported")], "group_id long, diff_id string, status string"
    ).selectExpr("*", "'lostGroup' AS group_label", "'L1' AS location_label", "'C' AS code", "'Low' AS severity", "' a\n b ' AS reference_text", "'' AS version_text", "'' AS description")
    tree = {r.group_id: r for r in report.report_tree(found, groups).collect()}
    assert {g: (r.package, r.account_position, r.report_position, r.n_issues, r.package_issues, r.account_issues, r.all_matched) for g, r in tree.items()} == {
        1: ("(root)", 2, 2, 2, 3, 3, False), 2: ("(root)", 2, 1, 1, 3, 3, True), 3: ("P", 1, 1, 0, 0, 0, True)
    }
    lost = report.report_model(found, groups).filter("group_id = 7").collect()[0]
    assert (lost.account, lost.package_name, lost.category, lost.report_name, lost.baseline) == ("(root)", "(root)", "", "Lost Group", "a b")


def test_texts_are_compared_once(spark, capsys):
    """All parts of the result come from one written pass over the texts."""
    from foliodiff.operators import text_diff

    versions = spark.createDataFrame([(1, 0, ["a", "b"], ["a", "B"]), (1, 1, ["a", "b"], ["a", "b"]), (2, 0, ["c"], None)], "group_id long, version int, old array<string>, new array<string>")
    found = text_diff.compare_versions(versions)
    found.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert {tuple(r) for r in found.collect()} == {(1, "L2", "b", 0, "changed", "B"), (1, "L2", "b", 1, "unchanged", "b"), (2, "L1", "c", 0, "removed", "")}


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    """What one task sorts stays the same: more lines or elements are dealt to more tasks."""
    from foliodiff import durable
    from foliodiff.operators import elements, semantic

    monkeypatch.setattr(durable, "TASK_ROWS", 10)
    lines = spark.range(90).selectExpr("id AS doc", "0 AS line_no", "concat('Name: v', id) AS line")
    found = elements.text_elements(lines)
    assert found.rdd.getNumPartitions() == 9 and found.filter("kind = 'key_value'").count() == 90
    side = found.selectExpr("doc AS pair_id", "idx", "kind", "label", "value")
    matched = semantic.match_elements(side, side)
    assert matched.filter("status = 'identical'").count() == 180
    assert matched.rdd.getNumPartitions() >= 9
