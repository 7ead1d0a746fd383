"""Residue phases: by hand, and against a plain loop over both sides."""

import random
import re

from foliodiff.operators import residue

ITEM = "pair_id long, idx int, kind string, label string, value string"
FIELD, PROSE = residue.FIELD, residue.PROSE


def pairs_of(spark, base, comp):
    got = residue.match_residue(spark.createDataFrame(base, ITEM), spark.createDataFrame(comp, ITEM))
    return sorted(tuple(r) for r in got.select("pair_id", "phase", "base_idx", "comp_idx", "identical").collect())


def matched(spark, base, comp):
    base, comp = ([(1, i, *v) for i, v in enumerate(side)] for side in (base, comp))
    return [r[1:] for r in pairs_of(spark, base, comp)]


def prose(value):
    return ("paragraph", "", value)


def field(label, value):
    return ("field_value", label, value)


def key_of(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def plain_pairs(base, comp):
    """One phase after the other, one row after the other, first free partner."""
    norm = lambda v: re.sub(r"[ \t]+", " ", v).strip().lower()
    equal = lambda v: re.sub(r"\s+", " ", norm(v).replace("|", " ")).strip()
    cells = lambda v: [p.strip() for p in v.split("|") if p.strip()]
    plain = lambda p: "|" not in p[2] and ":" not in p[2]
    names = lambda f, p: key_of(f[1]) and key_of(f[1]) in norm(p[2])
    said = lambda f, p: "|" not in p[2] and len(norm(p[2])) <= 120 and (norm(p[2]) == norm(f[2]) or names(f, p))
    label = lambda f, p: re.search(r"[A-Za-z]:\s*$", p[2]) and key_of(p[2]) == key_of(f[1])
    row = lambda f, p: "|" in p[2] and ":" not in p[2] and len(cells(p[2])) > 1 and (key_of(cells(p[2])[0]), equal(cells(p[2])[1])) == (key_of(f[1]), equal(f[2]))
    is_key = lambda f, p: key_of(f[1]) and norm(p[2]) == key_of(f[1])
    ends = lambda f, p: norm(f[2]) and norm(p[2]).endswith(norm(f[2]))
    last = lambda f, p: plain(p) and norm(f[2]) and (norm(p[2]) == norm(f[2]) or (names(f, p) and (ends(f, p) or is_key(f, p))))
    last_loose = lambda f, p: plain(p) and (ends(f, p) or is_key(f, p))
    found, left, right = [], dict(enumerate(base)), dict(enumerate(comp))

    def take(phase, i, j, same=True):
        found.append((phase, i, j, same))
        left.pop(i, None)
        right.pop(j, None)

    def first(phase, rows, others, kinds, test, flip=False, same=True):
        for i, a in list(rows.items()):
            for j, b in list(others.items()):
                if (kinds is None or (a[0] in kinds[0] and b[0] in kinds[1])) and test(a, b):
                    take(phase, *((j, i) if flip else (i, j)), same)
                    break

    first("value", left, right, None, lambda a, b: equal(a[2]) == equal(b[2]) and not (a[0] in FIELD and b[0] in FIELD))
    for i, p in list(left.items()):
        if p[0] in PROSE and "|" in p[2]:
            for part in cells(norm(p[2])):
                for j, f in list(right.items()):
                    if f[0] in FIELD and (part == norm(f[2]) or (norm(f[2]) and key_of(f[1]) and norm(f[2]) in part and key_of(f[1]) in part)):
                        take("pipe_parts_say_fields", i, j)
                        break
        elif p[0] in PROSE:
            for j, f in list(right.items()):
                if f[0] in FIELD and said(f, p):
                    take("prose_says_field", i, j)
                    break
    to_field, to_prose = (PROSE, FIELD), (FIELD, PROSE)
    first("prose_is_label", left, right, to_field, lambda p, f: label(f, p), same=False)
    first("field_said_by_prose", right, left, to_field, lambda p, f: said(f, p), flip=True)
    first("pipe_row_is_field", left, right, to_field, lambda p, f: row(f, p))
    first("field_is_pipe_row", left, right, to_prose, row)
    first("prose_ends_in_field", left, right, to_field, lambda p, f: last(f, p))
    first("field_ends_prose", left, right, to_prose, last_loose)
    return found


def test_equals_plain_loop(spark):
    """Short documents of few words, so that rows compete, in every phase."""
    rng = random.Random(11)
    labels = ["Net", "Net Sum", "Net-Sum", "Tax", "No", "", "Ü", "A"]
    values = ["10", "a 1", "1", "Net", "x | y", "", "10 1", "tax 1"]
    forms = [
        lambda k, v: v, lambda k, v: f"{k} {v}", lambda k, v: f"{k}: {v}", lambda k, v: f"{k}:", lambda k, v: f"{k} | {v}", lambda k, v: k, lambda k, v: f"see {k} {v}", lambda k, v: f"{k}: {v} | {v} | Tax 1 10",
        lambda k, v: f"{v}  | Net 10 |", lambda k, v: f"{k} | {v}".replace("x | y", "x y"), lambda k, v: f"{k} {'long ' * 30}{v}", lambda k, v: None,
    ]

    def document():
        out = []
        for _ in range(rng.randrange(8)):
            kind = rng.choice((*FIELD, *FIELD, *PROSE, *PROSE, "table_cell"))
            k, v = rng.choice(labels), rng.choice(values)
            out.append((kind, k, v if kind in FIELD else rng.choice(forms)(k, v)))
        return out

    sides = [(document(), document()) for _ in range(700)]
    sides += [([prose("Net-Sum | x y")], [field("Net-Sum", "x | y")]), ([prose("Net-Sum:")], [field("Net-Sum", "7")])]
    got = pairs_of(spark, *([(n, i, *row) for n, pair in enumerate(sides) for i, row in enumerate(pair[k])] for k in (0, 1)))
    clean = lambda rows: [(kind, label, value or "") for kind, label, value in rows]
    want = sorted((n, *p) for n, (base, comp) in enumerate(sides) for p in plain_pairs(clean(base), clean(comp)))
    assert got == want
    assert {p[1] for p in want} == {name for _, name, _ in residue.PHASES}


def test_long_chains_of_equal_values(spark):
    """Fields and prose of one value on both sides, many times; and rows that all want the first partner."""
    base = [("field_value", f"k{i}", "same") if i % 3 else prose("same") for i in range(60)] + [prose(f"Owner {i}") for i in range(25)]
    comp = [("field_value", f"m{i}", "Same") if i % 2 else ("list_item", "", "same") for i in range(50)] + [field("Owner", str(i)) for i in range(25)]
    assert sorted(matched(spark, base, comp)) == sorted(plain_pairs(base, comp))


def test_each_part_claims_a_field(spark):
    base = [prose("Account: 1000 | Synthetic data | No real PHI"), prose("Region: South | Status: Active | 77 | nothing")]
    comp = [field("Status", "Active"), field("Account", "1000"), field("Code", "77"), field("Region", "South"), field("", "none of these")]
    p = "pipe_parts_say_fields"
    assert matched(spark, base, comp) == [(p, 0, 1, True), (p, 1, 0, True), (p, 1, 2, True), (p, 1, 3, True)]


def test_a_field_is_claimed_once_and_a_part_claims_one(spark):
    base = [prose("1000 | 1000"), prose("Account: 1000 | x"), ("list_item", "", "1000 | y")]
    comp = [field("Account", "1000"), field("Other Account", "1000"), field("Third", "1000")]
    p = "pipe_parts_say_fields"
    assert matched(spark, base, comp) == [(p, 0, 0, True), (p, 0, 1, True), (p, 2, 2, True)]


def test_key_or_value_alone_is_no_statement(spark):
    assert matched(spark, [prose("Account: 2000 | Region: x")], [field("Account", "1000"), field("Region", ""), field("", "200")]) == []


def test_parts_and_plain_prose_take_turns_in_document_order(spark):
    base = [prose("Account 1000"), prose("Account: 1000 | z")]
    assert matched(spark, base, [field("Account", "1000")]) == [("prose_says_field", 0, 0, True)]
    assert matched(spark, base[::-1], [field("Account", "1000")]) == [("pipe_parts_say_fields", 0, 0, True)]


def test_no_python_in_the_plan(spark):
    items = spark.createDataFrame([(1, 0, "paragraph", "", "Account 1000")], ITEM)
    plan = residue._pairs(residue._by_rank(residue._sides(items, items)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_leave_only_starts_of_keys(spark, monkeypatch):
    """A text leaves a mark for each key it may hold, not for each of its short substrings; where keys are too many to list, the same rows are found."""
    base = spark.createDataFrame([(1, 0, "field_value", "Owner", "mara"), (1, 1, "field_value", "City", "x"), (2, 0, "field_value", "", "y")], ITEM)
    comp = spark.createDataFrame([(1, 5, "paragraph", "p", "the quick brown fox and its owner jumped over many lazy dogs"), (1, 6, "paragraph", "q", "a city far away"), (2, 7, "paragraph", "r", "nothing"), (3, 8, "paragraph", "s", "no fields at all")], ITEM)
    free = residue._by_rank(residue._sides(base, comp)).filter("mate IS NULL")
    assert residue._met(free).filter("mark LIKE 'k%'").count() == 2
    found = lambda: sorted(map(tuple, residue.match_residue(base, comp).collect()))
    listed = found()
    assert [r[:4] for r in listed] == [(1, "field_said_by_prose", 0, 5), (1, "field_said_by_prose", 1, 6)]
    monkeypatch.setattr(residue, "MOST_STARTS", 0)
    assert found() == listed
