"""Aligned word segments: they give both lines back, and keep as much as a plain longest common subsequence where words are distinct."""

import random
import re

from foliodiff.operators.word_segments import word_segments

PAIR = "pair_id long, line int, old string, new string"


def segments(spark, rows):
    found = {}
    for r in word_segments(spark.createDataFrame(rows, PAIR)).orderBy("pair_id", "line", "n").collect():
        found.setdefault((r.pair_id, r.line), []).append((r.value, r.added, r.removed))
    return found


def words(x):
    return re.findall(r"[^ ]+| +", x or "")


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_lines_come_back(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        old = [rng.choice("abcdefghij") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(12))]
        new = [w for w in old if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), rng.choice("abcxyz"))
        if rng.random() < 0.3:
            rng.shuffle(new)
        rows.append((i // 3, i % 3, " ".join(old), " ".join(new)))
    found = segments(spark, rows)
    for pair, line, old, new in rows:
        mine = found.get((pair, line), [])
        assert "".join(v for v, added, _ in mine if not added) == old and "".join(v for v, _, removed in mine if not removed) == new
        kept = sum(len(words(v)) for v, added, removed in mine if not added and not removed)
        assert kept <= common(words(old), words(new))
        assert all(mine[i][1:] != mine[i + 1][1:] for i in range(len(mine) - 1))


def test_distinct_words_keep_the_longest_common_part(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        old = rng.sample(range(100), rng.randrange(1, 14))
        new = [w for w in old if rng.random() < 0.8] + rng.sample(range(100, 200), rng.randrange(3))
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), new.pop(rng.randrange(len(new)))) if new else None
        rows.append((i, 0, " ".join(f"w{x}" for x in old), " ".join(f"w{x}" for x in new)))
    found = segments(spark, rows)
    for pair, _, old, new in rows:
        kept = [w for v, added, removed in found[pair, 0] if not added and not removed for w in v.split()]
        assert len(kept) == common(old.split(), new.split())


def test_small(spark):
    found = segments(spark, [(1, 0, "the rate is 5 now", "the fee is 6 now"), (2, 0, None, "a b"), (3, 0, "a", ""), (4, 0, "", None), (5, 0, "same line", "same line")])
    assert found[1, 0] == [("the ", False, False), ("rate", False, True), ("fee", True, False), (" is ", False, False), ("5", False, True), ("6", True, False), (" now", False, False)]
    assert found[2, 0] == [("a b", True, False)] and found[3, 0] == [("a", False, True)] and (4, 0) not in found and found[5, 0] == [("same line", False, False)]


def test_lines_are_aligned_where_they_were_read(spark, capsys):
    """No word is shuffled or written, whatever crosses; lines of one number stay lines of their own."""
    many = [f"w{i}" for i in range(4000)]
    rows = [(1, 0, " ".join(many), " ".join(many[::-1])), (1, 0, "a b", "a c"), (1, 0, "a b", "a b")]
    found = word_segments(spark.createDataFrame(rows, PAIR))
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    told = found.collect()
    assert [(r.n, r.value) for r in told][-4:] == [(0, "a "), (1, "b"), (2, "c"), (0, "a b")]
    whole = told[:-4]
    assert "".join(r.value for r in whole if not r.added) == rows[0][2] and "".join(r.value for r in whole if not r.removed) == rows[0][3]
