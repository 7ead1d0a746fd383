"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliodiff.llm import content_sort, registry, runs, turn_repair

TURNS = "conv_id long, turn long, role string, text string"


# --- 11: conversations


def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, turns) of sorted rows of (role, text), trying every edit."""
    faults, seen = [], set()
    for row in rows:
        shown = row[1].strip(" \t\n\v\f\r")
        faults.append("b" if not shown else "d" if row in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add(row)
    known = {}

    def best(i, said, left=4):
        key = (i, said, left)
        if key not in known:
            known[key] = None
            found = [(0, "", [])] if i == len(rows) and re.fullmatch("(s?(ua)+)?", said) else []
            if re.match("(s?(ua)*u?)?$", said):
                after = [(4, "D", said, None, i + 1)] if i < len(rows) else []
                for role in ("user", "assistant"):
                    if left:
                        after.append((3, "I", said + role[0], (role, ""), i))
                    if i < len(rows) and faults[i] in ("", "t"):
                        after.append((3 + 3 * (faults[i] == "t"), "R", said + role[0], (role, rows[i][1]), i + 1))
                if i < len(rows) and faults[i] in ("", "t") and rows[i][0]:
                    after.append((3 * (faults[i] == "t"), "K", said + rows[i][0][0], rows[i], i + 1))
                for cost, edit, then, turn, j in after:
                    if re.match("(s?(ua)*u?)?$", then) and (rest := best(j, shorter(then), left - 1 if j == i else 4)):
                        found.append((cost + rest[0], edit + rest[1], [turn] * (turn is not None) + rest[2]))
            known[key] = min(found, key=lambda x: x[:2], default=None)
        return known[key]

    cost, audit, turns = best(0, "")
    initials = [r[0][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (*(faults.count(f) for f in "bdt"), illegal, cost, audit, turns)


def shorter(said):
    """What was said, with turns of user and assistant cut out that do not matter for what may follow."""
    return re.sub("(ua)+(?=ua)", "", said)


def damage(rows):
    """The contract's damage, a row at a time."""
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, role, text) for c, t, role, text in damage(rows) if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in mine if t is not None]
        *counts, kept = plain_repair([r[1:] for r in mine])
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, hashlib.sha256(text.encode()).hexdigest())
    return found


def messages(rng, n):
    texts = ["Good.", "What?", "well then", "Yes!", " \n ", "", None, "(fine.)", "Ça va.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return [(conv, rng.choice([i, i, i, None, i + 3]), rng.choice(roles), rng.choice(texts)) for conv in [None, *range(n)] for i in range(rng.randint(1, 9))]


def test_repair_equals_trying_every_edit(spark, tmp_path):
    rows = messages(random.Random(3), 60)
    spark.createDataFrame(rows, TURNS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    result = registry.op11_structure_repair(spark, str(tmp_path))
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [t for _, t in result.dtypes] == ["bigint"] * 7 + ["string"] * 2
    got = {r[0]: tuple(r)[1:] for r in result.collect()}
    assert got == expected(rows)
    assert {e for r in got.values() for e in r[6]} == set("KDIR")


def test_repair_of_one_conversation_over_many_batches(spark):
    """A conversation longer than an Arrow batch, with a fault now and then; places and digests go on across batches."""
    n = 25_001
    rows = [(7, i, "assistant" if i % 2 else "user", "" if i % 1000 == 17 else f"turn {i}.") for i in range(n)]
    turns = spark.createDataFrame(rows, TURNS)
    repaired = turn_repair.repairs(turns).collect()[0]
    sorted_rows = [(role, text) for _, _, role, text in rows]
    blank = sum(t == "" for _, t in sorted_rows)
    assert (repaired["blank"], len(repaired["audit"].replace("I", ""))) == (blank, n)
    kept = turn_repair.repaired_turns(turns, turn_repair.repairs(turns)).orderBy("position").collect()
    assert re.fullmatch("(ua)+", "".join(r["role"][0] for r in kept))
    digest = turn_repair.digests(turn_repair.repaired_turns(turns, turn_repair.repairs(turns))).collect()
    assert [tuple(r) for r in digest] == [(7, hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest())]


def test_vectors_are_few():
    repairer, rng = turn_repair.Repairer(), random.Random(1)
    for _ in range(300):
        repairer.repair(bytes(rng.choice(range(9)) for _ in range(rng.randint(0, 60))))
    assert len(repairer.vectors) < 60 and max(max(v) for v in repairer.vectors) <= 10


def test_repair_edge_cases(spark, tmp_path):
    assert turn_repair.repairs(spark.createDataFrame([], TURNS)).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 5, True, "z"), (1, 0, "user", "Hi.", "x", 5, True, "z")], TURNS + ", audit string, cost int, cut boolean, digest string")
    assert [tuple(r) for r in turn_repair.repairs(wide).collect()] == [(1, 0, 0, 1, 0, 1, 7, "KDI")]
    assert [(r["role"], r["text"]) for r in turn_repair.repaired_turns(wide, turn_repair.repairs(wide)).collect()] == [("user", "Hi."), ("assistant", "")]
    texts = spark.createDataFrame([("a", 1, "user", "x" * 300_000), ("a", 2, "assistant", "Yes.")], TURNS.replace("conv_id long", "conv_id string"))
    assert [tuple(r) for r in turn_repair.repairs(texts).collect()] == [("a", 0, 0, 0, 1, 0, 3, "KK")]


# --- 12: equal texts


def plain_groups(rows):
    found = {}
    for i, t in rows:
        found.setdefault("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    return found


@pytest.mark.parametrize("largest", [True, False])
def test_content_sort_equals_plain_grouping(spark, texts, largest):
    rows = texts + [(1000 + i, "Same Text") for i in range(300)] + [(2000 + i, "same text".upper()) for i in range(5)] + [(3000, "ÄBC"), (3001, "äbc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = content_sort.digests(docs, keep_largest=largest).collect()
    groups = plain_groups(rows)
    want = {(i, hashlib.sha256(t.encode()).hexdigest(), (max if largest else min)(ids), len(ids), i == (max if largest else min)(ids)) for t, ids in groups.items() for i in ids}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_content_sort_spreads_heavy_texts(spark, monkeypatch):
    """With few hashes that count as light, most groups are met in several ranges."""
    monkeypatch.setattr(content_sort, "HEAVY", 40)
    rows = [(i, f"text {i % 7}") for i in range(400)] + [(500 + i, f"own {i}") for i in range(50)] + [(None, "text 3"), (None, "text 3"), (900, None), (None, None), (None, "")]
    got = content_sort.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 58
    for t, ids in plain_groups(rows).items():
        mine = [r for r in got if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(keep, len(ids))} and [r["id"] for r in mine if r["kept"]] == [keep]


def test_content_sort_edge_cases(spark, awkward):
    assert content_sort.digests(awkward.limit(0)).count() == 0
    got = content_sort.digests(awkward).collect()
    kept = sorted(((r["id"], r["group_size"]) for r in got if r["kept"]), key=str)
    assert len(got) == 8 and kept == [(1, 1), (1, 3), (3, 3), (4, 1)]  # of two rows with id 1 and the same text one stays
    long = spark.createDataFrame([("b", "x" * 400_000 + "A"), ("a", "x" * 400_000 + "a"), ("c", "x" * 400_000 + "b")], "doc_id string, text string")
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in content_sort.dedup(long).collect()} == {("a", "b", 2), ("b", "b", 2), ("c", "c", 1)}
    assert {r["id"] for r in content_sort.survivors(long).collect()} == {"b", "c"}


def test_content_sort_is_native(spark, docs):
    plan = content_sort.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions|ExternalRDD", plan)


# --- 13: runs


def plain_runs(words, least, fold):
    """By definition: for every period, every longest stretch in which words that far apart are the same."""
    n, found = len(words), []
    for p in range(1, n // fold + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, fold * p) and not any(s <= i and j + p <= s + length for s, length, q in found if q < p):
                found.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted((s, length, p) for s, length, p in found)


def test_plain_runs_has_no_multiple_periods():
    assert plain_runs(list("ab" * 20), 24, 3) == [(0, 40, 2)]


@pytest.mark.parametrize("least,fold", [(24, 3), (4, 2), (9, 3), (7, 2)])
def test_runs_equal_definition(least, fold):
    rng = random.Random(least)
    docs = [[rng.randrange(k) for _ in range(rng.randint(0, 90))] for k in (1, 2, 2, 2, 3, 3, 5) * 12]
    for _ in range(60):
        base = [rng.randrange(6) for _ in range(rng.randint(1, 30))]
        docs.append([rng.randrange(50) for _ in range(rng.randint(0, 30))] + base * rng.randint(2, 6) + base[: rng.randint(0, len(base))] + [rng.randrange(50) for _ in range(rng.randint(0, 30))])
    fib = [0, 1]
    for _ in range(9):
        fib = fib + fib[: len(fib) * 5 // 8]
    docs += [fib[:300], [1] * 500, []]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = [tuple(int(v) for v in r) for r in zip(*runs.runs_of(np.array([w for d in docs for w in d], np.int32), bounds, least, fold), strict=True)]
    want = [(i, *r) for i, d in enumerate(docs) for r in plain_runs(d, least, fold)]
    assert got == want and len(want) > 20


def test_trees_in_groups_equal_one(monkeypatch):
    rng = random.Random(2)
    codes = np.array([rng.randrange(2) for _ in range(3000)], np.int32)
    bounds = np.arange(0, 3001, 60)
    whole = runs.runs_of(codes, bounds, 8, 2)
    monkeypatch.setattr(runs, "TREE_WORDS", 200)
    monkeypatch.setattr(runs, "LEAVES", 7)
    assert all((a == b).all() for a, b in zip(whole, runs.runs_of(codes, bounds, 8, 2), strict=True)) and len(whole[0])


def plain_query(i, text):
    words = re.findall("[^ \t\n\v\f\r]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = plain_runs(words, 24, 3)
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(found), *best, best[2] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_of_runs_equals_plain_version(spark, texts, tmp_path):
    rng = random.Random(8)
    rows = [(i, t) for i, t in texts if len(t or "") < 9000]
    for i in range(500, 700):
        base = [rng.choice("ab cd ef".split()) for _ in range(rng.randint(1, 12))]
        rows.append((i, " ".join(["x"] * rng.randint(0, 3) + base * rng.randint(1, 9) + [f"w{k}" for k in range(rng.randint(0, 40))] + base * 4)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert {r[0]: tuple(r) for r in got.collect()} == {i: plain_query(i, t) for i, t in rows}


def test_runs_edge_cases(spark, awkward):
    assert runs.collapse(awkward.limit(0)).count() == 0
    wide = awkward.withColumn("runs", F.lit(1)).withColumn("text", F.when(F.col("doc_id") == 4, F.array_join(F.array_repeat(F.lit("A  b"), 50_000), "\n")).otherwise(F.col("text")))
    got = runs.collapse(wide, keep=["doc_id", "runs", "kept_text"])
    assert got.columns == ["doc_id", "runs", "kept_text", "n_words", "runs_", "kept_text_"]
    rows = {r["doc_id"]: r for r in got.filter("doc_id in (2, 3, 4)").collect()}
    assert [tuple(x) for x in rows[4]["runs_"]] == [(0, 100_000, 2)] and rows[4]["kept_text_"] == "A b" and rows[4]["n_words"] == 100_000
    assert all(rows[i]["runs_"] == [] and rows[i]["kept_text_"] == "" for i in (2, 3))
    assert got.count() == 8
