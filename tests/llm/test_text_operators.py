"""Each operator against a plain brute-force version, and on awkward input."""

import collections
import hashlib
import math
import random
import re

import pytest

from foliodiff.llm import line_dedup, near_dedup, packing, pitman_yor, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def empty(docs):
    return docs.filter("doc_id < 0")


# --- quality rules


def test_quality_statistics(docs, texts):
    got = by_id(quality_rules.judge(docs))
    for i, t in texts:
        w = words(t)
        grams = collections.defaultdict(list)
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append(k)
        covered = {p for at in grams.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_runs_no_python(docs, awkward):
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality_rules.judge(awkward).count() == awkward.count()
    assert quality_rules.judge(empty(docs)).count() == 0


# --- line dedup


def line_oracle(rows):
    order, seen, out = sorted(rows, key=lambda r: r[0]), set(), {}
    for i, t in order:
        raw = (t or "").split("\n")
        full = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(raw) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for s in range(len(full) - 2):
            window = tuple(x for _, x in full[s : s + 3])
            if window in seen:
                gone |= {k for k, _ in full[s : s + 3]}
            seen.add(window)
        out[i] = (len(full) if t is not None else 0, len(gone), None if t is None else "\n".join(x for k, x in enumerate(raw) if k not in gone))
    return out


def test_line_dedup(docs, texts):
    got = by_id(line_dedup.dedup(docs))
    want = line_oracle(texts)
    assert {i: (r.n_lines, r.n_removed, r.kept_text) for i, r in got.items()} == want
    assert any(w[1] for w in want.values())


def test_line_dedup_merges_overlapping_windows(spark):
    rows = [(1, "a\nb\nc\nd\nz"), (2, "q\na\nb\n\nc\nd\nr"), (3, "a\nb\nx")]
    got = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    assert got[2].kept_text == "q\n\nr"


def test_line_dedup_awkward(docs, awkward):
    assert line_dedup.dedup(awkward).count() == awkward.count()
    assert line_dedup.dedup(empty(docs)).count() == 0


# --- substring dedup


def test_substring_dedup(docs, texts):
    got = by_id(substring_dedup.dedup(docs, keep=["doc_id"]))
    seen, removed = set(), 0
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        removed += sum(gone)
        r = got[i]
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert removed > 1000


def test_substring_dedup_awkward(docs, awkward, spark):
    assert substring_dedup.dedup(awkward).count() == awkward.count()
    assert substring_dedup.dedup(empty(docs)).count() == 0
    same = " ".join(f"w{k}" for k in range(25))
    rows = [(1, same), (1, same), (None, same), (2, same + " tail")]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 25), (1, 25), (2, 25)]


# --- near dedup


def sets_of(texts, width):
    out = {}
    for i, t in texts:
        w = words(t, lower=True)
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def test_near_dedup(docs, texts):
    sets = sets_of(texts, 2)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = by_id(near_dedup.link_components(docs), "id")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}
    assert len(set(label.values())) < len(label) - 10


def test_near_dedup_awkward(docs, awkward):
    rows = near_dedup.link_components(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.n_shingles == 5} == {1}
    assert sorted(near_dedup.dedup(awkward).columns) == sorted(awkward.columns)
    assert near_dedup.link_components(empty(docs)).count() == 0


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(1)
    for j in (0.3, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        found = near_dedup.likely_similarity(near_dedup.sketch(a)[None], near_dedup.sketch(b)[None], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(found - j) < 0.12


# --- packing


def test_packing_is_whole(docs, texts):
    rows = packing.pack(docs, capacities=(64, 128, 512), shard=40).collect()
    length = collections.Counter()
    bins = collections.defaultdict(list)
    for r in rows:
        length[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    assert length == {i: len(words(t)) + 1 for i, t in texts}
    for found in bins.values():
        found.sort(key=lambda r: r.bin_offset)
        used = 0
        for r in found:
            assert r.bin_offset == used
            used += r.n_tokens
        assert found[0].capacity == min(c for c in (64, 128, 512) if c >= used)


def test_packing_prefers_the_fullest_bin():
    placed = packing.pack_lengths([6, 5, 4, 3, 2], (10,))
    assert placed == [(0, 10, 0), (1, 10, 0), (0, 10, 6), (1, 10, 5), (1, 10, 8)]
    assert packing.pack_lengths([3], (4, 16)) == [(0, 4, 0)]


def packed_plainly(lengths, sizes):
    """pack_lengths by looking at every open bin and every piece that is left."""
    bins, placed = [], []  # a bin: [room, when its room was last set, tokens in it]
    for k, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            found = min(fits, key=lambda b: (b[0], -b[1]))
        else:
            gain = {}
            for c in sizes:
                if c >= n:
                    room = c - n
                    for m in lengths[k + 1 :]:
                        if m <= room:
                            room -= m
                    gain[c] = packing.cost(c) / (c - room)
            size = min(gain, key=lambda c: (gain[c], c))
            found = [size, 0, 0]
            bins.append(found)
        placed.append((bins.index(found) if found[2] else len(bins) - 1, found[2]))
        found[0], found[1], found[2] = found[0] - n, k + 1, found[2] + n
    return [(b, min(c for c in sizes if c >= bins[b][2]), o) for b, o in placed]


def test_packing_equals_the_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        sizes = sorted(rng.sample(range(4, 60), rng.randint(1, 4)))
        lengths = sorted((rng.randint(1, sizes[-1]) for _ in range(rng.randint(0, 40))), reverse=True)
        assert packing.pack_lengths(lengths, sizes) == packed_plainly(lengths, sizes)


def test_packed_texts_round_trip(docs, texts):
    packed = packing.pack(docs, capacities=(64, 128, 512), shard=40)
    ends = collections.Counter(" ".join(words(t)) for _, t in texts if len(words(t)) < 512)
    found = collections.Counter()
    rows = packing.bin_texts(docs, packed, capacities=(64, 128, 512)).collect()
    assert sum(len(words(r.text)) for r in rows) == sum(len(words(t)) for _, t in texts)
    for r in rows:
        assert r.n_tokens == len(words(r.text)) + r.text.count("\n") <= r.capacity
        found.update(r.text.split("\n")[:-1] if r.text.endswith("\n") else r.text.split("\n"))
    assert all(found[t] >= n for t, n in ends.items())


def test_packing_shards_by_pieces(spark):
    one = spark.createDataFrame([(1, "a b c d e f g " * 3000)], "doc_id long, text string")
    rows = packing.pack(one, capacities=(4,), shard=1000).collect()
    assert len(rows) == 5251 and sum(r.n_tokens for r in rows) == 21001
    assert len({r.bin_id >> 32 for r in rows}) == 6


def test_packing_awkward(docs, awkward):
    assert packing.pack(awkward).count() == awkward.count()
    assert packing.pack(empty(docs)).count() == 0


# --- language model


def test_model_scores(docs, texts):
    from pyspark.sql import functions as F

    got = by_id(pitman_yor.score(docs, F.col("doc_id") % 10 == 0))
    count = collections.Counter()
    tokens = {i: [*words(t, lower=True), "\n"] for i, t in texts}
    for i, w in tokens.items():
        if i % 10:
            count.update(w)
    total, size = sum(count.values()), len(count)
    gain = [0.0, 0.0]
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 10 == 0, len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        gain[r.held_out] += r.score - r.base_score
    assert min(gain) > 0  # better than smoothed unigrams, on held-out texts too


def test_model_is_a_distribution(spark, tmp_path):
    """The probabilities of different texts add up to less than one, and word order counts."""
    from itertools import product

    from pyspark.sql import functions as F

    train = [(i, "a b a c a b") for i in range(1, 30)]
    short = ["", *(" ".join(x) for n in (1, 2, 3) for x in product("abc", repeat=n))]
    asked = [(1000 + k, t) for k, t in enumerate([*short, "a b a c a b", "b a c a b a", "unseen"])]
    spark.createDataFrame(train + asked, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = by_id(pitman_yor.score(spark.read.parquet(str(tmp_path / "docs")), F.col("doc_id") >= 1000))
    p = [10 ** got[i].score for i, _ in asked]
    assert sum(p) <= 1
    assert p[-3] > 0.02 > p[-2] and 0 < p[-1] < 0.02


def test_model_awkward(docs, awkward):
    from pyspark.sql import functions as F

    assert pitman_yor.score(awkward, F.col("doc_id") == 1).count() == awkward.count()
    assert pitman_yor.score(awkward, F.lit(True)).count() == awkward.count()
    assert pitman_yor.score(empty(docs), F.lit(False)).count() == 0
