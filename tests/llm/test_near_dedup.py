"""Near-dedup against an exact join of all pairs: recall of links, blocks, and one row a component."""

import random

import numpy as np
import pyarrow as pa
import pytest

from foliodiff.llm import near_dedup

VOCABULARY = [f"w{i}" for i in range(3000)]


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def families():
    """Four groups of copies of one text each, from slightly to heavily edited, and single texts."""
    rng = random.Random(11)
    texts = []
    for share, size in ((0.005, 60), (0.015, 60), (0.03, 90), (0.06, 120)):
        start = [rng.choice(VOCABULARY) for _ in range(120)]
        texts += [" ".join(edited(rng, start, share)) for _ in range(size)]
    texts += [" ".join(rng.choice(VOCABULARY) for _ in range(100)) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def shingles(text, width):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def exact(texts, width):
    """All links, and the component of each text."""
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    links += [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j]]
    label = list(range(len(texts)))
    while True:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return links, label


@pytest.mark.parametrize("width", [2, 5])
def test_links_and_components(spark, families, width, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 25)  # so that groups take several blocks
    links, label = exact(families, width)
    docs = spark.createDataFrame(list(enumerate(families)), "doc_id long, text string")
    rows = near_dedup.link_components(docs, width=width).collect()
    found = {r["id"]: r["component_id"] for r in rows}
    joined = sum(found[i] == found[j] for i, j in links)
    assert len(links) > 1500
    assert joined / len(links) >= 0.9
    assert [found[i] for i in range(len(families))] == label


def test_one_row_a_component(spark):
    rows = [(1, "a b c", 0), (1, "a b c", 0), (1, "A b c", 1), (2, "a b c", 2), (3, "", 3), (3, "", 3), (None, "x y z", 4), (None, "x y z", 4), (4, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    kept = near_dedup.dedup(docs)
    assert kept.columns == ["doc_id", "text", "k1"]
    # one of the three rows of id 1, the empty rows each for themselves, one of the null ids
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept.collect()) == [(0, "x y z"), (1, "a b c"), (3, ""), (3, ""), (4, "")]


def test_a_block_tells_few_links():
    """Sixty alike sets of different components: 59 links join them, not 1,770."""
    same = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.append(same, np.uint64(1000 + i))).tobytes() for i in range(60)]
    columns = {"v": np.tile(np.arange(60), 2), "c": np.tile(np.arange(60), 2), "stray": np.repeat([False, True], 60), "members": sets * 2}
    assert len(near_dedup.links_within(pa.table(columns), 0.8)) == 59


def test_runs_over_batches():
    batches = [pa.RecordBatch.from_pydict({"f": f, "i": [0] * len(f)}) for f in ([1, 1, 2], [2, 2], [], [3])]
    assert [t.column("f").to_pylist() for t in near_dedup.sorted_runs(iter(batches), ["f", "i"])] == [[1, 1], [2, 2, 2], [3]]
