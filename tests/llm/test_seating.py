"""Gibbs seating against exact enumeration of small restaurants, and of large dishes against their exact law."""

import math

import numpy as np
import pytest

from foliodiff.llm import seating as seat
from foliodiff.llm.pitman_yor import BURN_IN, SAMPLES
from foliodiff.llm.seating import Seating, auxiliary


def stirling(n, d):
    """Generalised Stirling numbers: s[c][t] sums the weights of all seatings of c customers at t tables."""
    s = [[0.0] * (n + 2) for _ in range(n + 1)]
    s[0][0] = 1.0
    for c in range(n):
        for t in range(c + 2):
            s[c + 1][t] = (s[c][t - 1] if t else 0.0) + (c - t * d) * s[c][t]
    return s


def sampled(c, p, theta, d, restaurants, sweeps, seed=0):
    """Table counts of the dishes after many sweeps, of many alike restaurants side by side."""
    rng = np.random.default_rng(seed)
    u = np.repeat(np.arange(restaurants), len(c))
    p = np.tile(p, restaurants)
    t = np.ones(len(u))
    v = auxiliary(rng, np.bincount(u, t), theta, d)
    seating = Seating(rng, np.tile(c, restaurants), d * v[u] * p, d)
    for _ in range(sweeps):
        t = seating.sweep(d * v[u] * p)
        v = auxiliary(rng, np.bincount(u, t), theta, d)
    return t.reshape(restaurants, len(c))


def test_tiny_restaurant_matches_enumeration():
    c, p, theta, d = np.array([4, 2]), np.array([0.3, 0.6]), 1.0, 0.6
    s = stirling(4, d)
    law = {}
    for a in range(1, 5):
        for b in range(1, 3):
            law[a, b] = s[4][a] * s[2][b] * math.prod(theta + d * k for k in range(1, a + b)) * p[0] ** a * p[1] ** b
    whole = sum(law.values())
    got = sampled(c, p, theta, d, 40_000, 25)
    for (a, b), weight in law.items():
        share = ((got[:, 0] == a) & (got[:, 1] == b)).mean()
        assert share == pytest.approx(weight / whole, abs=0.01)


def mean_tables(n, p, theta, d, most=600):
    """The exact mean number of tables of a restaurant with one dish, in logarithms."""
    t = np.arange(most + 2)
    row = np.where(t == 1, 0.0, -np.inf)
    for c in range(1, n):
        left = c - d * t
        row = np.logaddexp(np.where(left > 0, row + np.log(np.maximum(left, 1e-300)), -np.inf), np.concatenate([[-np.inf], row[:-1]]))
    k = np.arange(1, most + 2)
    law = row[1:] + k * np.log(p) + np.concatenate([[0], np.cumsum(np.log(theta + d * np.arange(1, most + 1)))])
    weight = np.exp(law - law.max())
    return (weight * k).sum() / weight.sum()


@pytest.mark.parametrize("n,p,d", [(60, 0.2, 0.7), (1_000, 0.2, 0.7), (1_000, 0.5, 0.8), (4_000, 0.05, 0.8), (4_000, 0.3, 0.6)])
def test_mean_tables_after_the_sweeps_of_the_model(n, p, d):
    got = sampled(np.array([n]), np.array([p]), 1.0, d, 3000, BURN_IN + SAMPLES)
    assert got.mean() == pytest.approx(mean_tables(n, p, 1.0, d), rel=0.1)


def test_first_sweeps_are_near():
    got = sampled(np.array([1_000]), np.array([0.2]), 1.0, 0.7, 3000, BURN_IN)
    assert got.mean() == pytest.approx(mean_tables(1_000, 0.2, 1.0, 0.7), rel=0.1)


def test_beyond_the_table(monkeypatch):
    """Dishes that are not looked up: near the law where a new table weighs little."""
    monkeypatch.setattr(seat, "EXACT", 100)
    got = sampled(np.array([4_000]), np.array([0.05]), 1.0, 0.8, 3000, BURN_IN + SAMPLES)
    assert got.mean() == pytest.approx(mean_tables(4_000, 0.05, 1.0, 0.8), rel=0.1)


def test_sizes_add_up():
    rng = np.random.default_rng(1)
    c = np.array([2, 4000, 33, 7, 2, 400_000, 200, 200])
    a = np.array([3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 90.0])
    made = Seating(rng, c, a, 0.8)
    for _ in range(4):
        t = made.sweep(a)
        moved = made.customers
        first = np.cumsum(moved.t) - moved.t
        assert (np.add.reduceat(moved.size, first) == moved.c).all() and moved.size.min() >= 1 and sorted(c[made.many]) == [400_000]
        assert (t >= 1).all() and (t <= c).all() and t[5] > t[0] and t[7] > t[6]
    assert sorted(c[Seating(rng, c, np.full(8, 40.0), 0.8).many]) == [4000, 400_000]  # too heavy for the table


def test_no_dishes():
    assert len(Seating(np.random.default_rng(0), np.zeros(0, int), np.zeros(0), 0.5).sweep(np.zeros(0))) == 0


def test_groups_hold_one_payload_at_a_time_and_give_memory_back(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from foliodiff.llm import blobs, pitman_yor

    given = []
    monkeypatch.setattr(blobs, "release", lambda: given.append(1))
    words, asked = np.arange(1, 4, dtype=np.uint64), []
    for cell in (5, 6):
        asked.append((0, cell, blobs.ASK, blobs.pack(words, np.array([1, 2, 3], np.uint8), np.array([1, 1, 2], np.uint8))))
    group = pa.Table.from_batches([blobs.rows(asked)])
    assert [x[1] for x in blobs.each(group, "bucket", "block")] == [5, 6]
    told = pitman_yor._unigram({"d": 0.5, "d0": 0.5}, 1, 3)(group)
    assert told.num_rows == 3 and len(given) == 2  # before and after
    for arrays in ((np.zeros(0, np.int32), np.arange(3.0)), (np.arange(10)[::2],)):
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, blobs.unpack(blobs.pack(*arrays)), strict=True))


def test_messages_are_small(spark):
    """A group of 20 MB reaches Python in pieces, and what is told goes back in pieces; the session's own setting returns."""
    import pyarrow as pa

    from foliodiff.llm import blobs

    told = [(0, i, blobs.ASK, bytes([i]) * (1 << 20)) for i in range(20)]
    parts = list(blobs.messages(told))
    assert [r for p in parts for r in p.column("block").to_pylist()] == list(range(20))
    assert max(p.nbytes for p in parts) <= blobs.MESSAGE + 1024
    assert [p.num_rows for p in blobs.messages([])] == [0]
    assert [p.num_rows for p in blobs.messages([(0, 0, 0, bytes(2 * blobs.MESSAGE)), (0, 1, 0, b"")])] == [1, 1]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    df = spark.range(20).selectExpr("id % 2 AS k", "cast(repeat('x', 1048576) AS binary) AS p")
    with blobs.small_batches(spark):
        found = df.groupBy("k").applyInArrow(lambda t: pa.table({"n": [t.column("p").num_chunks], "rows": [t.num_rows]}), "n long, rows long").collect()
    assert all(r.n > 1 and r.rows == 10 for r in found) and len(found) == 2
    assert spark.conf.get(name) == before
