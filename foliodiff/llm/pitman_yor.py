"""LM scoring: a hierarchical Pitman-Yor model of word pairs, its seating sampled by Gibbs, on packed exchanges.

Every context (the word before, or the start of the text) is a restaurant; all of them share the unigram restaurant as
parent, and its parent is uniform over the known words and one unknown. With c customers and t tables for word w in context u,

    P(w | u) = (c_uw - d t_uw + (theta + d t_u) P(w)) / (theta + c_u)
    P(w)     = (T_w - d0 tt_w + (theta0 + d0 tt) / (V + 1)) / (theta0 + T),   T_w = sum_u t_uw

Counts cover every training text. Discounts come from the counts of counts. Seating is sampled by Gibbs (see seating):
first in the unigram restaurant, given one table a dish in all contexts; then in the contexts, given a draw of the parent's
word probabilities from their posterior (the part of words without tables by its mean); the tables found are the customers
of the unigram restaurant, which is sampled again, and so are the contexts. Their last SAMPLES sweeps are averaged in P(w | u).
Contexts that several cells share keep their auxiliary v and the other cells' tables between exchanges.

Distribution (see blobs): texts become blocks of coded word pairs, dealt to cells by context. Contexts that hold more than
their share of all words are found first by an exact count and dealt to cells by the whole pair instead, with totals
added up. A cell merges the pairs of all blocks and keeps who used them. Words of a cell ask their unigram restaurant in a
second exchange, twice: once with one table a dish, once after the first sweeps. In the end each cell sends every block
its documents' partial sums. Arrays in a task are bounded by a block, or by a cell of about CELL tokens.
Cells are dealt words by hash, so they have a message for a bucket of words only if they hold some of them. No vocabulary and no counts pass the driver but one row of totals a task and the crowded contexts.

An input that is no plain scan of files is written first (see blobs). A null or empty text is the end token alone. Without training
texts, every word is unknown, and scores are those of the uniform distribution over one word. Rows that repeat are
learnt from and scored each on their own. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import ASK, DOCS, KNOWN, SCHEMA, block_name, bucket_of, by_bucket, each, frugal, messages, pack, release, runs, small_batches, unpack
from .common import discard, durable, fixed, stored
from .seating import Seating, auxiliary
from .words import encode, hashes, mix, pieces

PAIRS, USES, STAT, CROWD = 3, 4, 5, 6
START, END = np.uint64(1), np.uint64(2)
PRIME = np.uint64(0x9E3779B97F4A7C15)
TOKENS = 1_500_000
CELL = 1_300_000
THETA, THETA0 = 1.0, 1.0
BURN_IN, SAMPLES = 3, 5
SMOOTH = 0.1


def small(a: np.ndarray) -> np.ndarray:
    """a in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


# --- blocks -----------------------------------------------------------------------------------------------------------


def _crowded(buckets: int):
    """For each piece of text, the words that hold more than 1 / (4 buckets) of it, as (word, count), and the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            codes, words, _ = encode(piece.column("text"), lower=True)
            total = len(codes) + piece.num_rows
            count = np.bincount(codes, minlength=len(words))
            top = np.flatnonzero(count * 4 * buckets > total)
            h = hashes(words.take(pa.array(top)))
            w = np.concatenate([h, [START, np.uint64(0)]]).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.concatenate([count[top], [piece.num_rows, total]]).astype(np.int64))], ["w", "n"])
        release()

    return run


def crowded_contexts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """(sorted hashes of a superset of the contexts with more than 1 / (2 buckets) of all tokens, number of tokens)."""
    counts = durable(docs.mapInArrow(_crowded(buckets), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.filter("w = 0").head()
    if total is None:
        return np.zeros(0, np.uint64), 0
    # a word may lack its counts from pieces where it is rare: those add at most 1 / (4 buckets)
    hot = counts.filter((F.col("w") != 0) & (F.col("n") * 4 * buckets > total["n"])).collect()
    return np.sort(np.array([r["w"] for r in hot], np.int64).view(np.uint64)), total["n"]


def _blocks(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total, vocab = 0, [], 0, 0
        for piece in pieces(batches):
            codes, words, offsets = encode(piece.column("text"), lower=True)
            n = len(words)
            ends = offsets[1:] + np.arange(piece.num_rows)
            w = np.full(len(codes) + piece.num_rows, n + 1, np.int32)  # n: start, n + 1: end
            inner = np.ones(len(w), bool)
            inner[ends] = False
            w[inner] = codes
            u = np.concatenate([[n], w[:-1]]).astype(np.int32)
            u[ends[:-1] + 1] = n
            h = np.concatenate([hashes(words), [START, END]]).astype(np.uint64)
            keys = [piece.column(c) for c in ("id", "held_out")]
            if held and (total + len(w) > TOKENS or (vocab + len(h)) ** 2 * (sum(len(x[2]) for x in held) + piece.num_rows) >= 2**62):
                yield from _block(held, number, buckets, hot)
                number, held, total, vocab = number + 1, [], 0, 0
                release()
            held.append((u, w, np.diff(offsets) + 1, h, *keys))
            total, vocab = total + len(w), vocab + len(h)
        if held:
            yield from _block(held, number, buckets, hot)
            held = []
        release()

    return run


def _block(held: list, number: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    block = block_name(number)
    vocab = np.unique(np.concatenate([x[3] for x in held]))
    lengths = np.concatenate([x[2] for x in held])
    ids, out = pa.concat_arrays([x[4] for x in held]), pa.concat_arrays([x[5] for x in held]).to_numpy(zero_copy_only=False)
    rank = np.argsort(out, kind="stable")  # training documents come first
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    n_train = len(out) - int(out.sum())
    v, nd = len(vocab), len(rank)
    maps = [np.searchsorted(vocab, x[3]) for x in held]
    key, end = np.empty(sum(len(x[0]) for x in held), np.int64), 0
    while held:  # a piece goes as soon as it is coded
        m, x = maps.pop(0), held.pop(0)
        part = key[end : end + len(x[0])]
        np.take(m, x[0], out=part)
        part *= v
        part += m[x[1]]
        end += len(x[0])
        del m, x, part
    key *= nd
    key += np.repeat(place, lengths)
    key.sort()
    at, n = runs(key)
    key, n = key[at], small(n)
    del at
    doc = small(key % nd)
    key //= nd
    w = (key % v).astype(np.int32)
    key //= v
    u = key.astype(np.int32)
    del key
    cell = (vocab[u] % np.uint64(buckets)).astype(np.int32)
    split = np.isin(vocab[u], hot)
    cell[split] = (mix(vocab[u[split]] * PRIME + vocab[w[split]]) % np.uint64(buckets)).astype(np.int32)
    valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)[rank]
    known_ids = ids.fill_null(0).to_numpy()[rank]
    told = [(bucket_of(block, buckets), block, DOCS, pack(known_ids, valid, small(lengths[rank]), np.array([n_train])))]
    for b, at in by_bucket(cell, buckets):
        pu, pw = u[at], w[at]
        first, uses = runs(pu.astype(np.int64) * v + pw)
        pu, pw = pu[first], pw[first]
        start, per_u = runs(pu)
        ws, wi = np.unique(pw, return_inverse=True)
        told.append((b, block, ASK, pack(vocab[pu[start]], small(per_u), vocab[ws], small(wi), small(uses), small(doc[at]), small(n[at]), np.array([n_train]))))
    return messages(told)


# --- cells ------------------------------------------------------------------------------------------------------------


def _asks(cell: int, buckets: int, words: np.ndarray, c: np.ndarray, t: np.ndarray) -> list:
    """What a cell asks of the unigram restaurants: for its words, their training count and tables here."""
    found = []
    for b, at in by_bucket(((words >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), buckets):
        found.append((b, cell, ASK, pack(words[at], small(c[at]), small(t[at]))))
    return found


def _crowd_row(cell: int, contexts: np.ndarray, hot: np.ndarray, c_u: np.ndarray, t_u: np.ndarray) -> list:
    at = np.flatnonzero(np.isin(contexts, hot))
    return [(0, cell, CROWD, pack(contexts[at], c_u[at], t_u[at]))] if len(at) else []


def _merge(buckets: int, hot: np.ndarray):
    """Of a cell: its pairs with training counts, and who used them."""

    def run(group: pa.Table) -> pa.Table:
        cell, told, blobs, blocks = 0, [], [], []
        for bucket, block, kind, payload in each(group, "bucket", "block", "kind", "payload"):
            cell = bucket
            if kind == ASK:
                blobs.append(unpack(payload))
                blocks.append(block)
            else:
                told.append((bucket, block, kind, payload))
        if not blobs:
            return pa.Table.from_batches(messages(told))
        us, ws = np.unique(np.concatenate([b[0] for b in blobs])), np.unique(np.concatenate([b[2] for b in blobs]))
        keys = np.concatenate([np.repeat(np.searchsorted(us, b[0]), b[1]) * len(ws) + np.searchsorted(ws, b[2])[b[3]] for b in blobs])
        pairs, where = np.unique(keys, return_inverse=True)
        del keys
        per = np.concatenate([b[4] for b in blobs])
        pair = np.repeat(where.astype(np.int32), per)
        block_of = np.repeat(small(np.arange(len(blobs))), [len(b[5]) for b in blobs])
        doc, n = np.concatenate([b[5].astype(np.uint32) for b in blobs]), np.concatenate([b[6].astype(np.uint32) for b in blobs])
        train = doc < np.array([b[7][0] for b in blobs])[block_of]
        del blobs, where, per
        c = np.bincount(pair, n * train, len(pairs)).astype(np.int64)
        pu, pw = np.divmod(pairs, len(ws))
        uses = np.bincount(pair, minlength=len(pairs))
        order = np.argsort(pair, kind="stable")
        del pair, train
        told.append((cell, cell, PAIRS, pack(us, ws, small(np.bincount(pu, minlength=len(us))), small(pw), small(c))))
        told.append((cell, cell, USES, pack(small(uses), small(block_of[order]), small(doc[order]), small(n[order]), np.array(blocks, np.int64))))
        told.append((cell, cell, STAT, pack(np.array([np.sum(c == 1), np.sum(c == 2)], np.int64))))
        told += _crowd_row(cell, us, hot, np.bincount(pu, c, len(us)), np.bincount(pu, c > 0, len(us)))
        return pa.Table.from_batches(messages(told))

    return frugal(run)


def _first_asks(buckets: int):
    """What cells ask at first: their words with one table a dish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                _, ws, _, pw, c = unpack(payload)
                release()
                yield from messages(_asks(cell, buckets, ws, np.bincount(pw, c, len(ws)).astype(np.int64), np.bincount(pw, c > 0, len(ws)).astype(np.int64)))

    return run


def _unigram(totals: dict, buckets: int, seed: int):
    """Of a bucket of words: the customers that all cells send, seated; answers go back in the order asked."""

    def run(group: pa.Table) -> pa.Table:
        bucket, asked, cells = 0, [], []
        for b, cell, payload in each(group, "bucket", "block", "payload"):
            bucket = b
            asked.append(unpack(payload))
            cells.append(cell)
        words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        c = np.bincount(at, np.concatenate([a[1] for a in asked]), len(words))
        t = np.bincount(at, np.concatenate([a[2] for a in asked]), len(words)).astype(np.int64)
        rng = np.random.default_rng([seed, bucket])
        d0 = totals["d0"]
        tt, many = (t > 0).astype(np.int64), np.flatnonzero(t > 1)
        size = totals.get("V") or int(tt.sum()) * buckets or 1  # at first: words are dealt evenly by hash
        v0 = totals.get("v0") or THETA0 / d0 + size
        a = np.full(len(many), d0 * v0 / (size + 1))
        seating = Seating(rng, t[many], a, d0)
        for _ in range(BURN_IN):
            tt[many] = seating.sweep(a)
        drawn = np.where(t > 0, rng.gamma(np.maximum(t - d0 * tt, 0.01)), 0)
        sums = np.array([c.sum(), (c > 0).sum(), t.sum(), tt.sum(), (t == 1).sum(), (t == 2).sum(), drawn.sum()], np.float64)
        told = [(0, -1, STAT, pack(sums))]
        start = 0
        for cell, a in zip(cells, asked, strict=True):
            own = at[start : start + len(a[0])]
            start += len(a[0])
            told.append((bucket, cell, KNOWN, pack(small(c[own]), small(t[own]), small(tt[own]), drawn[own].astype(np.float32))))
        return pa.Table.from_batches(messages(told))

    return frugal(run)


class Cell:
    """A cell with the answers of the unigram restaurants."""

    def __init__(self, group: pa.Table, buckets: int, totals: dict, crowd: tuple[np.ndarray, np.ndarray, np.ndarray]):
        answers, self.uses, own = {}, None, None
        for bucket, block, kind, payload in each(group, "bucket", "block", "kind", "payload"):
            self.number = block
            if kind == KNOWN:
                answers[bucket] = unpack(payload)
            elif kind == PAIRS:
                self.us, self.ws, per_u, self.pw, c = unpack(payload)
            elif kind == CROWD:
                own = unpack(payload)
            else:
                self.uses = unpack(payload)
        self.c = c.astype(np.float64)
        self.pu = np.repeat(np.arange(len(self.us)), per_u)
        word = np.zeros((4, len(self.ws)))
        for b, at in by_bucket(((self.ws >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), buckets):
            word[:, at] = answers[b]
        self.count = word[0]
        self.parent = (word[1] - totals["d0"] * word[2] + (THETA0 + totals["d0"] * totals["tt"]) / (totals["V"] + 1)) / (THETA0 + totals["T"])
        # what seating goes by: a draw of the word probabilities
        self.drawn = (word[3] + totals["r"] / (totals["V"] + 1)) / (totals["G"] + totals["r"])
        self.have = np.flatnonzero(self.c > 0)
        self.d = totals["d"]
        # a crowded context's totals are those of all cells: here, what the other cells hold is added
        self.more, self.crowded, self.crowd_t = np.zeros((2, len(self.us))), np.zeros(len(self.us), bool), np.zeros(len(self.us))
        names, c_u, t_u = crowd
        if len(names):
            at = np.minimum(np.searchsorted(names, self.us), len(names) - 1)
            mine = self.crowded = names[at] == self.us
            own_c, own_t = np.bincount(self.pu, self.c, len(self.us)), np.bincount(self.pu, self.c > 0, len(self.us))
            if own is not None:  # the tables here when the totals were taken
                own_t[np.searchsorted(self.us, own[0])] = own[2]
            self.more[0, mine] = c_u[at[mine]] - own_c[mine]
            self.more[1, mine] = t_u[at[mine]] - own_t[mine]
            self.crowd_t[mine] = t_u[at[mine]]
        self.c_u = np.bincount(self.pu, self.c, len(self.us)) + self.more[0]

    def tables(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.pu[self.have], t, len(self.us)) + self.more[1]

    def sweeps(self, seed: int, n: int) -> Iterator[np.ndarray]:
        """The tables of the dishes that have customers, after each of n sweeps."""
        rng = np.random.default_rng([seed, self.number])
        c, u, p = self.c[self.have], self.pu[self.have], self.drawn[self.pw[self.have]]
        t, many = np.ones(len(c)), np.flatnonzero(c > 1)
        u, p = u[many], p[many]
        v = auxiliary(rng, self.tables(t), THETA, self.d)
        for k in np.flatnonzero(self.crowded):  # the same in all cells that share the context
            v[k] = auxiliary(np.random.default_rng([seed, int(self.us[k])]), self.crowd_t[k], THETA, self.d)
        seating = Seating(rng, c[many], self.d * v[u] * p, self.d)
        for _ in range(n):
            t[many] = seating.sweep(self.d * v[u] * p)
            yield t
            v = np.where(self.crowded, v, auxiliary(rng, self.tables(t), THETA, self.d))


def _sample(buckets: int, totals: dict, hot: np.ndarray, crowd: tuple):
    def run(group: pa.Table) -> pa.Table:
        cell = Cell(group, buckets, totals, crowd)
        t = np.ones(len(cell.have))
        for t in cell.sweeps(1, BURN_IN):
            pass
        per_w = np.bincount(cell.pw[cell.have], t, len(cell.ws)).astype(np.int64)
        c_w = np.bincount(cell.pw, cell.c, len(cell.ws)).astype(np.int64)
        told = _asks(cell.number, buckets, cell.ws, c_w, per_w)
        told += _crowd_row(cell.number, cell.us, hot, cell.c_u - cell.more[0], np.bincount(cell.pu[cell.have], t, len(cell.us)))
        return pa.Table.from_batches(messages(told))

    return frugal(run)


def _score(buckets: int, totals: dict, crowd: tuple):
    def run(group: pa.Table) -> pa.Table:
        cell = Cell(group, buckets, totals, crowd)
        parent = cell.parent[cell.pw]
        mean, taken = np.zeros(len(cell.c)), 0
        for i, t in enumerate(cell.sweeps(2, BURN_IN + SAMPLES)):
            if i >= BURN_IN:
                # (c - d t + (theta + d t_u) P(w)) / (theta + c_u), in two arrays
                kept, new = np.zeros(len(cell.c)), (THETA + cell.d * cell.tables(t))[cell.pu]
                kept[cell.have] = cell.d * t
                np.subtract(cell.c, kept, out=kept)
                new *= parent
                kept += new
                del new
                kept /= (THETA + cell.c_u)[cell.pu]
                mean += kept
                taken += 1
                del kept
        mean /= taken
        logp = np.log10(mean, out=mean)
        known = cell.count[cell.pw]
        cell.c = cell.pu = cell.pw = cell.have = cell.ws = cell.us = parent = None  # read no more
        release()
        base = np.log10((known + SMOOTH) / (totals["N"] + SMOOTH * (totals["V"] + 1)))
        per, block, doc, n, names = cell.uses
        pair, n = np.repeat(np.arange(len(per)), per), n.astype(np.float64)
        told = []
        for b, at in by_bucket(block.astype(np.int32), len(names)):
            docs, local = np.unique(doc[at], return_inverse=True)
            sums = [np.bincount(local, n[at] * x[pair[at]], len(docs)) for x in (logp, base, known > 0)]
            told.append((0, int(names[b]), KNOWN, pack(docs, sums[0], sums[1], small(sums[2]))))
        return pa.Table.from_batches(messages(told))

    return frugal(run)


def _documents(totals: dict, group: pa.Table) -> pa.Table:
    """The documents of a block, their sums added up."""
    parts = []
    for kind, payload in each(group, "kind", "payload"):
        if kind == DOCS:
            ids, valid, n_tokens, n_train = unpack(payload)
        else:
            parts.append(unpack(payload))
    doc = np.concatenate([p[0].astype(np.int64) for p in parts])
    score, base, known = (np.bincount(doc, np.concatenate([p[k] for p in parts]), len(ids)) for k in (1, 2, 3))
    return pa.Table.from_arrays(
        [
            pa.array(ids, mask=valid == 0), pa.array(np.arange(len(ids)) >= n_train[0]), pa.array(n_tokens.astype(np.int64)), pa.array(np.rint(known).astype(np.int64)),
            pa.array(np.full(len(ids), totals["N"], np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n_tokens)),
        ],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
    )


# --- the whole --------------------------------------------------------------------------------------------------------


def _crowd_totals(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of the crowded contexts over all cells: (hashes, customers, tables)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                u, c, t = unpack(payload)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(float)), pa.array(t.astype(float))], ["u", "c", "t"])

    found = df.filter(F.col("kind") == CROWD).select("payload").mapInArrow(explode, "u long, c double, t double").groupBy("u").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    found.sort(key=lambda r: np.uint64(np.int64(r["u"]).view(np.uint64)))
    return np.array([r["u"] for r in found], np.int64).view(np.uint64), np.array([r["c"] for r in found]), np.array([r["t"] for r in found])


def _sums(df: DataFrame, size: int) -> np.ndarray:
    """STAT rows added up."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                x = unpack(payload)[0].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["k", "x"])

    found = df.filter(F.col("kind") == STAT).select("payload").mapInArrow(explode, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(size)
    sums[[r["k"] for r in found]] = [r["x"] for r in found]
    return sums


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row; learns where held_out is not true.

    score and base_score are log10 probabilities of the text under this model and under smoothed unigram counts. All steps run here, the last one too, in small batches.
    """
    taken = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    with small_batches(docs.sparkSession):
        return _scored(fixed(taken))


def _scored(taken: DataFrame) -> DataFrame:
    partitions = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, n_tokens = crowded_contexts(taken.select("text"), 2 * partitions)
    buckets = max(-(-n_tokens // CELL), min(partitions, 32))  # cells follow the data: they send one another messages
    cells = stored(taken.mapInArrow(_blocks(buckets, hot), SCHEMA).groupBy("bucket").applyInArrow(_merge(buckets, hot), SCHEMA))
    once, twice = _sums(cells, 2)
    totals = {"d": float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95)), "d0": 0.5}

    def ask(df: DataFrame, seed: int) -> DataFrame:
        answers = stored(df.filter(F.col("kind") == ASK).groupBy("bucket").applyInArrow(_unigram(dict(totals), buckets, seed), SCHEMA))
        n, v, t, tt, one, two, drawn = _sums(answers, 7)
        rng, d0 = np.random.default_rng(seed), float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
        totals.update(N=n, V=v, T=t, tt=tt, d0=d0, G=drawn, r=float(rng.gamma(THETA0 + d0 * tt)), v0=float(auxiliary(rng, tt, THETA0, d0)))
        return answers

    pairs = cells.filter(F.col("kind") == PAIRS)
    first = ask(pairs.mapInArrow(_first_asks(buckets), SCHEMA), 3)
    crowd = _crowd_totals(cells)
    sampled = stored(pairs.union(first.filter(F.col("kind") == KNOWN)).groupBy("block").applyInArrow(_sample(buckets, dict(totals), hot, crowd), SCHEMA))
    discard(first)
    crowd, own = _crowd_totals(sampled), stored(sampled.filter(F.col("kind") == CROWD))
    second = ask(sampled, 4)
    discard(sampled)
    sums = cells.filter(F.col("kind").isin(PAIRS, USES)).union(second.filter(F.col("kind") == KNOWN)).union(own).groupBy("block").applyInArrow(_score(buckets, dict(totals), crowd), SCHEMA)
    whole = cells.filter(F.col("kind") == DOCS).union(sums)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    scored = stored(whole.groupBy("block").applyInArrow(_of_block(dict(totals)), schema))
    for spent in (cells, own, second):
        discard(spent)
    return scored


def _of_block(totals: dict):
    def run(group: pa.Table) -> pa.Table:
        return _documents(totals, group)

    return frugal(run)
