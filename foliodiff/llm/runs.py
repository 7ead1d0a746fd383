"""Periodic runs in texts, by branching tandem repeats in a suffix tree (Stoye and Gusfield).

A run is a longest stretch of words with a smallest period. In the suffix tree of a text, words ww that stop repeating right behind them
("branching tandem repeats") are pairs of leaves, |w| apart, in different children of a node of depth |w|. Going through the leaves of all
children but the largest finds them in O(n log n); turning them to the left and merging what then coincides gives the maximal runs.

The tree is the one of suffix array and common prefixes, built with numpy for all texts of a batch at once: ranks by prefixes of 1, 2, 4 ...
words, prefixes of neighbours from the same ranks, nodes from the nearest smaller values. Ranks start with the document, so that no suffix has
a prefix with another document's in common. A run of at least `least` words and `fold` periods repeats a window of least * (fold - 1) / fold words
one period on; texts in which no window of that length (rounded down to a power of two) occurs twice have no run, and need no tree.

One scan, no shuffle. A text is handled whole in one task, in memory proportional to its words.

Defined results. Null, empty and blank texts have no words and no runs. Repeated rows and ids are judged one by one. Extra columns stay out
unless named in keep. Empty tables give no rows. Of runs with the same exponent the first, then the one of the shorter period, is the greatest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, words_of
from .words import encode, mix, pieces

#: Words of documents whose trees are built together, and leaves looked at together.
TREE_WORDS, LEAVES = 1 << 20, 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapse(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), least: int = 24, fold: int = 3) -> DataFrame:
    """keep, n_words, runs (array of start, length, period, by start and period) and kept_text: words that no run contains after its first period."""
    made = unused(docs.select(*keep), "n_words", "runs", "kept_text")
    source = unused(docs.select(*keep), "_text")[0]
    kept = docs.select(*keep).schema

    def collapse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, source):
            codes, distinct, bounds = encode(piece.column(piece.schema.get_field_index(source)), lower=False)
            doc, start, length, period = runs_of(codes, bounds, least, fold)
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, bounds[doc] + start + period, 1)
            np.add.at(gone, bounds[doc] + start + length, -1)
            stays = np.cumsum(gone)[: len(codes)] == 0
            left = np.concatenate([[0], np.cumsum(stays, dtype=np.int64)])[bounds]
            words = pc.take(distinct, pa.array(codes[stays]))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words), " ")
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            offsets = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            columns = [piece.column(i) for i, name in enumerate(piece.schema.names) if name != source]
            names = [name for name in piece.schema.names if name != source]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), texts], [*names, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{made[0]} bigint", f"{made[1]} array<{RUN}>", f"{made[2]} string"])
    return docs.select(*keep, F.col(text).cast("string").alias(source)).mapInArrow(collapse_batches, schema)


def greatest(runs: Column) -> Column:
    """The run with the most periods; null without runs. length / period is compared exactly, as a fraction."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))


def looped(text: Column, number: Column) -> Column:
    """text with a periodic tail where number is divisible by 10, the workload of the query: its words from a = g % n on repeat the first
    1 + (n - a) / (3 + g % 8) of them, with g = number / 10. Other texts, those without words and those with a null number are returned as they are."""
    words, g = words_of(text), F.floor(number / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((number % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int, fold: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, in that order, of the documents codes[bounds[i]:bounds[i + 1]]."""
    if least < 2 * fold or fold < 2:
        raise ValueError("runs must have two periods, and twice as many words as periods, or more")
    found = [[np.zeros(0, np.int64)] * 4]
    for group in _groups(_repeating(codes, bounds, least * (fold - 1) // fold), bounds):
        sizes = bounds[group + 1] - bounds[group]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(bounds[group] - ends[:-1], sizes)
        doc, start, length, period = _tree_runs(codes[at].astype(np.int64), ends, least, fold)
        found.append([group[doc], start - ends[doc], length, period])
    doc, start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def _repeating(codes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Documents in which a window occurs twice: all of them, and by chance of 64-bit hashes others."""
    held, width = mix(codes.astype(np.uint64) + np.uint64(1)), 1
    while 2 * width <= window and len(held) > width:
        held = mix(held[:-width] * np.uint64(0x9E3779B97F4A7C15) + held[width:])
        width *= 2
    if 2 * width <= window:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(np.arange(len(held)) + width <= bounds[1:][doc[: len(held)]])
    keys = held[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    return np.unique(doc[inside[order[1:][keys[order[1:]] == keys[order[:-1]]]]])


def _groups(docs: np.ndarray, bounds: np.ndarray) -> Iterable[np.ndarray]:
    """docs, in groups of about TREE_WORDS words."""
    if len(docs):
        share = np.cumsum(bounds[docs + 1] - bounds[docs]) // TREE_WORDS
        yield from np.split(docs, np.flatnonzero(np.diff(share)) + 1)


def _ranks(codes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of suffixes by their first 1, 2, 4 ... words, until all differ."""
    n, at = len(codes), np.arange(len(codes))
    key, ranks = doc * (codes.max() + 1) + codes, []
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width = 1 << len(ranks)
        ranks.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        if new[-1] == n - 1:
            return ranks
        beyond = at + width
        key = rank * (n + 1) + np.where(beyond < end, rank[np.minimum(beyond, n - 1)] + 1, 0)


def _common(order: np.ndarray, ranks: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that each suffix has in common with the one before it in order, at the front."""
    a, b, n = order[:-1].copy(), order[1:].copy(), len(order)
    total = np.zeros(n, np.int64)
    stop_a, stop_b = end[a], end[b]
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < stop_a) & (b < stop_b)
        same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << level
        a, b = a + step, b + step
        total[1:] += step
    return total


def _nearest_smaller(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last smaller value before each, and of the first smaller one after it."""
    n = len(values)
    before, after, stack = [0] * n, [n] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = i
        before[i] = (before[stack[-1]] if values[stack[-1]] == v else stack[-1]) if stack else 0
        stack.append(i)
    for i in range(n - 1, -1, -1):  # equal values share what comes after the last of them
        if (j := after[i]) < n and values[j] == values[i]:
            after[i] = after[j]
    return np.array(before), np.array(after)


def _tree_runs(codes: np.ndarray, bounds: np.ndarray, least: int, fold: int) -> tuple[np.ndarray, ...]:
    n = len(codes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][doc]
    ranks = _ranks(codes, doc, end)
    rank = ranks[-1].astype(np.int64)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    depth = _common(order, ranks, end)
    del ranks
    left, right = _nearest_smaller(depth.tolist())  # of the cut before each leaf: its node holds the leaves left ... right - 1

    cuts = np.flatnonzero(depth > 0)
    cuts = cuts[np.argsort(left[cuts] * (n + 1) + depth[cuts], kind="stable")]  # a node's cuts together, in order
    fresh = np.concatenate([[True], (np.diff(left[cuts]) != 0) | (np.diff(depth[cuts]) != 0)]) if len(cuts) else np.zeros(0, bool)
    node = np.cumsum(fresh) - 1
    lows, highs, depths = left[cuts[fresh]], right[cuts[fresh]], depth[cuts[fresh]]
    # children: from a node's first leaf or a cut up to the next cut or its last leaf
    child_node = np.concatenate([np.arange(len(lows)), node])
    child_low = np.concatenate([lows, cuts])
    by_node = np.lexsort((child_low, child_node))
    child_node, child_low = child_node[by_node], child_low[by_node]
    last = np.concatenate([child_node[1:] != child_node[:-1], [True]]) if len(child_node) else np.zeros(0, bool)
    child_high = np.where(last, highs[child_node], np.concatenate([child_low[1:], [0]]) if len(child_low) else child_low)
    size = child_high - child_low
    by_size = np.lexsort((size, child_node))
    largest = by_size[np.flatnonzero(np.concatenate([child_node[by_size][1:] != child_node[by_size][:-1], [True]]))] if len(by_size) else by_size
    small = np.ones(len(size), bool)
    small[largest] = False
    small = np.flatnonzero(small)

    starts, periods = [], []
    for some in np.split(small, np.flatnonzero(np.diff(np.cumsum(size[small]) // LEAVES)) + 1) if len(small) else []:
        leaf = np.repeat(child_low[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
        at = np.repeat(child_node[some], size[some])
        i, d, low, high = order[leaf], depths[at], lows[at], highs[at]
        for first in (i, i - d):  # the leaf is the first or the second copy
            second = first + d
            other = np.where(first == i, second, first)
            ok = (other >= 0) & (other < n)
            place = rank[np.where(ok, other, 0)]
            ok &= (place >= low) & (place < high)
            f, s, p = first[ok], second[ok], d[ok]
            beyond = s + p
            ends = beyond >= end[f]
            branches = ends | (codes[s] != codes[np.where(ends, 0, beyond)])
            f, p = f[branches], p[branches]
            need = f + 2 * p - np.maximum(least, fold * p)  # where a run that is long enough starts at the latest
            far = need >= bounds[doc[f]]
            far[far] = codes[need[far]] == codes[need[far] + p[far]]
            starts.append(f[far])
            periods.append(p[far])
    starts, periods = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, periods))
    return _merge(codes, bounds, doc, starts, periods, least, fold)


def _merge(codes, bounds, doc, starts, periods, least: int, fold: int) -> tuple[np.ndarray, ...]:
    """Turns each repeat to the left as far as it goes. Repeats that end together and are covered by a shorter period belong to its run."""
    pairs = np.unique(np.stack([starts + 2 * periods, periods], axis=1), axis=0)
    found, here, at_end = [], [], -1
    for stop, p in pairs.tolist():
        if stop != at_end:
            here, at_end = [], stop
        s = stop - 2 * p
        if any(began <= s for began in here):  # the square repeats a shorter word
            continue
        low, step = int(bounds[doc[s]]), 64
        while s > low:
            a = max(low, s - step)
            differs = np.flatnonzero(codes[a:s] != codes[a + p : s + p])
            if len(differs):
                s = a + int(differs[-1]) + 1
                break
            s, step = a, 2 * step
        here.append(s)
        if stop - s >= max(least, fold * p):
            found.append((int(doc[s]), s, stop - s, p))
    return tuple(np.array(found, np.int64).reshape(-1, 4).T)
