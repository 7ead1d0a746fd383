"""Substring deduplication by level-wise doubling of word windows.

A window of LONG = 20 words whose words also start earlier (smaller document id, or earlier in the same document) is
removed; a word goes if any such window covers it. Windows are judged on the input.

Level 1 looks for repeated windows of half the length. A repeated 20-word window repeats all its 11 windows of ten
words, the one of smallest hash included, so it is enough to send that one for each window (winnowing): about a sixth
of the positions, none missed. Level 2 extends what was repeated to twice the length: the hash of 20 words is made of
those of its two halves, only for windows whose chosen half was repeated. Nothing longer is looked for, since every
longer repeat is covered by its 20-word windows; a level without candidates sends nothing.

Each level is one packed exchange by hash and one by block (see blobs). Within a block, equal windows are reduced to
the first before they are sent, so that a passage found in a third of all documents makes one entry a block. Hashes have
64 bits; two different windows of n are taken for equal with probability n^2 / 2^65, and only if that holds at both levels.

Null texts have no words. Documents are known by id and text: rows that repeat both count once and share the result;
null ids sort first. Texts of any length are handled whole, an empty table gives an empty table. dedup() keeps extra columns; those named n_words,
n_removed or kept_text are replaced. An input that is no plain scan of files is written first (see blobs). Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import ASK, BLOCK, DOCS, KNOWN, SCHEMA, block_name, bucket_of, by_bucket, doc_keys, pack, rows, runs, unpack
from .common import fixed, unused
from .words import encode, hashes, mix, pieces

LONG = 20
HALF = LONG // 2
#: Text for each bucket of hashes; a bucket is one task's group, and gets about half as many bytes of entries.
BUCKET_BYTES = 64 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _windows(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(half hashes, starts of the long windows, the chosen half of each, offsets) of a piece, by position in it."""
    codes, words, offsets = encode(piece.column("text"), lower=False)
    h = hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = len(h) - LONG + 1
    if count < 1:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), offsets
    g = np.zeros(len(h) - HALF + 1, np.uint64)
    for k in range(HALF):
        g = g * PRIME + h[k : len(h) - HALF + 1 + k]
    g = mix(g)
    chosen, span = np.arange(len(g)), 1
    while span < HALF + 1:  # the position of the smallest of span hashes, leftmost first, for growing span
        step = min(span, HALF + 1 - span)
        left, right = chosen[:-step], chosen[step:]
        chosen = np.where(g[right] < g[left], right, left)
        span += step
    starts = np.arange(count)
    whole = starts + LONG <= np.repeat(offsets[1:], np.diff(offsets))[:count]
    return g, starts[whole], chosen[:count][whole], offsets


def _level_1(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, keys, n_docs = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            d1, d2 = (np.concatenate(x) for x in zip(*keys, strict=True))
            block = block_name(number)
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            first, size = runs(h)
            many = np.repeat(size > 1, size)
            out = [(bucket_of(block, buckets), block, DOCS, pack(d1, d2)), (bucket_of(block, buckets), block, KNOWN, pack(doc[many], pos[many]))]
            h, doc, pos, many = h[first], doc[first], pos[first], size > 1
            for b, at in by_bucket((h % np.uint64(buckets)).astype(np.int32), buckets):
                out.append((b, block, ASK, pack(h[at], doc[at], pos[at], many[at])))
            return rows(out)

        total = 0
        for piece in pieces(batches):
            g, _, chosen, offsets = _windows(piece)
            anchors = np.unique(chosen)
            doc = np.searchsorted(offsets, anchors, "right") - 1
            held.append((g[anchors], (doc + n_docs).astype(np.uint32), (anchors - offsets[doc]).astype(np.uint32)))
            keys.append((piece.column("d1").to_numpy(), piece.column("d2").to_numpy()))
            n_docs, total = n_docs + piece.num_rows, total + len(anchors)
            if total >= BLOCK:
                yield flush()
                number, held, keys, n_docs, total = number + 1, [], [], 0, 0
        if n_docs:
            yield flush()

    return run


def _asked(group: pa.Table) -> tuple[list, list[list[np.ndarray]], np.ndarray]:
    """(rows that pass through, unpacked entries, their block for each entry) of a bucket."""
    through, entries, blocks = [], [], []
    for block, kind, payload in zip(*(group.column(c).to_pylist() for c in ("block", "kind", "payload")), strict=True):
        if kind == ASK:
            entries.append(unpack(payload))
            blocks.append(np.full(len(entries[-1][0]), block))
        else:
            through.append((0, block, kind, payload))
    return through, entries, np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def _told(through: list, block: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block, doc, pos = block[order], doc[order], pos[order]
    for s, n in zip(*runs(block), strict=True):
        through.append((0, int(block[s]), KNOWN, pack(doc[s : s + n], pos[s : s + n])))
    return pa.Table.from_batches([rows(through)])


def _answer_1(group: pa.Table) -> pa.Table:
    through, entries, block = _asked(group)
    if not entries:
        return pa.Table.from_batches([rows(through)])
    h, doc, pos, many = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.argsort(h, kind="stable")
    _, size = runs(h[order])
    keep = order[np.repeat(size > 1, size)]
    keep = keep[~many[keep]]  # the others are known to their block
    return _told(through, block[keep], doc[keep], pos[keep])


def _level_2(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, keys, n_docs, total = 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            d1, d2 = (np.concatenate(x) for x in zip(*keys, strict=True))
            block = block_name(number)
            order = np.lexsort((pos, d1[doc], h))
            h, doc, pos = h[order], doc[order], pos[order]
            least = _least(h, d1[doc], pos)
            out = [(bucket_of(block, buckets), block, DOCS, pack(d1, d2)), (bucket_of(block, buckets), block, KNOWN, pack(doc[~least], pos[~least]))]
            h, doc, pos = h[least], doc[least], pos[least]
            for b, at in by_bucket((h % np.uint64(buckets)).astype(np.int32), buckets):
                own, local = np.unique(doc[at], return_inverse=True)
                out.append((b, block, ASK, pack(h[at], local.astype(np.uint32), pos[at], own, d1[own])))
            return rows(out)

        for piece in pieces(batches):
            g, starts, chosen, offsets = _windows(piece)
            repeated = np.zeros(max(int(offsets[-1]), 1), bool)
            for i, at in enumerate(piece.column("at").to_pylist()):
                repeated[offsets[i] + np.frombuffer(at, np.uint32)] = True
            starts = starts[repeated[chosen]]
            doc = np.searchsorted(offsets, starts, "right") - 1
            h = mix(g[starts] * PRIME + g[starts + HALF]) if len(starts) else np.zeros(0, np.uint64)
            held.append((h, (doc + n_docs).astype(np.uint32), (starts - offsets[doc]).astype(np.uint32)))
            keys.append((piece.column("d1").to_numpy(), piece.column("d2").to_numpy()))
            n_docs, total = n_docs + piece.num_rows, total + len(starts)
            if total >= BLOCK:
                yield flush()
                number, held, keys, n_docs, total = number + 1, [], [], 0, 0
        if n_docs:
            yield flush()

    return run


def _least(h: np.ndarray, d1: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of entries sorted by (h, d1, pos), those that are as early as the first of their hash."""
    first, size = runs(h)
    return (d1 == np.repeat(d1[first], size)) & (pos == np.repeat(pos[first], size))


def _answer_2(group: pa.Table) -> pa.Table:
    through, entries, block = _asked(group)
    if not entries:
        return pa.Table.from_batches([rows(through)])
    h, pos = np.concatenate([e[0] for e in entries]), np.concatenate([e[2] for e in entries])
    doc, d1 = np.concatenate([e[3][e[1]] for e in entries]), np.concatenate([e[4][e[1]] for e in entries])
    order = np.lexsort((pos, d1, h))
    late = order[~_least(h[order], d1[order], pos[order])]
    return _told(through, block[late], doc[late], pos[late])


def _of_docs(group: pa.Table) -> pa.Table:
    """(d1, d2, at): for each document of a block, the positions that were told, sorted."""
    found, d1, d2 = [], None, None
    for kind, payload in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), strict=True):
        if kind == DOCS:
            d1, d2 = unpack(payload)
        else:
            found.append(unpack(payload))
    doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.uint32)
    first, size = runs(doc)
    at = pa.array([pos[s : s + n].tobytes() for s, n in zip(first, size, strict=True)], pa.binary())
    return pa.Table.from_arrays([pa.array(d1[doc[first]]), pa.array(d2[doc[first]]), at], ["d1", "d2", "at"])


def _level(df: DataFrame, scan, answer, buckets: int) -> DataFrame:
    asked = df.mapInArrow(scan(buckets), SCHEMA)
    told = asked.groupBy("bucket").applyInArrow(answer, SCHEMA)
    per_doc = told.groupBy("block").applyInArrow(_of_docs, "d1 long, d2 long, at binary")
    return per_doc.dropDuplicates(["d1", "d2"])  # rows that repeat id and text


def covered_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d1, d2, at): the starts of the windows to remove, as packed 32-bit numbers, of each document that has any."""
    d1, d2 = doc_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = fixed(docs.select(d1.alias("d1"), d2.alias("d2"), F.col(f"`{text}`").alias("text")))
    size = keyed.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    buckets = max(-(-size // BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    halves = _level(keyed, _level_1, _answer_1, buckets)
    candidates = keyed.join(halves, ["d1", "d2"]).sortWithinPartitions("d1", "d2")  # sorted: the same blocks if run again
    return _level(candidates, _level_2, _answer_2, buckets)


def _removed(text: str, at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for whole, starts in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(at).to_pylist(), strict=True):
                words = (whole or b"").split()
                n_words.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    first = np.frombuffer(starts, np.uint32).astype(np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + LONG, -1)
                    words = [w for w, n in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not n]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            rest = [(n, batch.column(n)) for n in batch.schema.names if n not in (text, at)]
            columns = [*(c for _, c in rest), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*(n for n, _ in rest), "n_words", "n_removed", "kept_text"])

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) with n_words, n_removed and kept_text, the kept words joined by one space."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_removed", "kept_text")]
    k1, k2, whole, at = unused(docs, "k1", "k2", "whole", "at")
    d1, d2 = doc_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    starts = covered_windows(docs, doc_id, text).select(F.col("d1").alias(k1), F.col("d2").alias(k2), F.col("at").alias(at))
    kept = [F.col(f"`{c}`") for c in keep]
    joined = docs.select(*kept, F.col(f"`{text}`").alias(whole), d1.alias(k1), d2.alias(k2)).join(starts, [k1, k2], "left").select(*kept, whole, at)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    fields = f"{fields}, " if fields else ""
    return joined.mapInArrow(_removed(whole, at), f"{fields}n_words long, n_removed long, kept_text string")
