"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a text.

A document is a sparse vector: its lower-cased words hashed to BUCKETS positions, weighted by their share of the text,
and a few dense positions for structure (shares of upper-case, digit and symbol characters, word length, share of
distinct words, share of the most frequent word, share of words that repeat the one before, words a line, lines) and metadata (length). The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_k [(sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2])

so the pairwise interactions of all features cost one pass over the features that a document has.

The model is fitted with Adam on at most max_rows labelled documents: those of the smallest hash of their id, so the
sample is the same at every run. That sample, max_rows documents of at most BUCKETS features, is all that reaches the
driver; the model has a fixed size and is broadcast. Every document is scored, on its whole text, in one scan that
shuffles nothing.

Null and empty texts have no words and are scored by the bias and dense features. Labels that are null, or belong to a
null id, are not learnt from; with no labelled rows the score is 0.5. Repeated rows are scored alike. The label, id,
language and source of a row are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused
from .words import encode, hashes, per_doc, pieces

BUCKETS = 1 << 15
DENSE = 11
SIZE = BUCKETS + DENSE
FACTORS = 8
MAX_ROWS = 4000
THRESHOLD = 0.3


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # (SIZE,)
    factors: np.ndarray  # (SIZE, FACTORS)


def dense_features(texts: pa.Array, codes: np.ndarray, words: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """(documents, DENSE) structure statistics, each about 0 to 1."""
    n = np.diff(offsets).astype(np.float64)
    some = np.maximum(n, 1)

    def share(pattern: str) -> np.ndarray:
        found = pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.float64)
        return per_doc(found[codes], offsets)

    chars = np.maximum(per_doc(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64)[codes], offsets), 1)
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1.0
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    again = np.concatenate([[False], codes[1:] == codes[:-1]])[: len(codes)]
    again[offsets[:-1][offsets[:-1] < len(codes)]] = False  # a document's first word repeats none
    stutter = per_doc(again.astype(np.float64), offsets) / some
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            counts = np.unique(codes[a:b], return_counts=True)[1]
            distinct[i], top[i] = len(counts), counts.max()
    return np.stack(
        [
            share("[A-Z]") / chars, share("[0-9]") / chars, share(r"[#*$%&|<>!]") / chars, share(r"^[|#*$%&<>]+$") / some,
            chars / some / 20, distinct / some, top / some, stutter, np.log1p(some / lines) / 8, np.log1p(lines) / 8, np.log1p(n) / 12,
        ],
        axis=1,
    )


def featurise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, offsets, dense) of a batch: words' positions and their share, not yet merged by bucket."""
    codes, words, offsets = encode(texts, lower=False)
    dense = dense_features(texts, codes, words, offsets)
    lowered = hashes(pc.ascii_lower(words)) if len(words) else np.zeros(0, np.uint64)
    buckets = (lowered % np.uint64(BUCKETS)).astype(np.int32)
    length = np.sqrt(np.maximum(np.diff(offsets), 1)).astype(np.float32)
    return buckets[codes], np.repeat(1 / length, np.diff(offsets)).astype(np.float32), offsets, dense.astype(np.float32)


def logits(model: Model, buckets: np.ndarray, weights: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The linear-time identity. Equal words of a document add up to one feature in the first sum; the second sum needs
    the squares of the merged weights, so words are merged by bucket within each document first."""
    out = np.full(len(offsets) - 1, model.bias)
    dl, dv = model.linear[BUCKETS:], model.factors[BUCKETS:]
    out += dense @ dl
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        s, q = dense[i] @ dv, (dense[i] ** 2) @ (dv**2)
        if b > a:
            at, n = np.unique(buckets[a:b], return_counts=True)
            x = n * weights[a]
            v = model.factors[at]
            out[i] += x @ model.linear[at]
            s, q = s + x @ v, q + (x * x) @ (v * v)
        out[i] += 0.5 * float(np.sum(s * s - q))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 30, rate: float = 0.02, decay: float = 1e-3, batch: int = 256, seed: int = 7) -> Model:
    """Adam on the logistic loss. rows: (positions, values) of each document."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
    if not len(rows):
        return Model(0.0, model.linear, np.zeros((SIZE, FACTORS)))
    params = np.concatenate([model.linear[:, None], model.factors], axis=1)
    m, v, bias, mb, vb, t = np.zeros_like(params), np.zeros_like(params), 0.0, 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            chosen, t = order[start : start + batch], t + 1
            at = np.concatenate([rows[i][0] for i in chosen])
            x = np.concatenate([rows[i][1] for i in chosen]).astype(np.float64)
            doc = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            used, local = np.unique(at, return_inverse=True)
            p = params[used][local]
            xv = x[:, None] * p[:, 1:]
            sums = np.stack([np.bincount(doc, xv[:, k], len(chosen)) for k in range(FACTORS)], axis=1)
            squares = np.bincount(doc, (xv * xv).sum(axis=1), len(chosen))
            z = bias + np.bincount(doc, x * p[:, 0], len(chosen)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = (sigmoid(z) - labels[chosen]) / len(chosen)
            pull = (error[doc] * x)[:, None]
            grads = np.concatenate([pull, pull * (sums[doc] - xv)], axis=1)
            g = np.stack([np.bincount(local, grads[:, k], len(used)) for k in range(FACTORS + 1)], axis=1) + decay * params[used]
            m[used] = 0.9 * m[used] + 0.1 * g
            v[used] = 0.999 * v[used] + 0.001 * g * g
            step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            params[used] -= step * m[used] / (np.sqrt(v[used]) + 1e-8)
            gb = error.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            bias -= step * mb / (np.sqrt(vb) + 1e-8)
    return Model(float(bias), params[:, 0].copy(), params[:, 1:].copy())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        buckets, weights, offsets, dense = featurise(piece.column("text"))
        at, values = [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            k, n = np.unique(buckets[a:b], return_counts=True)
            at.append(np.concatenate([k, np.arange(BUCKETS, SIZE)]).astype(np.int32).tobytes())
            values.append(np.concatenate([n * (weights[a] if b > a else 0), dense[i]]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([piece.column("label").cast(pa.int32()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["label", "at", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most max_rows of the labelled documents, those whose id has the smallest hash.

    Of several labels of one id the smallest counts, of several documents of one id the one whose text sorts first.
    """
    chosen = (
        labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .join(F.broadcast(chosen), "id")  # max_rows rows of two numbers
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
        .select("label", "text")
        .mapInArrow(_features, "label int, at binary, x binary")
        .collect()
    )
    vectors = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["at"], rows[i]["x"], rows[i]["label"]))
    return train([vectors[i] for i in order], np.array([rows[i]["label"] for i in order], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) with score double and predicted int (score >= threshold), which replace columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    (read,) = unused(docs, "read") if text not in keep else (text,)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * (FACTORS + 1) numbers, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sigmoid(logits(shared.value, *featurise(p.column(0)))) for p in pieces(iter([batch.select([read])]), read)]
            values = np.concatenate(found) if found else np.zeros(0)
            kept = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    kept = [F.col(f"`{c}`") for c in keep]
    wide = docs.select(*kept) if text in keep else docs.select(*kept, F.col(f"`{text}`").alias(read))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return wide.mapInArrow(scored, f"{fields}score double, predicted int")
