"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND.

Texts are lower-cased (A-Z), ASCII punctuation counts as white space. With L the words of the longest item, the passages
of a document are the windows of 2 L words that start at multiples of L, so that anything as long as an item lies whole
in one. An item's last sentence is its answer and the rest its question; an item that cannot be cut so that both sides have
SHINGLE words is all question. A document leaks an item if one of its passages holds at least OVERLAP of the distinct
five-word shingles of the question and of the answer (a side of fewer words is one shingle).

Every passage is scored against the index: BM25 with a passage's distinct words as the query. An item's threshold is the
least score that a passage with such overlaps can have (all its term weights but the heaviest ones that the allowed
missing shingles could hide), so that retrieving all items at or above it loses none. Weights are divided by that
threshold, and items are cut into blocks with a maximal weight per term and block. Block-max WAND in vectorised form:
bounds are summed for all passages of a batch at once. Terms of many postings are the non-essential lists: a block's bound
counts them as present, at the most that one of its items can gain from them. A block whose bound stays under the threshold
is skipped without touching its postings, the others are scored exactly, and what reaches the threshold is verified by its
shingles.

The index is built by Spark. It goes to the tasks in shards of at most SHARD_BYTES of item text each, whose size is
measured first; a larger benchmark makes more shards, each of them one more scan. Statistics cover all items. Scans
shuffle nothing and batches are cut by size, so memory is bounded by a shard and a few megabytes of text.

Null texts and items without words match nothing. Rows that repeat are reported once by pairs(), judged alike by
clean(). Columns of the documents other than id and text pass through clean(); pairs() does not read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .words import encode, hashes, mix, pieces

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
#: Terms in more than this share of the items (and in more than two) are counted as present in every passage's bound.
COMMON = 0.02
SHARD_BYTES = 4 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
_TABLE[[ord(c) for c in PUNCTUATION]] = ord(" ")


def normal(texts: pa.Array) -> pa.Array:
    """Lower-cased texts, punctuation as spaces: one table lookup a byte."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(_TABLE[np.frombuffer(data, np.uint8)]), None, 0, texts.offset)


def normal_column(text: Column) -> Column:
    return F.translate(text, UPPER + PUNCTUATION, LOWER + " " * len(PUNCTUATION))


@dataclass
class Index:
    """A shard: items are numbered, blocks are BLOCK_ITEMS neighbours, term weights are divided by the item's threshold."""

    ids: list[int]
    length: int  # L, of the longest item of all
    terms: pa.Array
    postings: np.ndarray  # term * number of items + item, sorted
    weights: np.ndarray  # of each posting
    block_terms: np.ndarray  # CSR over essential terms: offsets
    block_at: np.ndarray  # blocks
    block_max: np.ndarray  # largest weight of the term in the block
    base: np.ndarray  # of a block: the most that an item of it gains from the non-essential terms
    sides: list[tuple[np.ndarray, ...]]  # of an item: distinct shingle hashes of question and answer
    widths: list[tuple[int, ...]]  # words of those shingles


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        g = g * PRIME + h[k : len(h) - width + 1 + k]
    return mix(g + np.uint64(width))


def split_item(text: str) -> tuple[str, str]:
    """(question, answer); the answer is the last sentence, empty if either side would be shorter than a shingle."""
    found = re.match(r"(?s)^(.*[.!?])[ \t\r\n\v\f]+(.*)$", text.strip(" \t\r\n\v\f"))
    if found:
        question, answer = found.groups()
        if all(len(normal(pa.array([x])).to_pylist()[0].encode().split()) >= SHINGLE for x in (question, answer)):
            return question, answer
    return text, ""


def _hidden(words: list[bytes], weights: dict[bytes, float]) -> tuple[float, int]:
    """(the most weight that the missing shingles may hide, number of distinct shingles) of one side of an item."""
    n = len({tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}) if words else 0
    missing = n - int(np.ceil(OVERLAP * n - 1e-9))
    # a distinct shingle that occurs at several places may hide a word at each
    places = max(1, len(words) - SHINGLE + 1)
    allowed = missing + (places - n)
    return sum(sorted((weights[w] for w in set(words)), reverse=True)[:allowed]) if missing else 0.0, n


def build(items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, longest: int) -> Index:
    """The index of one shard of (id, text), with the statistics of all items."""
    terms: dict[bytes, int] = {}
    postings: list[list[tuple[int, float]]] = []
    sides, widths = [], []
    for number, (_, text) in enumerate(items):
        parts = [normal(pa.array([x])).to_pylist()[0].encode().split() for x in split_item(text)]
        words = parts[0] + parts[1]
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        weights = {}
        for w, tf in counts.items():
            idf = np.log1p((n_items - df[w.decode()] + 0.5) / (df[w.decode()] + 0.5))
            weights[w] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words)))
        threshold = max(sum(weights.values()) - sum(_hidden(p, weights)[0] for p in parts), 1e-9) * (1 - 1e-9)
        for w, x in weights.items():
            t = terms.setdefault(w, len(terms))
            if t == len(postings):
                postings.append([])
            postings[t].append((number, x / threshold))
        h = [hashes(pa.array(p, pa.binary()).cast(pa.string())) if p else np.zeros(0, np.uint64) for p in parts]
        widths.append(tuple(min(SHINGLE, len(p)) for p in parts))
        sides.append(tuple(np.unique(_grams(x, k)) if k else np.zeros(0, np.uint64) for x, k in zip(h, widths[-1], strict=True)))
    n_blocks = -(-len(items) // BLOCK_ITEMS)
    common, counts, at, top, lists = np.zeros(n_blocks * BLOCK_ITEMS), [], [], [], []
    for w, t in terms.items():
        who, weight = (np.array(x) for x in zip(*postings[t], strict=True))
        lists.append((who, weight))
        best = np.zeros(n_blocks)
        np.maximum.at(best, who // BLOCK_ITEMS, weight)
        if df[w.decode()] > max(2, COMMON * n_items):
            common[who] += weight
            counts.append(0)
        else:
            there = np.flatnonzero(best)
            counts.append(len(there))
            at.append(there)
            top.append(best[there])
    keys = np.concatenate([np.zeros(0, np.int64), *(t * len(items) + who for t, (who, _) in enumerate(lists))])
    values = np.concatenate([np.zeros(0), *(weight for _, weight in lists)])
    return Index(
        [i for i, _ in items], longest, pa.array(list(terms), pa.binary()).cast(pa.string()), keys, values, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0), *top]), common.reshape(n_blocks, BLOCK_ITEMS).max(axis=1), sides, widths,
    )


def shards(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The index, one shard after another, each of a measured size."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    # the words as encode() cuts them
    words = F.array_remove(F.split(F.translate(normal_column(F.col("text")), "\t\n\x0b\f\r", "     "), " "), "")
    coded = items.withColumn("words", words).filter(F.size("words") > 0)
    size = coded.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.avg(F.size("words")).alias("mean"), F.max(F.size("words")).alias("longest")).head()
    if not size["n"]:
        return
    n_shards = max(1, -(-size["bytes"] // shard_bytes))
    coded = coded.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n_shards)))
    terms = coded.select("shard", F.explode(F.array_distinct("words")).alias("term"))
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    for shard in range(n_shards):
        own = coded.filter(F.col("shard") == shard)
        found = terms.filter(F.col("shard") == shard).select("term").distinct().join(frequency, "term").collect()
        rows = own.select("id", "text").orderBy("id", "text").collect()  # shard_bytes of text, about
        if rows:
            yield build([(r["id"], r["text"]) for r in rows], {r["term"]: r["df"] for r in found}, size["n"], float(size["mean"]), size["longest"])


def search(index: Index, texts: pa.Array) -> list[tuple[int, int, float]]:
    """(document, item, score) for each document of texts and item that it leaks; the best score of its passages."""
    codes, words, offsets = encode(normal(texts), lower=False)
    if not len(codes):
        return []
    known = pc.index_in(words, value_set=index.terms)
    term = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)[codes]
    n_postings = np.diff(index.block_terms)
    rare = np.flatnonzero(np.where(term >= 0, n_postings[term], 0))
    doc = np.searchsorted(offsets, rare, "right") - 1
    # a passage's number: the document's first, plus the multiple of L where it starts
    steps = np.maximum(1, -(-np.diff(offsets) // index.length))
    first = np.concatenate([[0], np.cumsum(steps)])
    n_blocks = len(index.base)
    own = first[doc] + (rare - offsets[doc]) // index.length
    n = n_postings[term[rare]]
    at = np.repeat(index.block_terms[term[rare]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    keys = np.repeat(own, n) * n_blocks + index.block_at[at]
    used, inverse = np.unique(keys, return_inverse=True)
    half = np.bincount(inverse, index.block_max[at], len(used))  # bounds by the words of one step of L
    # passage p has the words of steps p and p + 1 of its document
    passages, blocks = used // n_blocks, used % n_blocks
    last = np.isin(passages, first[:-1])  # a document's first step is no second half
    cand = np.concatenate([used, (used - n_blocks)[~last]])
    mass = np.concatenate([half, half[~last]])
    cand, inverse = np.unique(cand, return_inverse=True)
    bound = np.bincount(inverse, mass, len(cand)) + index.base[cand % n_blocks]
    live = cand[bound >= 1 - 1e-9]
    best_of_block = np.flatnonzero(index.base >= 1 - 1e-9)  # blocks that every passage may reach
    if len(best_of_block):
        every = np.repeat(np.arange(first[-1]), len(best_of_block)) * n_blocks + np.tile(best_of_block, first[-1])
        live = np.unique(np.concatenate([live, every]))
    out: dict[tuple[int, int], float] = {}
    for p in np.unique(live // n_blocks).tolist():
        d = int(np.searchsorted(first, p, "right")) - 1
        start = int(offsets[d]) + (p - int(first[d])) * index.length
        stop = min(start + 2 * index.length, int(offsets[d + 1]))
        present = np.unique(term[start:stop])
        open_blocks = live[np.searchsorted(live, p * n_blocks) : np.searchsorted(live, (p + 1) * n_blocks)] % n_blocks
        items, score, _ = scored(index, present[present >= 0], open_blocks)
        hits = items[score >= 1]
        h = hashes(words.take(pa.array(codes[start:stop]))) if len(hits) else None
        for item in hits.tolist():
            if all(not k or _holds(h, side, k) for side, k in zip(index.sides[item], index.widths[item], strict=True)):
                out[d, item] = max(out.get((d, item), 0.0), float(score[np.searchsorted(items, item)]))
    return [(d, item, s) for (d, item), s in out.items()]


def scored(index: Index, terms: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(items, scores, postings read): the items of these blocks that have one of the terms. Postings of other blocks are not read."""
    n = len(index.ids)
    low = np.searchsorted(index.postings, (terms[:, None] * n + blocks[None, :] * BLOCK_ITEMS).ravel())
    high = np.searchsorted(index.postings, (terms[:, None] * n + np.minimum((blocks[None, :] + 1) * BLOCK_ITEMS, n)).ravel())
    size = high - low
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    items, inverse = np.unique(index.postings[at] % max(n, 1), return_inverse=True)
    return items, np.bincount(inverse, index.weights[at], len(items)), len(at)


def _holds(passage: np.ndarray, side: np.ndarray, width: int) -> bool:
    return np.isin(side, _grams(passage, width)).sum() >= OVERLAP * len(side) - 1e-9


def pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, score): each document and item that it leaks, with its best score over the threshold."""
    kind, item_kind = docs.select(F.col(f"`{doc_id}`")).dtypes[0][1], benchmark.select(F.col(f"`{item_id}`")).dtypes[0][1]
    schema = f"doc_id {kind}, item_id {item_kind}, score double"
    found = None
    for index in shards(benchmark, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                hits = search(shared.value, piece.column("text"))
                rows = pa.array([d for d, _, _ in hits], pa.int64())
                ids = piece.column("id").take(rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array([shared.value.ids[i] for _, i, _ in hits], item_type), pa.array([s for _, _, s in hits], pa.float64())], ["doc_id", "item_id", "score"])

        item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
        part = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs without the documents that leak an item. One scan a shard, nothing is shuffled."""
    for index in shards(benchmark, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                start = 0
                for piece in pieces(iter([batch.select([text])]), text):
                    for d, _, _ in search(shared.value, piece.column(0)):
                        keep[start + d] = False
                    start += piece.num_rows
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: DuckDB SQL of pairs() over documents and benchmark: doc_id and item_id.
SQL = r"""
WITH norm AS (
  SELECT item_id, text FROM benchmark WHERE text IS NOT NULL
), cut AS (
  SELECT item_id, text, regexp_extract(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '(?s)^(.*[.!?])[ \t\r\n\v\f]+(.*)$', ['q', 'a']) AS s FROM norm
), word AS (
  SELECT item_id,
    list_filter(string_split_regex({text}, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split_regex({q}, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS q,
    list_filter(string_split_regex({a}, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS a FROM cut
), side AS (
  SELECT item_id, w, CASE WHEN len(q) >= 5 AND len(a) >= 5 THEN [q, a] ELSE [w] END AS parts FROM word WHERE len(w) > 0
), part AS (
  SELECT item_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS side FROM side
), gram AS (
  SELECT DISTINCT item_id, side, least(5, len(p)) AS k, array_to_string(p[i:i + least(5, len(p)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(p) - 3, 2))) AS i FROM part)
), need AS (
  SELECT item_id, side, count(*) AS n, max(count(*)) OVER () AS x FROM gram GROUP BY item_id, side
), longest AS (
  SELECT max(len(w)) AS l FROM word
), doc AS (
  SELECT doc_id, list_filter(string_split_regex({text}, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), doc_gram AS (
  SELECT doc_id, k, i - 1 AS i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM gram))
), hit AS (
  SELECT d.doc_id, d.i, d.k, g.item_id, g.side, g.g FROM doc_gram d JOIN gram g ON d.g = g.g AND d.k = g.k
), placed AS (
  SELECT h.*, unnest([i // l, i // l - 1]) AS p, l FROM hit h, longest
), held AS (
  SELECT doc_id, item_id, side, p, count(DISTINCT g) AS n FROM placed WHERE p >= 0 AND i >= p * l AND i + k <= (p + 2) * l GROUP BY ALL
), passed AS (
  SELECT h.doc_id, h.item_id, h.p, count(*) AS sides FROM held h JOIN need n ON h.item_id = n.item_id AND h.side = n.side WHERE 10 * h.n >= 8 * n.n GROUP BY ALL
)
SELECT DISTINCT doc_id, item_id FROM passed JOIN (SELECT item_id, count(*) AS sides FROM need GROUP BY item_id) USING (item_id, sides)
"""


def _sql_normal(expression: str) -> str:
    quoted = (UPPER + PUNCTUATION).replace("'", "''")
    return f"translate({expression}, '{quoted}', '{LOWER}{' ' * len(PUNCTUATION)}')"


SQL = SQL.replace("{text}", _sql_normal("text")).replace("{q}", _sql_normal("s.q")).replace("{a}", _sql_normal("s.a"))
