"""Best-fit packing into bins of several permitted capacities.

Documents become pieces of at most the largest capacity: their words and one end mark count one token each, and a longer
document is cut, nothing is dropped. Pieces are dealt by hash into shards of about SHARD pieces, and each shard is
packed on its own, largest piece first:

1. A piece goes to the open bin that it fills best, the one of least room among those with room for it.
2. If there is none, a bin is opened. For each permitted capacity the packer looks ahead: it fills the bin from the
   pieces that are left, greedily by size, and opens the capacity of least cost per token so placed.
3. At the end, each bin is cut down to the smallest permitted capacity that holds its contents.

The cost of a capacity c is c + c^2 / KNEE, tokens and their pairwise attention. The shards make the work linear and
bound each task; what they cost is at most a few part-filled bins a shard.

A null or empty text is a piece of one token, its end mark. Repeated rows are packed each on their own. Ties go by id,
text hash and piece number. Columns of the input other than id and text are not read, whatever their names; an empty
table gives no rows. Texts of any length are cut whole, and shards are counted in pieces, so that one long text cannot
overfill a shard. Each placed piece carries the SHA-256 of its words; bin_texts() gives the packed texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import doc_keys
from .common import stored, words_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)
KNEE = 65536
SHARD = 50_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / KNEE


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each piece; lengths in decreasing order, none above the largest capacity."""
    sizes = sorted(capacities)
    left = Counter(lengths)
    avail = sum(1 << n for n in left)  # bit n: pieces of n tokens are left
    rooms = 0  # bit r: an open bin has room for r tokens
    by_room: dict[int, list[int]] = {}
    filled: list[int] = []
    placed: list[tuple[int, int]] = []

    def ahead(room: int) -> int:
        """Tokens that greedy filling would put into room."""
        start, below = room, avail
        while room > 0 and (below := below & ((1 << (room + 1)) - 1)):
            n = below.bit_length() - 1
            room -= n * min(left[n], room // n)
            below ^= 1 << n
        return start - room

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            avail ^= 1 << n
        if rooms >> n:
            over = rooms >> n
            room = n + (over & -over).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                rooms ^= 1 << room
        else:
            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / (n + ahead(c - n)), c))
            b, room = len(filled), size
            filled.append(0)
        placed.append((b, filled[b]))
        filled[b] += n
        room -= n
        if room:
            if not by_room.get(room):
                by_room[room] = []
                rooms |= 1 << room
            by_room[room].append(b)
    final = [min(c for c in sizes if c >= f) for f in filled]
    return [(b, final[b], offset) for b, offset in placed]


def pieces_of(docs: DataFrame, doc_id: str, text: str, largest: int) -> DataFrame:
    """(doc_id, d1, d2, piece, n_tokens, piece_sha256, piece_text) for each piece of each document; words are joined by one space."""
    d1, d2 = doc_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    split = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), d1.alias("d1"), d2.alias("d2"), words_of(F.col(f"`{text}`")).alias("words"))
    n = F.size("words") + 1
    start = lambda p: p * largest
    cut = F.transform(
        F.sequence(F.lit(0), ((n - 1) / largest).cast("int")),
        lambda p: F.struct(p.alias("piece"), F.least(F.lit(largest), n - start(p)).alias("n_tokens"), F.array_join(F.slice("words", start(p) + 1, F.lit(largest)), " ").alias("piece_text")),
    )
    each = split.select("doc_id", "d1", "d2", F.explode(cut).alias("p"))
    return each.select("doc_id", "d1", "d2", "p.piece", "p.n_tokens", F.sha2(F.col("p.piece_text"), 256).alias("piece_sha256"), "p.piece_text")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, piece_sha256, bin_id, capacity, bin_offset) of every piece. Token k of piece p is token p * max + k."""
    pieces = stored(pieces_of(docs, doc_id, text, max(capacities)).drop("piece_text"))
    shards = max(1, -(-pieces.count() // shard))

    def packed(group: pa.Table) -> pa.Table:
        n = group.column("n_tokens").to_numpy()
        order = np.lexsort((group.column("piece").to_numpy(), group.column("d2").to_numpy(), group.column("d1").to_numpy(), -n))
        group = group.take(pa.array(order))
        found = pack_lengths(n[order].tolist(), capacities)
        first = group.column("shard")[0].as_py() << 32
        b, c, o = (np.array(x, np.int64) for x in zip(*found, strict=True))
        return pa.Table.from_arrays(
            [*(group.column(k) for k in ("doc_id", "piece", "n_tokens", "piece_sha256")), pa.array(b + first), pa.array(c.astype(np.int32)), pa.array(o.astype(np.int32))],
            ["doc_id", "piece", "n_tokens", "piece_sha256", "bin_id", "capacity", "bin_offset"],
        )

    kind = docs.select(F.col(f"`{doc_id}`")).dtypes[0][1]
    return (
        pieces.withColumn("shard", F.pmod(F.xxhash64("d1", "d2", "piece"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(packed, f"doc_id {kind}, piece int, n_tokens int, piece_sha256 string, bin_id long, capacity int, bin_offset int")
    )


def bin_texts(docs: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: Sequence[int] = CAPACITIES, end: str = "\n") -> DataFrame:
    """(bin_id, capacity, n_tokens, text) of every bin: its pieces in order, words joined by one space, end after each document.

    packed is pack() of the same docs and capacities. A bin is at most the largest capacity, so what a task gathers is bounded.
    Texts meet their places by SHA-256, one row a distinct piece; the places of a frequent piece are short rows that Spark may split.
    """
    largest = max(capacities)
    pieces = pieces_of(docs, doc_id, text, largest)
    words = F.when(F.col("piece_text") == "", 0).otherwise(F.size(F.split("piece_text", " ")))
    texts = pieces.groupBy("piece_sha256").agg(F.first("piece_text").alias("piece_text")).withColumn("n_words", words)
    ended = F.when(F.col("n_words") < F.col("n_tokens"), F.concat("piece_text", F.lit(end))).otherwise(F.concat("piece_text", F.lit(" ")))
    placed = packed.join(texts, "piece_sha256").withColumn("part", F.struct("bin_offset", ended.alias("text")))
    gathered = placed.groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list("part")).alias("parts"))
    return gathered.select("bin_id", "capacity", "n_tokens", F.array_join(F.col("parts.text"), "").alias("text"))
