"""MinHash near-dedup with SetSketch registers: banded candidates, joint likelihood estimate, exact verification.

A document's set is its distinct shingles of `width` words (A-Z lower-cased); with fewer words, the whole sequence as one;
without words, empty and linked with nothing. Two documents are linked if 100 |A n B| >= 100 `similarity` |A u B|.

1. Every document gets a SetSketch: register i is floor(1 - log_b(min x / a)), clipped, over exponential values x of its
   shingles; the minima are mergeable by maximum and locality-sensitive. Documents of equal sets (a 128-bit digest) become
   one node, so exact copies cost nothing later.
2. BANDS groups of ROWS registers are hashed. At similarity 0.8, two sets share no band with probability
   (1 - 0.8^6)^40 < 6e-6; tests/llm/test_near_dedup.py measures the recall of links against an exact join.
3. A node's popularity is the number of band-mates that it has over all bands, and its hub the most popular of its
   band-mates: in a group of near copies, what the others are copies of. Each node is first tried with its hub. Nodes
   whose estimated similarity to a common hub is `family` or more are a family; members outside its largest component are
   then tried with all members of other components. Last, of each band that still holds different components, all that
   lie outside its largest group (family or component) are tried with the whole band. Both go in blocks of at most about
   BLOCK sets and ELEMENTS shingles a side, dealt by hash, sorted, and joined by their elements in place; a block tells at most
   one link for each component it holds. So no candidate is left out, and no group's pairs are ever rows.
4. A node and its hub are dropped if the sizes exclude the link, or if the likelihood estimate of its similarity from the joint
   register order (how many registers are greater, smaller, equal) is over five deviations below the threshold. What is
   left is verified on the full sets.
5. Components: minimal labels with pointer jumping over links, each round written; later links join components, not nodes.

Joins are many-to-one, and keys that many rows share (a digest, a band) meet pre-aggregated minima, so adaptive execution
can split them. Nothing is collected by the driver but convergence flags.

Null and empty texts are components of their own. A component's id is its smallest non-null doc_id; kept marks the
documents of that id, or, in a component of null ids alone, all. Repeated rows have equal sets, and share a component.
dedup() keeps one row of each component: the least id (nulls last), of several texts of that id one fixed by hash, of
repeated rows one. Ids are whole numbers; name documents by numbers first where ids are texts. Long texts are handled
alone, whole. An empty table gives an empty table. dedup() returns the columns of docs, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import doc_keys
from .common import stored, unused
from .words import encode, hashes, mix, pieces

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
BLOCK, ELEMENTS = 500, 500_000
#: SetSketch parameters: base and rate; registers are 16-bit.
BASE, RATE, TOP = 1.001, 20.0, 65535
SIMILARITY = 0.8
#: Similarity to a hub from which on a node belongs to the hub's family; sets only in which step the rest is tried.
FAMILY = 0.4
PRIME = np.uint64(0x9E3779B97F4A7C15)

_rng = np.random.default_rng(20240229)
_SLOPE = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    codes, words, offsets = encode(texts, lower=True)
    h = hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    g = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        g = g * PRIME + h[k : len(h) - width + 1 + k] if len(g) else g
    g = mix(g)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(g[a : b - width + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = x * PRIME + h[k : k + 1]
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for start in range(0, len(x), 1024):
        least = np.minimum(least, (x[start : start + 1024, None] * _SLOPE + _SHIFT).min(axis=0))
    value = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(value / RATE) / math.log(BASE)), 0, TOP).astype(np.uint16)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from registers (pairs x REGISTERS) and set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-12)

    def loss(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        x, y = low + (high - low) / 3, high - (high - low) / 3
        right = loss(x) < loss(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets = shingle_sets(piece.column("text"), width)
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("id", "d1", "d2")), *columns], ["id", "d1", "d2", "n", "g", "reg"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + batch.num_rows, dtype=np.int64)), *batch.columns], ["v", *batch.schema.names])
        first += batch.num_rows


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            reg = np.frombuffer(b"".join(part.column("reg").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(reg), 1), np.uint64)
            for k in range(ROWS):
                key = mix(key * PRIME + reg[:, :, k])
            v, n = (np.repeat(part.column(c).to_numpy(), BANDS) for c in ("v", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(v), pa.array(n)], ["band", "v", "n"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            j = likely_similarity(ra, rb, part.column("na").to_numpy().astype(float), part.column("nb").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "na", "nb")), pa.array(j)], ["a", "b", "na", "nb", "j"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets = [s.tobytes() for s in shingle_sets(piece.column("text"), width)]
            yield pa.RecordBatch.from_arrays([piece.column("v"), pa.array(sets, pa.binary())], ["v", "members"])

    return run


def _members(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _verified(similarity: float):
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = _members(a.as_py()), _members(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *changes.tolist(), batch.num_rows]
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            if start == stop:
                continue
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_within(group: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Of one block of members and one of strays: links of strays to members that join different components, as few as do."""
    percent = round(100 * similarity)
    stray = group.column("stray").to_numpy()
    v, c = group.column("v").to_numpy(), group.column("c").to_numpy()
    own, other = np.flatnonzero(~stray), np.flatnonzero(stray)
    if not len(own) or not len(other) or (c == c[0]).all():
        return []
    sets = [_members(x) for x in group.column("members").to_pylist()]
    size = np.array([len(sets[i]) for i in own])
    values, holder = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), size)
    order = np.argsort(values, kind="stable")
    values, holder = values[order], holder[order]
    parent: dict[int, int] = {}
    found = []
    for i in other:
        x = sets[i]
        low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(holder[at], minlength=len(own))
        good = np.flatnonzero((100 * both >= percent * (size + len(x) - both)) & (c[own] != c[i]))
        _, first = np.unique(c[own][good], return_index=True)
        for k in own[good[first]]:
            a, b = _root(parent, int(c[i])), _root(parent, int(c[k]))
            if a != b:
                parent[a] = b
                found.append((int(v[i]), int(v[k])))
    return found


def _blocks_joined(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, ["f", "i", "j"]):
            found = links_within(group, similarity)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def block_links(inside: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of each group f, enough links of its strays to its rows to join all components c that their links join.

    inside has (f, v, c, n, stray), n being the size of v's set. A group is cut into blocks of rows and blocks of strays.
    """
    shares = [(F.count(F.when(k, 1)), F.sum(F.when(k, F.col("n")).otherwise(0))) for k in (F.lit(True), F.col("stray"))]
    parts = [F.ceil(F.greatest(k / BLOCK, n / ELEMENTS)).cast("int") for k, n in shares]
    cuts = inside.groupBy("f").agg(parts[0].alias("rows"), parts[1].alias("cols"))
    whole = inside.join(cuts.filter("cols > 0"), "f").join(sets, "v")
    dealt = [F.pmod(F.xxhash64("v"), F.col(k)).cast("int") for k in ("rows", "cols")]
    upto = [F.explode(F.sequence(F.lit(0), F.col(k) - 1)) for k in ("rows", "cols")]
    members = whole.select("f", "v", "c", "members", dealt[0].alias("i"), upto[1].alias("j"), F.lit(False).alias("stray"))
    strays = whole.filter("stray").select("f", "v", "c", "members", upto[0].alias("i"), dealt[1].alias("j"), F.lit(True).alias("stray"))
    dealt_out = members.union(strays).repartition("f", "i", "j").sortWithinPartitions("f", "i", "j")
    return stored(dealt_out.mapInArrow(_blocks_joined(similarity), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(v, c): the smallest node that each linked node reaches. links has (a, b), each once or more."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "v"))
    while True:
        near = both.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = label.join(near, "v").select("v", "c", F.least("c", "m").alias("l"))
        hop = label.select(F.col("v").alias("l"), F.col("c").alias("h"))
        jumped = stored(lower.join(hop, "l").select("v", F.col("c").alias("before"), F.least("l", "h").alias("c")))
        label = jumped.select("v", "c")
        if jumped.filter("before <> c").isEmpty():
            return label


def joined_components(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """The components of grouped, joined further by links between their nodes and others: (v, c)."""
    of = [grouped.select(F.col("v").alias(k), F.col("c").alias(f"c{k}")) for k in ("a", "b")]
    named = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    whole = stored(named.filter("a <> b").distinct())
    lifted = components(whole).select(F.col("v").alias("c"), F.col("c").alias("low"))
    known = grouped.join(lifted, "c", "left").select("v", F.coalesce("low", "c").alias("c"))
    alone = lifted.join(grouped.select(F.col("v").alias("c")), "c", "left_anti").select(F.col("c").alias("v"), F.col("low").alias("c"))
    return stored(known.union(alone))


def _fits(a: str, b: str, similarity: float):
    """The sizes allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * round(100 * similarity)


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 2, similarity: float = SIMILARITY, family: float = FAMILY) -> DataFrame:
    """(id, d1, d2, n_shingles, component_id, kept, chosen) for each row of docs; chosen marks the rows equal to the one that dedup() keeps."""
    d1, d2 = doc_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), d1.alias("d1"), d2.alias("d2"), F.col(f"`{text}`").alias("text"))
    sketches = stored(keyed.mapInArrow(_sketches(width), "id long, d1 long, d2 long, n long, g binary, reg binary"))
    unique = (
        sketches.filter("n > 0")
        .groupBy("g")
        .agg(F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "d1", "d2")).alias("rep"), F.max("n").alias("n"), F.max("reg").alias("reg"))
        .select("g", "id", "rep.d1", "rep.d2", "n", "reg")
    )
    nodes = stored(unique.mapInArrow(_numbered, "v long, g binary, id long, d1 long, d2 long, n long, reg binary"))

    bands = nodes.select("v", "n", "reg").mapInArrow(_banded, "band long, v long, n long")
    shared = bands.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1")
    full = stored(bands.join(shared, "band").select("band", "v", "n", "k"))
    popularity = full.groupBy("v").agg(F.sum("k").alias("pop"))
    lead = full.join(popularity, "v").groupBy("band").agg(F.max(F.struct("pop", (-F.col("v")).alias("minus"))).alias("lead"))
    hubs = full.join(lead, "band").groupBy("v").agg((-F.max("lead")["minus"]).alias("hub"))

    involved = full.select("v").distinct().join(nodes.select("v", "d1", "d2"), "v")
    texts = keyed.select("d1", "d2", "text").join(involved, ["d1", "d2"])
    # repeated rows give a node's set more than once
    sets = stored(texts.select("v", "text").mapInArrow(_sets(width), "v long, members binary").groupBy("v").agg(F.any_value("members").alias("members")))
    least = similarity - 5 * math.sqrt(similarity * (1 - similarity) / REGISTERS)

    def likely(pairs: DataFrame) -> DataFrame:
        """(a, b) with sizes na and nb and the likeliest similarity j."""
        reg = nodes.select("v", "n", "reg")
        wide = pairs.join(reg.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("reg").alias("ra")), "a").join(
            reg.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("reg").alias("rb")), "b"
        )
        return wide.mapInArrow(_likely, "a long, b long, na long, nb long, j double")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of (a, b, na, nb, j), the links."""
        some = pairs.filter((F.col("j") >= least) & _fits("na", "nb", similarity)).select("a", "b")
        whole = some.join(sets.select(F.col("v").alias("a"), F.col("members").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("members").alias("sb")), "b")
        return stored(whole.mapInArrow(_verified(similarity), "a long, b long"))

    near = stored(likely(hubs.filter("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b"))))
    first = confirmed(near)
    grouped = components(first)

    close = near.filter(F.col("j") >= family)
    families = close.select(F.col("b").alias("v"), F.col("a").alias("f")).union(close.select(F.col("a").alias("v"), F.col("a").alias("f"))).distinct()
    # a hub that has a hub of its own is in two families
    placed = families.join(grouped, "v", "left").withColumn("c", F.coalesce("c", "v"))
    by_part = placed.groupBy("f", "c").agg(F.count("*").alias("k"))
    spread = by_part.groupBy("f").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all")).filter("top.k < all").select("f", "top.c")
    sizes = nodes.select("v", "n")
    inside = placed.join(spread.withColumnRenamed("c", "big"), "f").join(sizes, "v").select("f", "v", "c", "n", (F.col("c") != F.col("big")).alias("stray"))
    second = block_links(inside, sets, similarity)

    own_family = families.groupBy("v").agg(F.min("f").alias("f"))
    group = F.when(F.col("f").isNotNull(), F.col("f") * 2).otherwise(F.col("c") * 2 + 1)
    held = full.select("band", "v", "n").join(grouped, "v", "left").withColumn("c", F.coalesce("c", "v")).join(own_family, "v", "left").withColumn("p", group)
    by_group = held.groupBy("band", "p").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("c").alias("high"))
    largest = (
        by_group.groupBy("band")
        .agg(F.max(F.struct("k", "p"))["p"].alias("big"), F.count("*").alias("groups"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("groups > 1 AND low < high")
        .select("band", "big")
    )
    open_bands = held.join(largest, "band").select(F.col("band").alias("f"), "v", "c", "n", (F.col("p") != F.col("big")).alias("stray"))
    third = block_links(open_bands, sets, similarity)
    final = joined_components(grouped, second.union(third))

    part = nodes.select("v", "g", "id", "d1", "d2").join(final, "v", "left").withColumn("c", F.coalesce("c", "v"))
    best = part.groupBy("c").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "d1", "d2")).alias("best"))
    named = part.join(best, "c").select("g", "component_id", F.col("best.d1").alias("b1"), F.col("best.d2").alias("b2"))
    rows = sketches.select("id", "d1", "d2", "n", F.when(F.col("n") > 0, F.col("g")).alias("g")).join(named, "g", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(
        "id", "d1", "d2", F.col("n").alias("n_shingles"), component.alias("component_id"), ((F.col("n") == 0) | ((F.col("d1") == F.col("b1")) & (F.col("d2") == F.col("b2")))).alias("chosen")
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = SIMILARITY, family: float = FAMILY) -> DataFrame:
    """One row of docs for each component: the document of smallest id."""
    k1, k2, many = unused(docs, "k1", "k2", "many")
    chosen = link_components(docs, doc_id, text, width, similarity, family).filter("chosen")
    kept = stored(chosen.groupBy(F.col("d1").alias(k1), F.col("d2").alias(k2)).agg((F.count(F.when(F.col("n_shingles") > 0, 1)) > 1).alias(many)))
    d1, d2 = doc_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    found = docs.withColumns({k1: d1, k2: d2}).join(kept, [k1, k2])
    once = found.filter(~F.col(many)).union(found.filter(many).dropDuplicates([k1, k2]))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
