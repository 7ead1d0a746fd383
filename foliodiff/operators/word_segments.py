"""Words of two texts, aligned: what was kept, removed and added inside a changed line.

Words that both texts hold exactly once are anchors. The longest run of anchors in the same order on both sides is kept, and from each of them, and from both ends,
equal words and spaces next to each other are kept too, forwards first. Where all words differ from each other that is the longest common subsequence; of words that repeat
between anchors some may be told as removed and added though they were kept. No table of all words against all words is made: a line is aligned in time n log n by
itself, in the task that read it, so words are never shuffled or written.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["pair_id", "line"]
#: Words are runs of other characters than ASCII white space, which counts as well.
WORD = re.compile("[^ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+")
#: Segments, and characters of them, that are given out at a time.
HELD, HELD_CHARS = 20_000, 4_000_000


def _longest(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of anchors (a, b), sorted by a, in which b rises; of several, the one whose ends come first."""
    ends: list[int] = []  # by length: the least b at which a run of that length ends
    falling: list[list[int]] = []  # by length: -b of all ends in order, and where they stand
    places: list[list[int]] = []
    back = []
    for at, (_, b) in enumerate(anchors):
        n = bisect_right(ends, b)
        back.append(places[n - 1][bisect_right(falling[n - 1], -b)] if n else -1)
        if n == len(ends):
            ends.append(b)
            falling.append([])
            places.append([])
        ends[n] = b
        falling[n].append(-b)
        places[n].append(at)
    at, kept = (places[-1][0] if places else -1), []
    while at >= 0:
        kept.append(anchors[at])
        at = back[at]
    return kept[::-1]


def align(x: list[str], y: list[str]) -> list[tuple[str, int]]:
    """Segments (value, sort) in order; sort is 0 for kept words, 1 for removed and 2 for added ones."""
    if x == y:
        return [("".join(x), 0)] if x else []
    in_x, in_y = Counter(x), Counter(y)
    at_y = {w: j for j, w in enumerate(y) if in_y[w] == 1}
    anchors = [(i, at_y[w]) for i, w in enumerate(x) if in_x[w] == 1 and w in at_y and w[0] not in " \t\n\r\f\x0b"]
    kept: list[tuple[int, int]] = []
    a, b = -1, -1
    for next_a, next_b in [*_longest(anchors), (len(x), len(y))]:
        i, j = a + 1, b + 1
        while i < next_a and j < next_b and x[i] == y[j]:
            kept.append((i, j))
            i, j = i + 1, j + 1
        p, q = next_a, next_b
        while p > i and q > j and x[p - 1] == y[q - 1]:
            p, q = p - 1, q - 1
        kept += [(p + k, q + k) for k in range(next_a - p)]
        kept.append((next_a, next_b))
        a, b = next_a, next_b
    parts: list[tuple[int, list[str]]] = []

    def put(sort: int, words: list[str]) -> None:
        if words:
            if parts and parts[-1][0] == sort:
                parts[-1][1].extend(words)
            else:
                parts.append((sort, words))

    a, b = 0, 0
    for i, j in kept:
        put(1, x[a:i])
        put(2, y[b:j])
        put(0, x[i : i + 1])
        a, b = i + 1, j + 1
    return [("".join(words), sort) for sort, words in parts]


def word_segments(pairs: DataFrame) -> DataFrame:
    """(pair_id, line, n, value, added, removed) of lines (pair_id, line, old, new): segments in order, n from 0; what was removed comes before what was added.

    Segments that were not added give the old line, those not removed the new one. Words are runs of other characters than white space, which counts as well. Null lines are empty
    ones; two empty lines give no row. Other columns are left out. Nothing is shuffled.
    """
    taken = pairs.select(*KEY, F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))
    keys = [f"{name} {taken.schema[name].dataType.simpleString()}" for name in KEY]

    def told(batch: pa.RecordBatch, rows: list[int], found: list[tuple[int, str, int]]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        n, value, sort = zip(*found, strict=True)
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int32()), pa.array(value, pa.string()), pa.array([s == 2 for s in sort]), pa.array([s == 1 for s in sort])]
        return pa.RecordBatch.from_arrays(columns, [*KEY, "n", "value", "added", "removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[int, str, int]] = []
            chars = 0
            for row in range(batch.num_rows):
                old, new = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                for n, (value, sort) in enumerate(align(WORD.findall(old), WORD.findall(new))):
                    rows.append(row)
                    found.append((n, value, sort))
                    chars += len(value)
                    if len(rows) >= HELD or chars >= HELD_CHARS:
                        yield told(batch, rows, found)
                        rows, found, chars = [], [], 0
            if rows:
                yield told(batch, rows, found)

    return taken.mapInArrow(run, ", ".join([*keys, "n int", "value string", "added boolean", "removed boolean"]))
