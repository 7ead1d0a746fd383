"""Line differences of two texts: shortest edit scripts, computed for many pairs in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliodiff.durable import shuffled, written


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """A shortest script of ("-", i, j) and ("+", i, j) steps from a to b; i and j are positions in a and b when it applies.

    Linear space: a furthest-reaching search from both ends finds the middle of a shortest path, and both halves follow.
    Positions stand on a stack, so the depth is no limit either. Time is lines times differences, memory is lines.
    """
    steps: list[tuple[str, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            steps += [("-", i, b0) for i in range(a0, a1)] + [("+", a1, j) for j in range(b0, b1)]
        else:
            x, y = _middle(a, b, a0, a1, b0, b1)
            todo += [(x, a1, y, b1), (a0, x, b0, y)]
    return steps


def _middle(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int]:
    """A point in the middle of a shortest path from (a0, b0) to (a1, b1), where both ends differ and neither side is empty."""
    n, m = a1 - a0, b1 - b0
    delta, odd = n - m, (n - m) % 2
    fwd, bwd = {1: 0}, {1: 0}  # diagonal: furthest x from the start; furthest distance from the end, on mirrored diagonals
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = fwd[k + 1] if k == -d or (k != d and fwd[k - 1] < fwd[k + 1]) else fwd[k - 1] + 1
            while x < n and 0 <= x - k < m and a[a0 + x] == b[b0 + x - k]:
                x += 1
            fwd[k] = x
            if odd and abs(delta - k) < d and x + bwd[delta - k] >= n and x <= n and 0 <= x - k <= m:
                return a0 + x, b0 + x - k
        for k in range(-d, d + 1, 2):
            x = bwd[k + 1] if k == -d or (k != d and bwd[k - 1] < bwd[k + 1]) else bwd[k - 1] + 1
            while x < n and 0 <= x - k < m and a[a1 - 1 - x] == b[b1 - 1 - x + k]:
                x += 1
            bwd[k] = x
            if not odd and abs(delta - k) <= d and x + fwd[delta - k] >= n and x <= n and 0 <= x - k <= m:
                return a1 - x, b1 - x + k
    raise AssertionError("two texts always have a script")


def hunks(a: list[str], b: list[str]) -> list[tuple[int, int, list[str]]]:
    """(start, end, added): lines start to end (exclusive) of a give way to added; no two hunks touch."""
    found: list[tuple[int, int, list[str]]] = []
    at = None
    for op, i, j in edit_script(a, b):
        if at != (i, j):
            found.append((i, i, []))
        start, end, added = found[-1]
        if op == "-":
            found[-1], at = (start, i + 1, added), (i + 1, j)
        else:
            added.append(b[j])
            at = (i, j + 1)
    return found


def line_differences(pairs: DataFrame, key: str = "pair_id", old: str = "old", new: str = "new") -> DataFrame:
    """(pair_id, op, line, text): removed lines by number in the old text, added ones by the old line they follow; both 1-based.

    old and new are arrays of lines. The work is one pair of texts a row; nothing is shuffled.
    """
    taken = pairs.select(F.col(key).cast("long").alias("pair_id"), F.col(old).alias("old"), F.col(new).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, int, str]] = []
            for pair, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = a or [], b or []
                for op, i, j in edit_script(a, b):
                    out.append((pair, op, i + 1, a[i]) if op == "-" else (pair, op, i, b[j]))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], ["pair_id", "op", "line", "text"])

    return taken.mapInArrow(run, "pair_id long, op string, line int, text string")


def _read_versions(versions: DataFrame) -> DataFrame:
    """version_hunks(), and a row of kind `version` for each version, so that one pass over texts tells both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, str, str, str]] = []
            for group, version, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a = a or []
                out.append((group, version, None, "version", None, None))
                for start, end, added in hunks(a, b or []):
                    if start == end:
                        out.append((group, version, start, "added", "", "\n".join(t for t in added if t.strip())))
                    for i in range(start, end):
                        text = added[i - start] if i - start < len(added) else ""
                        out.append((group, version, i + 1, "changed" if text else "removed", a[i], text))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["group_id", "version", "line", "kind", "reference_text", "text"])

    taken = versions.select(F.col("group_id").cast("long"), F.col("version").cast("int"), "old", "new")
    return taken.mapInArrow(run, "group_id long, version int, line int, kind string, reference_text string, text string")


def version_hunks(versions: DataFrame) -> DataFrame:
    """(group_id, version, line, kind, reference_text, text) of versions (group_id, version, old, new); old is the reference's lines.

    A reference line in a hunk is changed to the added line of its place there, or removed where that is missing or empty;
    added lines beyond the replaced ones are not told, as in the reports this follows. Lines put in between are one row, kind
    added, with the number of the line before. Nothing is shuffled.
    """
    return _read_versions(versions).filter("kind <> 'version'")


def compare_versions(versions: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(group_id, location_signature, reference_text, version, kind, text) of any number of versions against one reference.

    A changed reference line has a row for each version of its group, `unchanged` where that version keeps it; places of
    insertion (`after-Ln`) have rows of the versions that insert there, if any inserts text. Null and empty versions have
    lost all lines; groups without differences give no rows. found is version_hunks(versions) where a caller has stored it;
    else it is written to the shared folder, so that texts are read and compared once.
    """
    each = versions.select(F.col("group_id").cast("long"), F.col("version").cast("int"))
    if found is None:
        read = written(_read_versions(versions))
        found, each = read.filter("kind <> 'version'"), read.filter("kind = 'version'").select("group_id", "version")
    put = found.filter("kind = 'added'")
    places = put.groupBy("group_id", "line").agg(F.max("text").alias("most")).filter("most <> ''").drop("most")
    inserted = put.join(shuffled(places), ["group_id", "line"], "left_semi").select("group_id", F.concat(F.lit("after-L"), "line").alias("location_signature"), "reference_text", "version", "kind", "text")
    cut = found.filter("kind <> 'added'")
    real = F.bool_or((F.col("kind") == "removed") | (F.col("text") != F.col("reference_text")))
    lines = cut.groupBy("group_id", "line").agg(F.max("reference_text").alias("reference_text"), real.alias("real")).filter("real").drop("real")
    every = lines.join(shuffled(each.distinct()), "group_id")
    told = every.join(shuffled(cut.select("group_id", "line", "version", "kind", "text")), ["group_id", "line", "version"], "left")
    changed = told.select(
        "group_id", F.concat(F.lit("L"), "line").alias("location_signature"), "reference_text", "version", F.coalesce("kind", F.lit("unchanged")).alias("kind"), F.coalesce("text", "reference_text").alias("text")
    )
    return changed.unionByName(inserted)
