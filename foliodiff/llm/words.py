"""Words of Arrow batches as numpy codes, for operators that run Python on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once; a longer text is handled alone.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about limit bytes of text, null texts as empty ones."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        batch = batch.set_column(at, text, pc.fill_null(batch.column(at).cast(pa.string()), ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def encode(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct words, offsets): document i has the words distinct[codes[offsets[i]:offsets[i + 1]]]."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    kept = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    bounds = bounds - bounds[0]
    if len(kept) and not kept.all():  # white space at an end of a text leaves an empty word
        real = kept[codes]
        bounds = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[bounds]
        codes = codes[real]
    return codes, coded.dictionary, bounds


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection), so that sums and shifts of hashes are well spread."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each document; 0 for documents without words."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]
