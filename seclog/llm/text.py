"""Words and shingles of Arrow text columns, as numpy arrays over the column's bytes.

Everything works on slices of a batch that hold a few MB of text at most (or one longer document),
so memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: For work that has no use for large slices: the arrays of a slice (8 bytes for each byte of text) stay in a core's cache.
SMALL_BYTES = 256 << 10

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word: all but space and 9-13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of a word of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about ``limit`` text bytes: (rows, bytes, offsets); null text is empty."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
    n, start = batch.num_rows, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        own = offsets[start:end + 1]
        yield batch.slice(start, end - start), data[own[0]:own[-1]], own - own[0]
        start = end


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row starts and ends in them."""
    array = _array(column)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(array) + 1 + array.offset)[array.offset:].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data, offsets


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each row the index of its first word (one more at the end)."""
    inside = letters.take(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (cut[:-1] | ~before))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n of the step, or of its inverse."""
    if len(_POWERS[kind]) <= n:
        full = np.full(max(n, SMALL_BYTES, 2 * len(_POWERS[kind])) + 1, _STEP if kind == "up" else _BACK, np.uint64)
        full[0] = 1
        _POWERS[kind] = np.cumprod(full)
    return _POWERS[kind]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes; ``span_hash`` takes the hash of any span from it."""
    total = np.zeros(len(data) + 1, np.uint64)
    own = _BYTE.take(data)
    own *= _powers("up", len(data))[:len(data)]
    np.cumsum(own, out=total[1:])
    return total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from ``starts`` to ``ends``, the same wherever they stand."""
    down = _powers("down", len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each row's first word (one more at the end)."""
    data = LOWER.take(data)
    starts, ends, first = words(data, offsets, letters)
    return span_hash(prefix_hash(data), starts, ends), first


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` hashes; fewer hashes than that give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i:n + i]
        total ^= total >> np.uint64(32)
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct ``k``-word shingle hashes. Fewer words make one shingle; none make none."""
    hashes, first = word_hashes(data, offsets, NOT_SPACE)
    runs = sequence_hashes(hashes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a:b - k + 1]))
        elif b > a:
            out.append(sequence_hashes(hashes[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
