"""Vectorised byte kernels over Arrow string arrays: words, their 64-bit hashes, and shingle sets."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once.
STEP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: One odd 64-bit number for each byte, and the base of the polynomial over a word's bytes and a shingle's words.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about size bytes in a string column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory that its partition took back to the system, where it can."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one more) of the runs of bytes that are not white space."""
    solid = ~_SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z folded to a-z."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP, side="right")))
        first, lengths = starts[lo], (ends - starts)[lo:hi]
        piece = data[first : ends[hi - 1]]
        begins = starts[lo:hi] - first
        inside = np.arange(len(piece)) - np.repeat(begins, np.diff(np.append(begins, len(piece))))
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE), dtype=np.uint64)
        inside = np.minimum(inside, len(powers) - 1)
        value = _BYTE[_LOWER[piece] if fold_case else piece] * powers[inside]
        value[_SPACE[piece]] = 0
        out[lo:hi] = mix(np.add.reduceat(value, begins) + lengths.astype(np.uint64))
        lo = hi
    return out


def shingle_hashes(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of every run of width words; place i holds words i to i + width - 1."""
    n = len(hashes) - width + 1
    total = np.zeros(max(0, n), np.uint64)
    for k in range(width if n > 0 else 0):
        total = total * _BASE + hashes[k : k + n]
    return mix(total)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; fewer words than width make one, no words none."""
    data, offsets = utf8(texts)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    every = shingle_hashes(hashes, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            total = np.array([b - a], np.uint64)
            for k in range(a, b):
                total = total * _BASE + hashes[k : k + 1]
            yield mix(total)
        else:
            yield np.zeros(0, np.uint64)
