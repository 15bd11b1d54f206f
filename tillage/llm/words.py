"""Vectorised word and fingerprint helpers that run inside Spark tasks.

A word is a maximal run of characters other than space, tab, LF, VT, FF and
CR. Fingerprints are 64-bit: the bytes of a word, and the words of a sequence,
are combined by a polynomial modulo 2**64 and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# An odd multiplier (invertible modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 4 << 20
KEPT_POWERS = 1 << 20


class _Kept(dict):
    """A cache that stays where it is: a task that is sent to the executors takes an empty one along."""

    def __reduce__(self):
        return _Kept, ()


_powers: dict[int, np.ndarray] = _Kept()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (the first ``KEPT_POWERS`` are kept between calls)."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        x = np.full(max(n, KEPT_POWERS), base, np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        _powers[int(base)] = have if len(have) == KEPT_POWERS else have[:KEPT_POWERS].copy()
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


def text_array(column) -> pa.Array:
    """A string array without nulls (null reads as the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``max_bytes`` (one text at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size + 64) // max_bytes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z > a:
                yield batch.slice(int(a), int(z - a))


def split_words(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words, the words' ids, and the distinct words."""
    texts = text_array(column)
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    off = parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    flat = parts.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():
        seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        off, flat = seen[off], flat.filter(full)
    coded = flat.dictionary_encode()
    return off, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each string."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    words = words.cast(pa.string())
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8))[off[0]:off[-1]]
    off = off - off[0]
    sums = _prefix((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))
    return mix((sums[off[1:]] - sums[off[:-1]]) * powers(BASE_INV, len(data) + 1)[off[:-1]])


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each run of ``k`` consecutive hashes (runs cross text ends; see :func:`run_starts`)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = _prefix(hashes * powers(BASE, len(hashes)))
    return mix((sums[k:] - sums[:-k]) * powers(BASE_INV, n))


def text_of_word(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def run_starts(off: np.ndarray, k: int) -> np.ndarray:
    """Positions at which ``k`` consecutive words of one text begin."""
    n = int(off[-1])
    inside = np.ones(n + 1, np.int64)
    last = np.minimum(off[1:], np.maximum(off[:-1], off[1:] - k + 1))  # first position too late for a run
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, last, 1)
    np.add.at(step, off[1:], -1)
    inside = np.cumsum(step)[:n] == 0
    return np.flatnonzero(inside)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span:w - span + n])
