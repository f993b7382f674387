"""Words of a text as spans of its UTF-8 bytes, and hashes of runs of words, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def normal(text: bytes | None, signs: bytes) -> bytes:
    """Words of the text after mapping each byte by ``signs``, joined by one space."""
    return b" ".join((text or b"").translate(signs).split())


def give_back() -> None:
    """Hand free memory of this process back to the system: Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def word_spans(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(words)]))


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if len(kept.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        kept[base] = np.cumprod(out, dtype=np.uint64)
    return kept[base][:n]


def kgram_hashes(words: bytes, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words: a polynomial over their bytes, from prefix sums."""
    first = int(start[0])
    raw = np.frombuffer(words, np.uint8)[first:int(end[-1])].astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64),
                            np.cumsum((raw + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)))
    a, b = start[:len(start) - k + 1] - first, end[k - 1:] - first
    h = (total[b] - total[a]) * _powers(_INVERSE, len(raw))[a]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def arrow_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of ``schema`` with up to ``size`` of the row tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
