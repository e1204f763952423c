"""What Python workers share: packed tables of character n-grams (64-bit keys in sorted arrays, computed and looked up many
at a time), and how they give memory back."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART = 1 << 20


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers are used again by the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """The function of a task's batches, with ``release_memory`` at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Small batches of narrow rows taken together, which costs less than a call of every kernel for each."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _odd(n: int) -> np.ndarray:
    """n odd multipliers (splitmix64)."""
    out, x = [], 0x5EED
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % 2**64
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


_BY = _odd(64)


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def keys_of(cp: np.ndarray, n: int) -> np.ndarray:
    """The key of the n code points that begin at each place; places with fewer behind them are left out."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    wide = cp.astype(np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out += wide[j : j + m] * _BY[j]
    return out ^ (out >> np.uint64(29))


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each wanted key in the sorted ``keys`` (zeros where it isn't there), and whether it is there."""
    some, back = np.unique(wanted, return_inverse=True)
    hit = np.zeros(len(some), bool)
    out = np.zeros((len(some), *values.shape[1:]))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        hit = keys[at] == some
        out[hit] = values[at[hit]]
    return out[back], hit[back]


def in_parts(texts: list, size: int = PART) -> Iterator[list]:
    """``texts`` in parts of about ``size`` characters, one text at least."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) if t else 0
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part
