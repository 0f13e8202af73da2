"""Text columns as flat UTF-8 bytes: words, word hashes and shingles in numpy.

Arrow hands a task its strings as one byte buffer plus offsets; these helpers
work on that buffer directly, so no Python object is made for a word.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: digits, a-z and every byte of a non-ASCII character.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True

#: Text bytes handled at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
_WORD_BLOCK = 1 << 17


def release() -> None:
    """Give unused memory back to the system: a worker is kept for later stages with all it ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """``run`` (a function of Arrow batches) that releases memory when its task is over."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


def with_text_column(docs: DataFrame, text: str, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """``keep`` as columns c0, c1, ... and the text's place among them (or after them): it travels once."""
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    if text in keep and isinstance(docs.schema[text].dataType, T.StringType):
        return docs.select(*columns), list(keep).index(text)
    return docs.select(*columns, F.col(f"`{text}`").cast("string").alias("_text")), len(keep)


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values (the same on every machine)."""
    return np.frombuffer(hashlib.shake_256(f"equiwatch:{seed}".encode()).digest(8 * n), "<u8").copy()


BYTE_VALUE = random_words(1, 256)
with np.errstate(over="ignore"):
    _BASE = random_words(2, 1)[0] | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``len + 1`` offsets of a string column; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset:a.offset + len(a) + 1]
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over runs of rows of about ``limit`` bytes."""
    data, offsets = flat(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text its first word (``len + 1``)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    full = offsets[1:] > offsets[:-1]
    begins[first[full]] = inside[first[full]]
    ends[last[full]] = inside[last[full]]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word."""
    out = np.empty(len(starts), np.uint64)
    power = powers(int((ends - starts).max()) if len(starts) else 1)
    for lo in range(0, len(starts), _WORD_BLOCK):
        s, e = starts[lo:lo + _WORD_BLOCK], ends[lo:lo + _WORD_BLOCK]
        size = e - s
        at = np.concatenate(([0], np.cumsum(size)))[:-1]
        pos = np.arange(int(size.sum()), dtype=np.int64)
        within = pos - np.repeat(at, size)
        value = BYTE_VALUE[LOWER[data[within + np.repeat(s, size)]]] * power[within]
        out[lo:lo + _WORD_BLOCK] = mix(np.add.reduceat(value, at))
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of each text, and each text's first shingle.

    A text of fewer than ``n`` words, but not none, has one shingle: all its words.
    """
    count = np.diff(first)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(have)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], have) + np.repeat(first[:-1], have)
    size = np.repeat(np.minimum(count, n), have)
    out = np.zeros(len(at), np.uint64)
    factor = random_words(3, n) | np.uint64(1)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    for k in range(n):
        part = padded[at + k] * factor[k]
        if k:
            part[size <= k] = 0
        out += part
    return mix(out + size.astype(np.uint64)), begin


def digest_rows(first: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, bytes | None]]:
    """For each text its sorted distinct values and their 128-bit digest (None if it has none)."""
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        own = np.unique(values[lo:hi])
        out.append((own, hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None))
    return out
