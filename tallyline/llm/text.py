"""Words of whole texts as 64-bit hashes, computed on byte arrays inside Arrow tasks.

Words are runs of bytes other than ASCII white space after lower-casing A-Z, so
``bytes.lower`` and ``bytes.split`` agree with these functions byte for byte.
Texts are handled in segments of about a megabyte; memory does not grow with the
longest text beyond its hashes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SEGMENT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 1024)
        for k, step in enumerate((_BASE, _INVERSE)):
            full = np.full(size, step, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one lower-cased segment."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of about a segment."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = at + SEGMENT
        while cut < len(text) and text[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and offsets (one more than texts); null is empty."""
    found, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        if not group:
            return
        joined = b"\n".join(t for _, t in group)
        words, starts = _segment_words(np.frombuffer(joined, np.uint8))
        bounds = np.cumsum([0] + [len(t) + 1 for _, t in group])
        per = np.diff(np.searchsorted(starts, bounds))
        np.add.at(counts, [k for k, _ in group], per)
        found.append(words)
        group.clear()

    for k, text in enumerate(texts):
        for piece in _pieces(text.lower()) if text else ():
            if size + len(piece) > SEGMENT:
                flush()
                size = 0
            group.append((k, piece))
            size += len(piece) + 1
    flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def word_counts(texts: list[bytes | None]) -> np.ndarray:
    return np.array([len(t.split()) if t else 0 for t in texts], np.int64)


@F.pandas_udf(LongType())
def n_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(t.encode("utf-8", "replace").split()) if isinstance(t, str) else 0).astype("int64")


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def few_at_a_time(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches whose texts have about ``most`` bytes together."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else []
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
        del column, at, batch
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return freed memory to the system at the end of a partition; the worker lives on beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; of a shorter text, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    take, odd = min(width, n), np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(n - take + 1, np.uint64)
    for k in range(take):
        out *= odd
        out += words[k: n - take + 1 + k]
    if n < width:
        out += np.uint64(n * int(_BASE) % (1 << 64))
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
