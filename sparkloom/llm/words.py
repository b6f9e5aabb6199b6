"""Words and word windows inside Arrow workers.

``bytes.split()`` without arguments splits at runs of exactly the bytes 20 and
09-0D, which is the word rule ``[^\\x20\\x09-\\x0D]+`` used throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words kept in a worker's hash cache before it starts afresh.
CACHE_WORDS = 150_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """word -> 64-bit hash, computed once per cached word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def lowered(text: bytes) -> bytes:
    """ASCII letters lower-cased; other bytes kept."""
    return text.lower()


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` consecutive word hashes."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = ids[:n].copy()
    for j in range(1, size):
        h *= _ODD
        h ^= h >> _S29
        h += ids[j : j + n]
    h *= _ODD
    h ^= h >> _S32
    return h


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that only so many texts are Python objects at once."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
