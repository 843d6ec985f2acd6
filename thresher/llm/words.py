"""Numpy kernels on words, shared by the operators that hash texts inside tasks.

A text arrives as UTF-8 bytes. ``bytes.split()`` cuts at the characters 0x20 and
0x09 to 0x0D only, which is the word rule of the corpus queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

# Bounds the memory of a task; a full table is emptied and filled again.
CACHED_WORDS = 300_000


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(texts: Iterable[bytes], cache: WordHashes
                ) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the hashes of all words in a row, and where each text ends there."""
    words = [text.split() for text in texts]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    total = int(ends[-1]) if len(ends) else 0
    hashes = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, total)
    return words, hashes, ends


def starts_inside(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position among all words) of every run of ``n`` words that stays in its text."""
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    sizes = np.maximum(ends - begins - n + 1, 0)
    text = np.repeat(np.arange(len(ends)), sizes)
    first = np.cumsum(sizes) - sizes
    return text, np.arange(sizes.sum()) - np.repeat(first - begins, sizes)


def sliding_min(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least value of every run of ``n`` values, and the first place where it stands."""
    at, length = np.arange(len(values)), 1
    while length < n:
        step = min(length, n - length)
        left = values[:-step] <= values[step:]
        at = np.where(left, at[:-step], at[step:])
        values = np.where(left, values[:-step], values[step:])
        length += step
    return values, at


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` values, by doubling; shorter input gives none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    power, size = 1, 0
    done, piece, length = None, hashes, 1
    rest = n
    while rest:
        if rest & 1:
            if done is None:
                done, size, power = piece, length, pow(base, length, 1 << 64)
            else:
                m = len(hashes) - (size + length) + 1
                done = done[:m] * np.uint64(pow(base, length, 1 << 64)) + piece[size:size + m]
                size += length
        rest >>= 1
        if rest:
            m = len(hashes) - 2 * length + 1
            piece = piece[:m] * np.uint64(pow(base, length, 1 << 64)) + piece[length:length + m]
            length *= 2
    return mix(done)


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` or a single row."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column).cast(pa.binary()))
        sizes = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
