"""What the text operators share: Arrow columns to bytes, words as spans of a byte string, word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z and nothing else.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def pieces(rows: Iterable, weights: Iterable[int], limit: int) -> Iterator[list]:
    """Consecutive rows in lists of about `limit` total weight; one heavy row makes a list of its own."""
    held, total = [], 0
    for row, weight in zip(rows, weights, strict=True):
        if held and total + weight > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += weight
    if held:
        yield held


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per word; forgets everything when it has grown to `most` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes (modulo 2**64) of every run of a given length in a sequence of word hashes."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        with np.errstate(over="ignore"):
            self.power = _powers(self.BASE, self.n + 1)
            self.back = _powers(self.INVERSE, self.n + 1)
            self.sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(words * self.power[: self.n], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of words[start:end], for each pair; equal runs have equal hashes wherever they stand."""
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self.back[starts]

    def windows(self, length: int) -> np.ndarray:
        starts = np.arange(max(0, self.n - length + 1))
        return self.runs(starts, starts + length)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return values ^ (values >> np.uint64(33))


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values in Spark's signed long."""
    return values.view(np.int64)
