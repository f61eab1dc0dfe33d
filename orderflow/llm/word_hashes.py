"""Words and runs of words as 64-bit hashes, in arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

#: Words a process remembers the hashes of.
REMEMBERED = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over the others."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class WordHashes(dict):
    """Word to hash; remembers what it has seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of so many words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, length, np.uint64)
    for i, factor in enumerate(odd_numbers(length, seed)):
        total += words[i : i + n] * factor
    return mixed(total)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PART = 1 << 20


class ByteRuns:
    """Hashes of the words of a text from sums over its bytes, without a Python object per word.

    A word's hash is a polynomial of its bytes, the difference of two running sums,
    brought back to the word's start by the inverse of the base.
    """

    def __init__(self) -> None:
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_PART + 1, _BASE))])
        self.inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_PART + 1, _INVERSE))])

    def _part(self, data: bytes) -> np.ndarray:
        array = np.frombuffer(data, np.uint8)
        inside = np.empty(len(array) + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.not_equal(array, 32, out=inside[1:-1].view(bool))
        change = np.diff(inside)
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        sums = np.zeros(len(array) + 1, np.uint64)
        np.cumsum((array.astype(np.uint64) + np.uint64(1)) * self.powers[: len(array)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def of(self, data: bytes) -> np.ndarray:
        """Hashes of the words of data, which spaces set apart."""
        if len(data) <= _PART:
            return self._part(data)
        parts, start = [], 0
        while start < len(data):
            stop = len(data) if len(data) - start <= _PART else data.rfind(b" ", start, start + _PART)
            if stop <= start:  # one word longer than a part
                stop = data.find(b" ", start + _PART)
                stop = len(data) if stop < 0 else stop
                word = data[start:stop].strip()
                parts.append(np.array([xxhash.xxh3_64_intdigest(word)] if word else [], np.uint64))
            else:
                parts.append(self._part(data[start:stop]))
            start = stop + (stop < len(data))
        return np.concatenate(parts)
