"""Words and their hashes inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Entries a per-task word cache may have; past that it starts anew.
CACHE = 300_000


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; empty for null."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def split(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words. bytes.split() parts at exactly space and tab to return."""
    return text.lower().split()


class Hashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
