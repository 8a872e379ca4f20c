"""Words of a slice of texts and their 64-bit hashes, as flat numpy arrays.

Words are runs of bytes outside x20 and x09-x0D, or outside another set. All sums are modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.RandomState(20240607)
_BYTES = _RNG.randint(0, 1 << 62, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
#: Odd multipliers: of a byte's place in its word, and of a word's place in its window.
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_GAP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: int) -> int:
    return pow(int(base), -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each text starts (one more for the end). Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Flat words: `start` and `end` bytes, `first` word of each text (one more for the end)."""

    def __init__(self, data: np.ndarray, text_at: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        self.data, self.text_at = data, text_at
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[text_at] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, text_at)
        self.lower = lower

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash of each word; `lower` takes A-Z as a-z."""
        if not len(self):
            return np.zeros(0, np.uint64)
        table = _BYTES[which].copy()
        if self.lower:
            table[65:91] = table[97:123]
        lengths = self.end - self.start
        inside = np.repeat(self.end - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
        place = inside - np.repeat(self.start, lengths)
        terms = table[self.data[inside]] * powers(_STEP[which], int(lengths.max()))[place]
        sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def place(self) -> np.ndarray:
        """Each word's number in its text."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], np.diff(self.first))

    def text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self))


class Windows:
    """Hashes of any run of words, from running sums."""

    def __init__(self, word_hashes: np.ndarray, which: int = 0):
        self.base = _GAP[which]
        self.up = powers(self.base, len(word_hashes) + 1)
        self.down = powers(np.uint64(inverse(self.base)), len(word_hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes * self.up[: len(word_hashes)], dtype=np.uint64)])

    def at(self, starts: np.ndarray, n) -> np.ndarray:
        """Hashes of the n words from each start; the same words give the same hash wherever they stand."""
        return mix((self.sums[starts + n] - self.sums[starts]) * self.down[starts])
