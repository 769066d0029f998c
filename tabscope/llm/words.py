"""Words of a shard of texts as numpy arrays: places in one buffer, the text they belong to, hashes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)  # ASCII digits and letters, and every byte of other characters
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << 16, n + n // 8)  # not the next power of two: every worker keeps them
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


class Words:
    """All words of some texts, lower-cased (A-Z only). ``member[b]`` says whether byte b is part of a word."""

    def __init__(self, texts: list[bytes | None], member: np.ndarray):
        self.joined = b" ".join(t or b"" for t in texts) + b" "
        self.bytes = LOWER[np.frombuffer(self.joined, np.uint8)]
        inside = member[self.bytes]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edge[::2], edge[1::2]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes)
        self.text_of = np.searchsorted(self.text_ends, self.starts, side="right")
        self.counts = np.bincount(self.text_of, minlength=len(texts)).astype(np.int64)
        self._sums: np.ndarray | None = None

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``longest`` bytes."""
        n = len(self.bytes)
        up, down = _powers_to(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mixed((self._sums[ends] - self._sums[self.starts]) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of multiplications and shifts)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_of(word: bytes) -> int:
    """The hash that ``Words.hashes`` gives one word."""
    found = Words([word], np.ones(256, bool) & NOT_SPACE).hashes()
    return int(found[0])
