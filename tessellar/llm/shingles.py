"""Word-shingle sets as sorted 64-bit hashes, and signatures under which similar sets must meet."""

from __future__ import annotations

import numpy as np
import xxhash

from tessellar.llm.common import claim

#: A-Z in lower case; words lie between ASCII white space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Entries of a worker's cache of word hashes; a full one is emptied between slices.
CACHE = 80_000
#: Sizes of one level of signatures lie within this factor.
LEVEL = 3
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, none without words."""
    claim("shingles", _words.clear)
    if len(_words) > CACHE:
        _words.clear()
    out = []
    look = _words.__getitem__
    for text in texts:
        words = text.encode().translate(LOWER).split()
        h = np.fromiter(map(look, words), np.uint64, len(words))
        n = len(h) - width + 1
        if not len(h):
            out.append(h)
            continue
        span = width if n >= 1 else len(h)
        mixed = np.full(max(n, 1), np.uint64(span), np.uint64)
        for k in range(span):
            mixed = mix(mixed * _M1 + h[k : k + len(mixed)])
        out.append(np.unique(mixed))
    return out


def set_hash(own: np.ndarray) -> int:
    """A signed 64-bit name for a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes()))))


class Levels:
    """Prefix signatures by levels of sizes, for Jaccard similarity >= percent / 100.

    In any one order of all shingles, two such sets of n and m shingles share at least percent / 100 of
    the larger, so each has one of the shared ones among its first n - ceil(n * percent / 100) + 1: those
    prefixes meet. The order is by hash, with the shingles that are frequent in a sample last, so
    that prefixes are rare; which are taken as frequent changes how many sets meet by chance, not
    which similar ones must. A set signs its prefix at its level of sizes, and at the next if a
    partner may lie there, so that sets of very different sizes do not meet.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [0]
        while self.bounds[-1] < 1 << 32:
            low = self.bounds[-1] + 1
            self.bounds.append(max(low * 100 // percent, low * LEVEL))
        self.upper = np.array(self.bounds)

    def of(self, size: int) -> list[int]:
        level = int(np.searchsorted(self.upper, size))
        return [level] if size * 100 // self.percent <= self.bounds[level] else [level, level + 1]

    def signatures(self, sets: list[np.ndarray], frequent: np.ndarray | None = None) -> list[np.ndarray]:
        """The int64 signatures of each set; none if only an equal set could be similar."""
        return [self._own(own, frequent) for own in sets]

    def _own(self, own: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
        n = len(own)
        if 100 * n < self.percent * (n + 1):
            return np.zeros(0, np.int64)
        length = n - -(-self.percent * n // 100) + 1
        if frequent is not None and len(frequent):
            at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
            rare = frequent[at] != own
            own = np.concatenate([own[rare], own[~rare]])
        return np.concatenate([mix(own[:length] + np.array([level], np.uint64) * _M1) for level in self.of(n)]).view(np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)
