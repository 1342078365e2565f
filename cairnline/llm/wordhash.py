"""Words of a text, their 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

# Letters A-Z to lower case; digits, letters and all bytes of non-ASCII characters stay; the rest
# becomes a space. So words are the runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MIX = np.uint64(0x9E3779B97F4A7C15)


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(_ALNUM).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.lower().split()


class Hashes:
    """64-bit hashes of words, remembered for up to ``most`` words."""

    def __init__(self, most: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; none if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for n in range(k):
        out = mixed(out * MIX + h[n: len(h) - k + 1 + n])
    return out


def split_hashes(texts_words: list[list[bytes]], hashes: Hashes) -> list[np.ndarray]:
    """Word hashes of several texts at once."""
    n = np.cumsum([len(w) for w in texts_words])
    return np.split(hashes([w for ws in texts_words for w in ws]), n[:-1]) if len(n) else []


word_hashes = Hashes()
