"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

CACHED_WORDS = 400_000
SLICE = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = Hashes()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text after lower-casing A-Z. bytes.lower() and bytes.split() know exactly A-Z and the six white-space characters."""
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    out, at = [], 0
    while at < len(text):  # long texts in slices that end at white space
        end = at + SLICE
        if end < len(text):
            cut = SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        words = text[at:end].lower().split()
        out.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: One odd multiplier for each place of a shingle, from a rule.
PLACES = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of all ``n``-word shingles; fewer words make one shingle of the whole sequence, no word makes none."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(n, len(w))
    m = len(w) - size + 1
    h = np.full(m, size, np.uint64)
    for k in range(size):
        h += w[k : k + m] * PLACES[k]
    return np.unique(mixed(h))
