"""Word shingles of whole texts as 64-bit hashes, in numpy, a few megabytes of text at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import pieces

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers, one for each place in a shingle: hashes of the place, so that no sum of some equals a sum of others.
PLACES = [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % k) | 1) for k in range(64)]
#: Added to the values in each round of a sketch.
SEEDS = [np.uint64((0xD1B54A32D192ED03 * (r + 1)) & 0xFFFFFFFFFFFFFFFF) for r in range(254)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches all output bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word seen; emptied when it grows, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """The contract's words: A-Z lower-cased, cut at [\\x20\\x09-\\x0D]. On UTF-8 bytes both hold by themselves."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list, width: int, cache: WordHashes):
    """(first, hashes, owners): for each piece of texts the distinct shingle hashes in order of (text, hash), and
    for each the text's place within the piece. Fewer words than width: the whole sequence is the one shingle.
    No word: no shingle."""
    for first, end in pieces(texts):
        split = [words(t) for t in texts[first:end]]
        length = np.array([len(w) for w in split], np.int64)
        h = cache.of([w for ws in split for w in ws])
        owner = np.repeat(np.arange(end - first), length)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        n = max(0, len(h) - width + 1)
        x = np.zeros(n, np.uint64)
        for k in range(width):
            x += h[k : k + n] * PLACES[k]
        whole = owner[:n] == owner[width - 1 : width - 1 + n]
        x, at = mix(x[whole] + np.uint64(width)), owner[:n][whole]
        short = np.flatnonzero((length > 0) & (length < width))
        if len(short):
            tail = np.array([np.sum(h[start[i] : start[i] + length[i]] * np.array(PLACES[: length[i]])) + np.uint64(length[i]) for i in short], np.uint64)
            x, at = np.concatenate([x, mix(tail)]), np.concatenate([at, short])
        order = np.lexsort((x, at))
        x, at = x[order], at[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (at[1:] != at[:-1])
        yield first, end, x[new], at[new]


def fast_sketch(x: np.ndarray, owner: np.ndarray, n_sets: int, bins: int) -> np.ndarray:
    """Fast similarity sketches of n_sets sets: row i is the sketch of the values x with owner i (sorted by owner).

    In rounds 0..bins-1 each value falls in a hashed bin; in rounds bins..2*bins-1 it falls in the bin of that
    round, so every bin of a set that isn't empty is filled in the end. A bin keeps its first round's smallest
    hash: the round is the entry's top byte, so one minimum over all rounds does it. Sets whose bins are all
    filled leave the rounds early; most long texts need one or two."""
    if bins > 127:
        raise ValueError("at most 127 bins: the round must fit one byte")
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_sets * bins, none, np.uint64)
    for r in range(2 * bins):
        if not len(x):
            break
        h = mix(x + SEEDS[r])
        bin_ = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(out, owner * bins + bin_, (np.uint64(r) << np.uint64(56)) | (h >> np.uint64(8)))
        if r < 4 or r % 16 == 0:
            open_ = (out.reshape(n_sets, bins) == none).any(axis=1)
            stay = open_[owner]
            x, owner = x[stay], owner[stay]
    return out.reshape(n_sets, bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` neighbouring bins."""
    n, bins = sketch.shape
    part = sketch.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64) * PLACES[40], part.shape[:2]).copy()
    for k in range(rows):
        key += part[:, :, k] * PLACES[k]
    return mix(key).view(np.int64)
