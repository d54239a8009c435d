"""Digests of words and of word shingles of whole texts, vectorised over the bytes of a batch."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from .common import mix64

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The low 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Two independent digests are told apart by these.
SALTS = (0x51ED270B27B4F3A5, 0xA24BAED4963EE407)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _later(starts: np.ndarray, sizes: np.ndarray):
    """The eight-byte blocks after the first of each stretch: whose they are, their number, place and bytes left."""
    more = np.maximum((sizes + 7) // 8 - 1, 0)
    of = np.repeat(np.arange(len(sizes)), more)
    nth = 1 + np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
    return of, nth, starts[of] + 8 * nth, np.minimum(sizes[of] - 8 * nth, 8)


def digests(word: np.ndarray, starts: np.ndarray, sizes: np.ndarray, salts: tuple[int, ...] = SALTS[:1]) -> list[np.ndarray]:
    """A 64-bit digest of each stretch of bytes for each salt; word: see eights.

    Each eight-byte block goes with its number through a bijection that is not linear before the blocks are
    added up. Built stretches can still agree, so whoever takes equal digests for equal bytes compares the bytes.
    """
    first = word[starts] & _LOW[np.minimum(sizes, 8)]
    of, nth, at, left = _later(starts, sizes)
    blocks = word[at] & _LOW[left]
    place = mix64(nth.astype(np.uint64) * _STEP)
    out = []
    for salt in salts:
        total = mix64(first ^ _U(salt))
        if len(of):
            new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[new]] += np.add.reduceat(mix64(blocks ^ place ^ _U(salt)), new)
        out.append(mix64(total + sizes.astype(np.uint64) * _LENGTH))
    return out


def same_bytes(word: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether stretches of equal sizes in two texts (see eights) hold the same bytes."""
    low = _LOW[np.minimum(sizes, 8)]
    same = (word[starts] & low) == (other[places] & low)
    of, nth, at, left = _later(starts, sizes)
    differ = (word[at] ^ other[places[of] + 8 * nth]) & _LOW[left] != 0
    same[of[differ]] = False
    return same


def word_places(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the number of each text's first word (len + 1)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = ~space[data]
    first = np.zeros(n + 1, bool)
    first[off] = True  # a text starts here
    start = solid.copy()
    start[1:] &= first[1:n] | ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= first[1:n] | ~solid[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


class WordDigests(dict):
    """The place of each word's BLAKE2b digest of 128 bits in two lists of 64: built words can't share one."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.raw = most, bytearray()

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.raw += blake2b(word, digest_size=16).digest()
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
            self.raw = bytearray()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        cells = np.frombuffer(bytes(self.raw), "<u8").reshape(-1, 2)[at]
        return cells[:, 0].copy(), cells[:, 1].copy()


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int, known: WordDigests | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in the order of their first digest, laid end to end: both digests, and where each text's begin (len + 1).

    A text of fewer words than the width has its whole sequence as one shingle; one without words has none. The digests of a
    shingle's words are chained. known: remembers words from call to call.
    """
    starts, ends, at = word_places(data, off)
    n = len(starts)
    lowered = LOWER[data].tobytes()
    by_word = (WordDigests() if known is None else known).of([lowered[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
    grams = []
    for words, salt in zip(by_word, SALTS, strict=True):
        chain = np.full(max(0, n - width + 1), salt, np.uint64)
        for j in range(width if len(chain) else 0):
            chain = mix64(chain ^ words[j : j + len(chain)])
        grams.append(chain)
    one, two, sizes = [], [], np.zeros(len(off) - 1, np.int64)
    for i in range(len(off) - 1):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= width:
            mine = grams[0][lo : hi - width + 1]
            order = np.argsort(mine)
            mine = mine[order]
            new = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            one.append(mine[new])
            two.append(grams[1][lo : hi - width + 1][order[new]])
            sizes[i] = len(new)
        elif hi > lo:
            whole = blake2b(b" ".join(lowered[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)), digest_size=16)
            for value, out in zip(np.frombuffer(whole.digest(), "<u8"), (one, two), strict=True):
                out.append(np.array([value], np.uint64))
            sizes[i] = 1
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *one]), np.concatenate([none, *two]), np.r_[0, np.cumsum(sizes)]
