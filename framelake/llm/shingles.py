"""Numpy hashing of words and of windows of words, for whole parts of a corpus at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


#: Bytes of text whose letters are hashed at once; a letter takes some 50 bytes meanwhile.
HASHED_BYTES = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, in order, and how many words each text has."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    found, before, n, at = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), 0, 0
    while at < len(buffer):
        to = _word_end(buffer, at + HASHED_BYTES)
        hashes, starts = _hashed(buffer[at:to])
        own = slice(*np.searchsorted(ends, [at, to], "right"))
        before[own] = n + np.searchsorted(starts, ends[own] - at)
        found.append(hashes)
        n, at = n + len(hashes), to
    return np.concatenate(found), np.diff(before, prepend=0)


def _word_end(buffer: np.ndarray, at: int) -> int:
    """The first place from `at` on that no word goes over: a space, or the end."""
    while at < len(buffer):
        space = _SPACE[buffer[at : at + 4096]]
        if space.any():
            return at + int(space.argmax())
        at += 4096
    return len(buffer)


def _hashed(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a buffer, and where they start."""
    space = _SPACE[buffer]
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(word)
    number = np.cumsum(start)[at] - 1
    place = at - starts[number]
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP))
    return mix(np.add.reduceat(_BYTE[buffer[at]] * powers[place], np.flatnonzero(place == 0))), starts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words, by doubling: a window of 2n words is the hash of its two halves, an odd word is added."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    if size == 1:
        return mix(words + np.uint64(1))
    half = window_hashes(words, size // 2)
    n = len(words) - size + 1
    out = mix(half[:n] * _STEP + mix(half[size // 2 : size // 2 + n] + np.uint64(size)))
    return out if size % 2 == 0 else mix(out * _STEP + words[size - 1 :])


def window_owner(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (places among all words) of the windows that lie inside one text, and the number of that text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(doc) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
    return starts, doc[starts]


# ---- arrays as bytes


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all lowest bytes first: equal high bytes then stand together, and Spark's codec shrinks them."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n = len(data) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def sorted_planes(a: np.ndarray) -> bytes:
    """planes() of the gaps of a sorted array of unsigned values."""
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def from_sorted_planes(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.cumsum(from_planes(data, kind), dtype=kind)
