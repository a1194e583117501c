"""Words of whole batches of texts as 64-bit hashes, without a loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased. UTF-8 keeps those bytes out of longer characters, so bytes serve.
A word's hash is a polynomial over 2^64 with a random value for each byte,
mixed with the word's length; hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 19
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every input bit moves about half of all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_VALUE[65:91] = _VALUE[97:123]
_STEP = _U(0xD6E8FEB86659FD93)
_TILE = 1 << 12
with np.errstate(over="ignore"):
    _LOW = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_TILE - 1, _STEP)]))
    _TILE_STEP = _LOW[-1] * _STEP


def _powers(pos: np.ndarray) -> np.ndarray:
    top = int(pos.max(initial=0)) >> 12
    if not top:
        return _LOW[pos]
    high = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(top, _TILE_STEP)]))
    return _LOW[pos & (_TILE - 1)] * high[pos >> 12]


def groups(offsets: np.ndarray, size: int = CHUNK, most: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of up to ``most`` documents and about ``size`` bytes each; a longer document is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, a + most, max(b, a + 1))
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """For a range of documents: the words' hashes in order, the number of words of each
    document, and for each length in ``prefixes`` the hashes of the words' first bytes
    (0 for words not longer than that)."""
    n = len(offsets) - 1
    base, data = offsets[0], data[offsets[0] : offsets[-1]]
    at = offsets - base
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, at)).astype(np.int64)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return (z, counts, *(z for _ in prefixes))
    packed = data[inside]
    begin = np.flatnonzero(first[inside])
    lens = np.diff(np.append(begin, len(packed)))
    pos = np.arange(len(packed)) - np.repeat(begin, lens)
    with np.errstate(over="ignore"):
        value = _VALUE[packed] * _powers(pos)
        out = [mix(np.add.reduceat(value, begin) + lens.astype(np.uint64) * _U(0xA24BAED4963EE407)), counts]
        for k in prefixes:
            part = mix(np.add.reduceat(np.where(pos < k, value, _U(0)), begin) ^ _U(0x5851F42D4C957F2D * k & (1 << 64) - 1))
            out.append(np.where(lens > k, part, _U(0)))
    assert n == len(counts)
    return tuple(out)


def document_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def combine(*parts: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash from equally long arrays of hashes; order counts."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for p in parts:
            h = (h ^ (h >> _U(29))) * _U(0xFF51AFD7ED558CCD) + p
        return mix(h)
