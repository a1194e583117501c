"""Byte-level BPE of whole batches, encoding each distinct stretch of text once.

A text may be cut before a space that a non-space follows: no match of the
split pattern crosses such a place, and none looks beyond it in a way that
changes the match. So a stretch between two cuts has the same ids wherever it
stands, and stretches that start with such a space may be encoded joined: the
tokens' byte lengths tell where each one's ids end. Only cuts before bytes that
surely start a non-space are used, so a stretch may hold several words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._words import _VALUE, _powers, groups, mix

_U = np.uint64
_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = True
_SURE[0xC3:0xF5] = True
_SURE[0xE1:0xE4] = False  # these may start a space of more than one byte
_BYTE = mix(_VALUE + np.arange(256, dtype=np.uint64))  # tells capitals from small letters


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (in ``data``) of the stretches of a range of documents, in order."""
    base = offsets[0]
    own = data[base : offsets[-1]]
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.zeros(len(own), bool)
    first[:-1] = (own[:-1] == 0x20) & _SURE[own[1:]]
    at = offsets[:-1] - base
    first[at[at < len(own)]] = True  # an empty document's place is that of the next
    starts = np.flatnonzero(first)
    lens = np.diff(np.append(starts, len(own)))
    pos = np.arange(len(own)) - np.repeat(starts, lens)
    value = _BYTE[own] * _powers(pos)
    return mix(np.add.reduceat(value, starts) + lens.astype(np.uint64) * _U(0xA24BAED4963EE407)), starts + base


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class BatchEncoder:
    """``encode_text`` gives the ids of a text, ``token_bytes`` the length of each id in bytes."""

    MOST, JOINED = 3 << 19, 1 << 18

    def __init__(self, encode_text: Callable[[str], np.ndarray], token_bytes: np.ndarray):
        self.encode_text, self.token_bytes = encode_text, token_bytes
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _fresh(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which the stretches were taken, their ids in that order, and the number of each one's."""
        joins = lens > 1
        joins[joins] = (data[starts[joins]] == 0x20) & _SURE[data[starts[joins] + 1]]
        spots, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        ids, counts = [], []
        group = np.cumsum(lens[spots]) // self.JOINED
        for g in np.split(spots, np.flatnonzero(np.diff(group)) + 1) if len(spots) else ():
            got = self.encode_text(data[ragged(starts[g], lens[g])].tobytes().decode())
            ends = np.searchsorted(np.cumsum(self.token_bytes[got]), np.cumsum(lens[g])) + 1
            ids.append(got)
            counts.append(np.diff(ends, prepend=0))
        for i in alone.tolist():
            ids.append(self.encode_text(data[starts[i] : starts[i] + lens[i]].tobytes().decode()))
        counts.append(np.asarray([len(x) for x in ids[len(counts) :]], np.int64))
        return np.concatenate([spots, alone]), np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents, one after the other, and the n + 1 places where they start."""
        found = [stretches(data, offsets[a : b + 1]) for a, b in groups(offsets)]
        if not found or not sum(len(h) for h, _ in found):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h, at = (np.concatenate(x) for x in zip(*found, strict=True))
        lens = np.diff(np.append(at, offsets[-1]))
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = np.ones(len(uniq), bool)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
            new = self.keys[spot] != uniq
        if len(self.keys) + new.sum() > self.MOST:
            self._forget()
            new[:] = True
        taken, ids, fresh = self._fresh(data, at[first[new]], lens[first[new]])
        counts, starts = np.empty_like(fresh), np.empty_like(fresh)
        counts[taken] = fresh
        starts[taken] = len(self.ids) + np.cumsum(fresh) - fresh
        place = np.searchsorted(self.keys, uniq[new])
        self.keys, self.starts, self.counts = (np.insert(x, place, y) for x, y in ((self.keys, uniq[new]), (self.starts, starts), (self.counts, counts)))
        self.ids = np.concatenate([self.ids, ids])
        entry = np.searchsorted(self.keys, uniq)[inverse]
        counts = self.counts[entry]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ragged(self.starts[entry], counts)], ends[np.searchsorted(at, offsets)]
