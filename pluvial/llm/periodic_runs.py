"""Runs of repeated words, found online by catchers over power-of-two blocks.

Words are appended to ``Catchers``. Every completed block of 2^k words that
starts at a multiple of 2^k has a catcher; it watches the next 2^k to
2^(k+1) - 1 places after its start, so an appended word advances one suffix
comparison for each k: the last 2^k words against one block. Where they agree
at a distance q, a square of period q may lie around both; its ends are found
by comparing words, it is reported once its two halves are whole, and what
grows on with the same period is one run. A run of period q and 3 q words
holds a whole block and its copy for the k with 2^k <= q < 2^(k+1), so none is
missed.

A block whose copies lie closer than half its length has a short period d
itself. Of all those distances only two can be the period of a longer run: a
place where the d-periodic stretch ends has to meet the end of its copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, text_bytes
from ._words import _SPACE, groups, mix

_U = np.uint64
WIDTH, CELLS, CHUNK_WORDS = 16, 1 << 19, 1 << 16


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for two blocks in a row."""
    x = (a ^ (a >> _U(32))) * _U(0xFF51AFD7ED558CCD)
    x += b
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


class Catchers:
    """Squares and runs of a sequence that grows by ``append``; ``longest`` bounds the periods."""

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.words = np.zeros(0, np.int64)
        self.names: list[np.ndarray] = []  # by k: names of the blocks from self.first[k] on
        self.first: list[int] = []
        self.waiting: list[np.ndarray] = []  # by k: agreeing places whose catchers are not done
        self.open: list[tuple[int, int]] = []  # (period, start) of stretches that reach the last word
        self.reported: set[tuple[int, int]] = set()
        self.closed: list[tuple[int, int, int]] = []

    def _equal(self, a: np.ndarray, b: np.ndarray, step: int, most: int | None = None) -> np.ndarray:
        """How many words agree from a and from b > a on, forward (``step`` 1) or backward (-1), up to ``most``."""
        w, n = self.words, len(self.words)
        room = n - b if step == 1 else a + 1
        if most is not None:
            room = np.minimum(room, most)
        out, live, width = np.zeros(len(a), np.int64), np.flatnonzero(room > 0), WIDTH
        while len(live):
            width_now = max(1, min(width, CELLS // len(live)))
            t = np.arange(width_now)
            x, y = a[live] + step * out[live], b[live] + step * out[live]
            inside = t < (room[live] - out[live])[:, None]
            same = inside & (w[np.clip(x[:, None] + step * t, 0, n - 1)] == w[np.clip(y[:, None] + step * t, 0, n - 1)])
            got = np.where(same.all(axis=1), width_now, same.argmin(axis=1))
            out[live] += got
            live, width = live[(got == width_now) & (out[live] < room[live])], width * 4
        return out

    def _named(self, k: int) -> tuple[int, int]:
        """Names the blocks of level k that the last words completed; the range of their starts."""
        b, n = 1 << k, len(self.words)
        a, z = self.first[k] + len(self.names[k]), n - b + 1
        if k == 0:
            new = mix(self.words[a:z].astype(np.uint64))
        else:
            below, at, half = self.names[k - 1], self.first[k - 1], b >> 1
            new = _pair(below[a - at : z - at], below[a + half - at : z + half - at])
        self.names[k] = np.concatenate([self.names[k], new])
        return a, z

    def _let_go(self, k: int) -> None:
        """Keeps the names from the block on that the next place is compared with."""
        b = 1 << k
        at = max(0, ((self.first[k] + len(self.names[k])) // b - 1) * b)
        self.names[k], self.first[k] = self.names[k][at - self.first[k] :].copy(), at

    def _candidates(self, k: int, spots: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks and distances worth extending, and the places that stay waiting. z: the first start not seen yet."""
        b, n = 1 << k, len(self.words)
        block = spots // b - 1
        head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        count = np.diff(np.append(head, len(spots)))
        few = np.repeat(count <= 2, count)
        anchors, periods = [block[few] * b], [spots[few] - block[few] * b]
        wait = (block[head] + 2) * b > z
        many = head[count > 2]
        if len(many):
            x, p = block[many] * b, spots[many]
            d, most = spots[many + 1] - p, 3 * b
            apart = self._equal(x, x + d, 1, most) < p - x  # else both lie in one d-periodic stretch
            x, p, d = x[apart], p[apart], d[apart]
            right = x + self._equal(x, x + d, 1, most), p + self._equal(p, p + d, 1, most)
            left = x - self._equal(x - 1, x + d - 1, -1, most), p - self._equal(p - 1, p + d - 1, -1, most)
            for q in (right[1] - right[0], left[1] - left[0]):
                fits = (q >= b) & (q < 2 * b)
                anchors.append(x[fits])
                periods.append(q[fits])
            unknown = np.zeros(len(head), bool)
            unknown[np.flatnonzero(count > 2)[apart]] = right[1] + d >= n
            wait |= unknown
        return np.concatenate(anchors), np.concatenate(periods), spots[np.repeat(wait, count)]

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Takes the next words, whole numbers; returns (period, start) of the squares that they complete first."""
        old = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        n = len(self.words)
        if n == old:
            return []
        grown = [(q, s, old + int(more)) for (q, s), more in zip(self.open, self._equal(np.asarray([old - q for q, _ in self.open], np.int64), np.full(len(self.open), old), 1), strict=True)] if self.open else []
        for k in range(n.bit_length()):
            b = 1 << k
            if b > n or self.longest is not None and b > self.longest:
                break
            if k == len(self.names):
                self.names.append(np.zeros(0, np.uint64))
                self.first.append(0)
                self.waiting.append(np.zeros(0, np.int64))
            a, z = self._named(k)
            at = np.arange(max(a, b), z)
            hits = at[self.names[k][at - self.first[k]] == self.names[k][(at // b - 1) * b - self.first[k]]] if len(at) else at
            spots = np.concatenate([self.waiting[k], hits])
            if len(spots):
                x, q, self.waiting[k] = self._candidates(k, spots, z)
                grown += self._extended(x, q, b, grown)
            if k:
                self._let_go(k - 1)
        fresh_squares, self.open = [], []
        for q, s, e in grown:
            if e - s >= 2 * q and (q, s) not in self.reported:
                self.reported.add((q, s))
                fresh_squares.append((q, s))
            if e == n:
                self.open.append((q, s))
            elif e - s >= 2 * q:
                self.closed.append((s, e, q))
        return fresh_squares

    def _extended(self, x: np.ndarray, q: np.ndarray, b: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(period, start, end) of the stretches around the blocks x and their copies at distance q."""
        if not len(x):
            return []
        order = np.lexsort((x, q))
        x, q = x[order], q[order]
        head = np.concatenate([[True], (q[1:] != q[:-1]) | (x[1:] - x[:-1] > b)])  # a block after another at the same distance adds nothing
        x, q = x[head], q[head]
        for kq, ks, ke in known:
            own = (q == kq) & (x >= ks) & (x + q < ke)
            if own.any():
                x, q = x[~own], q[~own]
        start = x - self._equal(x - 1, x + q - 1, -1)
        end = x + q + self._equal(x, x + q, 1)
        alive = (end - start >= 2 * q) | (end == len(self.words))
        return sorted(set(zip(q[alive].tolist(), start[alive].tolist(), end[alive].tolist(), strict=True)))

    def runs(self, least: int = 24, exponent: int = 3) -> np.ndarray:
        """Rows (start, end, period) of at least ``least`` words and ``exponent`` >= 3 periods, by start and period."""
        n = len(self.words)
        found = np.asarray(sorted({*self.closed, *((s, n, q) for q, s in self.open)}), np.int64).reshape(-1, 3)
        length = found[:, 1] - found[:, 0]
        found = found[(length >= least) & (length >= exponent * found[:, 2])]
        # multiples of a run's period have its ends too
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[first]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a range of documents as one Arrow array, and how many each document has."""
    base, data = offsets[0], data[offsets[0] : offsets[-1]]
    at = offsets - base
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    starts = np.flatnonzero(first)
    ends = np.append(np.flatnonzero(first[inside]), inside.sum()).astype(np.int32)  # a range is one long text, or about a MB
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return words, np.diff(np.searchsorted(starts, at)).astype(np.int64)


def runs_of(words: pa.Array, counts: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents in a row: each run's document, the runs (start, end, period) within their documents,
    and which words stay. A mark that occurs once stands after each document, so no run crosses it."""
    n, ends = len(counts), np.cumsum(counts)
    ids = np.zeros(len(words) + n, np.int64)
    marks = ends + np.arange(n)
    text = np.ones(len(ids), bool)
    text[marks] = False
    ids[text] = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids[marks] = -1 - np.arange(n)
    caught = Catchers(max(1, int(counts.max(initial=0)) // exponent))
    for a in range(0, len(ids), CHUNK_WORDS):
        caught.append(ids[a : a + CHUNK_WORDS])
    runs = caught.runs(least, exponent)
    doc = np.searchsorted(marks, runs[:, 0])
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    stays = np.cumsum(change[:-1])[text] == 0
    begin = ends - counts + np.arange(n)
    return doc, runs - np.stack([begin[doc], begin[doc], np.zeros(len(doc), np.int64)], axis=1), stays


def find(docs: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row, where it stands: no shuffle.

    ``runs``: structs (start, length, period) by start and period, of maximal
    stretches of at least ``least`` words and ``exponent`` (3 or more) times
    their smallest period. ``collapsed``: the words joined by one space, without
    those that some run holds after its first period. Words are maximal runs of
    characters other than 0x20 and 0x09-0x0D, compared as they are. A null text
    counts as empty: no runs, an empty ``collapsed``. Rows repeat as they came,
    null ids stay null, other columns take no part; an empty table gives no rows.
    """
    if exponent < 3 or least < 1:
        raise ValueError("runs have at least three periods and one word")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in groups(offsets, 1 << 20, 4096):
                words, counts = split(data, offsets[a : b + 1])
                doc, runs, stays = runs_of(words, counts, least, exponent)
                if not stays.all():
                    words, left = words.filter(pa.array(stays)), np.add.reduceat(np.append(stays, False).astype(np.int64), np.cumsum(counts) - counts)
                    left[counts == 0] = 0
                else:
                    left = counts
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), words)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, 0]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(struct))
                places = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), pa.ListArray.from_arrays(places, rows), pc.binary_join(listed, " ")],
                    ["id", "n_words", "runs", "collapsed"],
                )

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = picked.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
