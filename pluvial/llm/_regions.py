"""Links within one region of sets in the Jaccard metric space.

A region is cut into Voronoi cells about a few pivots, each the set farthest
from those before. A set belongs to the cell of its nearest pivot and, as a
boundary set, to every other whose distance is within 2 * radius of the
nearest's: by the triangle inequality two linked sets keep a common cell. Cells
are cut again; a link that lies in several cells counts in the first. What is
small or doesn't shrink is compared directly: elements of few sets propose
pairs, and sets that could link by elements of many alone are multiplied out
block by block, so no pair goes unseen. Links come in blocks as well: near
copies of one text link all with all, and who only counts them needs no list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from ._chunks import ragged

#: Sets of a cell that is not cut again; pivots; sets of a block; elements that are multiplied at once; most pairs held.
LEAF, PIVOTS, BLOCK, COLUMNS, PAIRS = 64, 8, 1024, 4096, 1 << 22


Links = tuple[np.ndarray, np.ndarray]


class Sets:
    """Arrays of distinct ascending elements, one after the other."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.n = sets, np.asarray([len(s) for s in sets], np.int64)
        self.flat, self.start = np.concatenate(sets), np.cumsum(self.n) - self.n

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of some sets and the place in ``at`` that each comes from."""
        return self.flat[ragged(self.start[at], self.n[at])], np.repeat(np.arange(len(at)), self.n[at])

    def distances(self, pivot: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, owner = self.take(at)
        both = np.bincount(owner, pivot[np.minimum(np.searchsorted(pivot, x), len(pivot) - 1)] == x, len(at))
        return 1 - both / (len(pivot) + self.n[at] - both)


def boundary(d: np.ndarray, percent: int) -> np.ndarray:
    """Which cells (rows) each set belongs to, from its distances to their pivots."""
    return d <= d.min(axis=0) + 2 * (1 - percent / 100) + 1e-9


def cells(sets: Sets, at: np.ndarray, percent: int) -> np.ndarray:
    nearest, rows, pick = np.full(len(at), 2.0), [], 0
    for _ in range(PIVOTS):
        rows.append(sets.distances(sets.sets[at[pick]], at))
        nearest = np.minimum(nearest, rows[-1])
        pick = int(nearest.argmax())
    return boundary(np.stack(rows), percent)


def overlaps(sets: Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``."""
    sides = [sets.take(a), sets.take(b)]
    keys = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(a), len(b)), np.float32)
    spots = []
    for x, owner in sides:
        key = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        hit = keys[key] == x if len(keys) else np.zeros(len(x), bool)
        order = np.argsort(key[hit], kind="stable")
        spots.append((key[hit][order], owner[hit][order]))
    for k in range(0, len(keys), COLUMNS):
        block = []
        for (key, owner), m in zip(spots, out.shape, strict=True):
            lo, hi = np.searchsorted(key, (k, k + COLUMNS))
            x = np.zeros((m, min(COLUMNS, len(keys) - k)), np.float32)
            x[owner[lo:hi], key[lo:hi] - k] = 1
            block.append(x)
        out += block[0] @ block[1].T
    return out


def _verified(sets: Sets, at: np.ndarray, codes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs link. ``codes``: ascending places times elements, of all sets ``at``, as (code of the set, element)."""
    yes, step = np.zeros(len(i), bool), max(1, PAIRS // max(1, int(sets.n[at].max(initial=1))))
    base, width = codes
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        n = sets.n[at[a]]
        own = ragged(np.searchsorted(base, a * width), n)
        pair = np.repeat(np.arange(len(a)), n)
        wanted = base[own] % width + b[pair] * width
        spot = np.minimum(np.searchsorted(base, wanted), len(base) - 1)
        both = np.bincount(pair, base[spot] == wanted, len(a))
        yes[k : k + step] = 100 * both >= percent * (n + sets.n[at[b]] - both)
    return yes


def batched(blocks: Iterable[Links]) -> Iterator[Links]:
    """The same links in blocks of a quarter of PAIRS or more, the last with what is left; none without links."""
    held: list[Links] = []
    for block in blocks:
        if len(block[0]):
            held.append(block)
        if 4 * sum(len(i) for i, _ in held) >= PAIRS:
            yield together(held)
            held = []
    if held:
        yield together(held)


def together(blocks: Iterable[Links]) -> Links:
    i, j = zip((np.zeros(0, np.int64),) * 2, *blocks, strict=True)
    return np.concatenate(i), np.concatenate(j)


def direct(sets: Sets, at: np.ndarray, percent: int) -> Iterator[Links]:
    """Links as places in ``at``, the smaller first.

    Proposed pairs are gathered for so many sets at a time that these have
    about PAIRS pairs with all others.
    """
    m, n = len(at), sets.n[at]
    need = -(-n * percent // 100)
    x, owner = sets.take(at)
    keys, key, times = np.unique(x, return_inverse=True, return_counts=True)
    limit = min(max(32, m // 64), 256)
    often = times[key] > limit
    many = np.bincount(owner[often], minlength=m)
    close = many >= need  # may link by elements of many sets alone
    light = ~often & (times[key] > 1)
    order = np.argsort(key[light], kind="stable")
    k, o = key[light][order], owner[light][order]
    base = owner * len(keys) + key, len(keys)
    open_ = need - many

    def gathered(codes, counts, held):
        c = np.concatenate([codes, *held])
        w = np.concatenate([counts, np.ones(len(c) - len(counts), np.int64)])
        u, place = np.unique(c, return_inverse=True)
        return u, np.bincount(place, w, len(u)).astype(np.int64)

    some = max(BLOCK, 2 * PAIRS // max(m, 1))
    for lo in range(0, m, some):
        codes, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        own = (o >= lo) & (o < lo + some)
        for gap in range(1, limit):
            same = np.flatnonzero((k[gap:] == k[:-gap]) & own[:-gap]) if len(k) > gap else ()
            if not len(same):
                break
            held.append(o[same] * m + o[same + gap])
            size += len(same)
            if size > PAIRS:
                codes, counts = gathered(codes, counts, held)
                held, size = [], 0
        codes, counts = gathered(codes, counts, held)
        i, j = codes // m, codes % m
        maybe = (counts >= np.maximum(open_[i], open_[j])) & ~(close[i] & close[j])
        i, j = i[maybe], j[maybe]
        yes = _verified(sets, at, base, i, j, percent)
        yield i[yes], j[yes]
    spots = np.flatnonzero(close)
    blocks = [spots[b : b + BLOCK] for b in range(0, len(spots), BLOCK)] if len(spots) > 1 else []
    for p, a in enumerate(blocks):
        for b in blocks[p:]:
            both = overlaps(sets, at[a], at[b])
            r, c = np.nonzero(100 * both >= percent * (n[a][:, None] + n[b] - both))
            later = a[r] < b[c]
            yield a[r[later]], b[c[later]]


def links(sets: Sets, at: np.ndarray, percent: int) -> Iterator[Links]:
    """Every link among the sets ``at``, once, as places in ``at``, the smaller first."""
    inside = cells(sets, at, percent) if len(at) > LEAF else None
    if inside is None or 2 * (inside.sum(axis=1) ** 2).sum() > len(at) ** 2:  # no fewer pairs
        yield from direct(sets, at, percent)
        return
    for c, own in enumerate(inside):
        spots = np.flatnonzero(own)
        if len(spots) > 1:
            for i, j in links(sets, at[spots], percent):
                i, j = spots[i], spots[j]
                first = (inside[:, i] & inside[:, j]).argmax(axis=0) == c
                yield i[first], j[first]


def across(sets: Sets, side: np.ndarray, percent: int) -> Iterator[Links]:
    """Links between the sets of side 0 and those of side 1."""
    places = [np.flatnonzero(side == s) for s in (0, 1)]
    rows, columns = ([at[k : k + BLOCK] for k in range(0, len(at), BLOCK)] for at in places)
    for a in rows:
        for b in columns:
            both = overlaps(sets, a, b)
            r, c = np.nonzero(100 * both >= percent * (sets.n[a][:, None] + sets.n[b] - both))
            yield a[r], b[c]


def roots(m: int, i: np.ndarray, j: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The component (smallest place) of each of ``m`` places under the links and those that gave ``before``."""
    root = np.arange(m)
    if before is not None:
        return roots(m, before[i], before[j])[before]
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def unseen(earlier: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share none of their sets' ``earlier`` names."""
    out = np.ones(len(i), bool)
    n = np.asarray([len(e) for e in earlier])
    some = np.flatnonzero((n[i] > 0) & (n[j] > 0))
    if len(some):
        names, key, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(n)), n)
        twice = times[key] > 1
        width = int((times > 1).sum())
        bits = np.zeros((len(n), max(width, 1)), bool)
        bits[owner[twice], (np.cumsum(times > 1) - 1)[key[twice]]] = True
        bits = np.packbits(bits, axis=1)
        step = max(1, PAIRS // bits.shape[1])
        for k in range(0, len(some), step):
            own = some[k : k + step]
            out[own] = ~(bits[i[own]] & bits[j[own]]).any(axis=1)
    return out


def join_region(sets: list[np.ndarray], percent: int = 75) -> np.ndarray:
    """The component (smallest place) of each set of a region; ``sets`` ascending and distinct."""
    own = Sets(sets)
    top = np.arange(len(sets))
    for i, j in batched(links(own, np.arange(len(sets)), percent)):
        top = roots(len(sets), i, j, top)
    return top
