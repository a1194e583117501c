"""Near copies by SimHash fingerprints that meet at anchors of a covering code.

The anchors are pairs of words of the binary Golay code, one for bits 0 to 22
and one for bits 23 to 45 of a fingerprint. Every 23 bits lie within 3 of one
code word, so every fingerprint has a home: the anchor within the covering
radius in both parts. If two fingerprints differ in at most t bits, each lies
within radius plus t of the other's home, and the bits beyond the radius, added
over the two parts, are at most t: to the anchors of which this holds a
fingerprint is replicated, and there it is compared, on all 64 bits, with those
at home. Rows travel by the first code word (71 copies for t = 3, however many
documents there are); the second word's copies are made, and met with the
homes, by the task that has all fingerprints of a first word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import ragged
from ._components import beside, components
from ._shared import appended, cut, remove_folder, ship

#: Bits of a part, its covering radius, the code's generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, its words.
PART, RADIUS, GENERATOR, WORDS = 23, 3, 0b110001110101, 1 << 12
#: Fingerprints at home at one code word, and visits to it, that one task takes; pairs held at once; rows replicated at once.
RESIDENTS, GUESTS, PAIRS, ROWS, SHINGLES = 1 << 20, 1 << 16, 1 << 20, 1 << 14, 1 << 16
_U = np.uint64


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Each bit is 1 if it is set in over half the XXH64 of the text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # ASCII letters, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    n = min(n, len(words))
    begin, end = (ends - lens)[: len(words) - n + 1], ends[n - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, len(begin), SHINGLES):
        some = [digest(joined[x:y], seed) for x, y in zip(begin[a : a + SHINGLES].tolist(), end[a : a + SHINGLES].tolist(), strict=True)]
        ones += np.unpackbits(np.asarray(some, _U).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a long, for every row where it stands. A null text counts as empty."""

    def make(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.fromiter((fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), _U, len(offsets) - 1).view(np.int64)

    return appended(docs, [id_col], text_col, "fp", "bigint", make)


@lru_cache(maxsize=1)
def _remainders() -> list[np.ndarray]:
    """For each byte of a part, what its value leaves when divided by the generator."""
    out = []
    for shift in (0, 8, 16):
        x = np.arange(256, dtype=np.int64) << shift
        for bit in range(PART, 10, -1):
            x ^= ((x >> bit) & 1) * (GENERATOR << (bit - 11))
        out.append(x)
    return out


def syndrome(part: np.ndarray) -> np.ndarray:
    low, middle, high = _remainders()
    return low[part & 255] ^ middle[(part >> 8) & 255] ^ high[part >> 16]


@lru_cache(maxsize=4)
def patterns(limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences of up to RADIUS + ``limit`` bits by syndrome and excess over the radius: their list, and for
    each syndrome (row) and excess (column) where they start and how many there are."""
    every = np.arange(1 << PART, dtype=np.int64)
    weight = np.bitwise_count(every)
    every = every[weight <= RADIUS + limit]
    key = syndrome(every) * (limit + 1) + np.maximum(np.bitwise_count(every).astype(np.int64) - RADIUS, 0)
    order = np.argsort(key, kind="stable")
    count = np.bincount(key, minlength=2048 * (limit + 1))
    return every[order], (np.cumsum(count) - count).reshape(2048, -1), count.reshape(2048, -1)


def _parts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << PART) - 1)
    return (fps & mask).astype(np.int64), ((fps >> _U(PART)) & mask).astype(np.int64)


def home(part: np.ndarray) -> np.ndarray:
    """The one code word within the radius of each part: its upper 12 bits say which it is."""
    difference, start, _ = patterns(0)
    return (part ^ difference[start[syndrome(part), 0]]) >> 11


def visits(part: np.ndarray, budget: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``part``, the code words within RADIUS + budget (of at most ``limit``) of each, and what of the budget is left."""
    difference, start, count = patterns(limit)
    s = syndrome(part)
    own, where, left = [], [], []
    for excess in range(limit + 1):
        n = np.where(budget >= excess, count[s, excess], 0)
        who = np.repeat(np.arange(len(part)), n)
        own.append(who)
        where.append((part[who] ^ difference[ragged(start[s, excess], n)]) >> 11)
        left.append(budget[who] - excess)
    return np.concatenate(own), np.concatenate(where), np.concatenate(left)


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as at most one link for each node: to the smallest node that it is connected with."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _at_home(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(home(_parts(fps.view(_U))[0]).astype(np.int32)), pa.array(np.zeros(len(fps), np.int32)), batch.column(0)], ["anchor", "budget", "fp"])


def _visiting(limit: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fps), ROWS):
                some = fps[a : a + ROWS]
                who, where, left = visits(_parts(some.view(_U))[0], np.full(len(some), limit), limit)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(some[who])], ["anchor", "budget", "fp"])

    return run


def _visited(limit: int):
    def run(batches):
        n = np.zeros(WORDS, np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fps), ROWS):
                some = _parts(fps[a : a + ROWS].view(_U))[0]
                n += np.bincount(visits(some, np.full(len(some), limit), limit)[1], minlength=WORDS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["anchor", "n"])

    return run


def _compared(limit: int):
    """Rows (key, resident, budget, fp) sorted by key, a partition at a time, to links. What a batch leaves open waits for the next."""

    def met(key, resident, budget, fp):
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        second = _parts(fp)[1]
        here = np.flatnonzero(resident)
        place = group[here] * WORDS + home(second[here])
        order = np.argsort(place, kind="stable")
        here, place = here[order], place[order]
        guests = np.flatnonzero(~resident)
        for a in range(0, len(guests), ROWS):
            some = guests[a : a + ROWS]
            who, where, _ = visits(second[some], budget[some], limit)
            who = some[who]
            at = group[who] * WORDS + where
            first = np.searchsorted(place, at)
            times = np.searchsorted(place, at, "right") - first
            found = np.flatnonzero(times)
            who, first, times = who[found], first[found], times[found]
            ends, b = np.cumsum(times), 0
            while b < len(who):
                z = max(b + 1, int(np.searchsorted(ends, (ends[b - 1] if b else 0) + PAIRS, "right")))
                x = np.repeat(fp[who[b:z]], times[b:z])
                y = fp[here[ragged(first[b:z], times[b:z])]]
                close = (np.bitwise_count(x ^ y) <= limit) & (x != y)
                if close.any():
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in joined(x[close].view(np.int64), y[close].view(np.int64))], ["a", "b"])
                b = z

    def run(batches):
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            columns[3] = columns[3].view(_U)
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            held = [c[last:] for c in columns]
            if last:
                yield from met(*(c[:last] for c in columns))
        if held is not None and len(held[0]):
            yield from met(*held)

    return run


def links(distinct: DataFrame, limit: int = 3) -> tuple[DataFrame, str]:
    """``a, b``: links that connect exactly the fingerprints that chains of at most ``limit`` differing bits connect.

    ``distinct`` has distinct ``fp``, read from files. Who is at home at a first
    word, and who visits it, is counted first: where these are more than
    RESIDENTS or GUESTS they are dealt as tiles of both (guests in tiles not
    smaller than the number of residents, so that residents are not copied more
    often than there are guests). Also the folder that the links are read from.
    """
    at_home = lambda: distinct.select("fp").mapInArrow(_at_home, "anchor int, budget int, fp bigint")
    h = at_home().groupBy("anchor").agg(F.count(F.lit(1)).alias("h"))
    v = distinct.select("fp").mapInArrow(_visited(limit), "anchor int, n bigint").groupBy("anchor").agg(F.sum("n").alias("v"))
    tiles = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes, uri_1 = cut(h.join(v, "anchor").select("anchor", tiles("h", RESIDENTS).alias("th"), F.least(tiles("v", GUESTS), F.ceil(F.col("v") / F.col("h")).cast("int")).alias("tv")), "sizes")
    sizes = F.broadcast(sizes)  # a row for each code word at most: 4096

    def dealt(rows: DataFrame, own: str, other: str, resident: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("fp"), F.col(own)).cast("int")
        rows = rows.join(sizes, "anchor").select("anchor", "budget", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
        tile = (F.col("mine"), F.col("theirs")) if resident else (F.col("theirs"), F.col("mine"))
        key = (tile[0].cast("bigint") * (1 << 24) + tile[1]) * WORDS + F.col("anchor")
        return rows.select(key.alias("key"), F.lit(resident).alias("resident"), "budget", "fp")

    guests = distinct.select("fp").mapInArrow(_visiting(limit), "anchor int, budget int, fp bigint")
    both = dealt(at_home(), "th", "tv", True).unionByName(dealt(guests, "tv", "th", False))
    met = both.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(limit), "a bigint, b bigint")
    found, uri_2 = cut(met, "links")
    remove_folder(distinct.sparkSession, uri_1)
    return found, uri_2


def _named(distinct: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """``fp, component_id`` from fingerprints with their smallest ids, and ``node, root``. Also the folders written."""
    nodes, uri_1 = cut(nodes.withColumnRenamed("node", "fp"), "nodes")
    rooted, uri_2 = cut(beside(distinct, nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least, uri_3 = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labels, uri_4 = cut(beside(rooted, least, "root").select("fp", "component_id"), "labels")
    return labels, [uri_1, uri_2, uri_3, uri_4]


def dedup(docs: DataFrame, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Words are maximal runs of characters other than 0x20 and 0x09-0x0D, with
    A-Z lower-cased; a shingle is three words joined by a space, fewer words are
    one shingle. ``fingerprint`` is in 16 hexadecimal digits. Rows whose
    fingerprints differ in up to ``limit`` (0 to 4) bits are linked;
    ``component_id`` is the smallest id that links reach, the own included.
    Null and empty texts have fingerprint zero and are linked like others. A
    null id is no component's name, unless nobody else is in it. Repeated rows
    stay; other columns take no part; an empty table gives no rows.
    """
    if not 0 <= limit <= 4:
        raise ValueError("limit: 0 to 4 bits")
    spark = docs.sparkSession
    ship(spark)
    prints, uri_1 = cut(fingerprints(docs, id_col, text_col), "prints")
    distinct, uri_2 = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    found, uri_3 = links(distinct, limit)
    labels, uris = _named(distinct, components(found))
    out = beside(prints, labels, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    out, _ = cut(out, "components")
    for uri in (uri_1, uri_2, uri_3, *uris):
        remove_folder(spark, uri)
    return out
