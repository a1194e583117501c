"""Exact similarity join of documents on word shingles, as a join in the Jaccard metric space.

1 - Jaccard is a metric, and two documents link when it is at most RADIUS.

Regions: of each set the ``prefix`` holds its smallest hashes, so many that two
linked sets share at least min(k, k') of them. Each prefix hash that several
sets share elects one of them, and its sets join that pivot's region; two
linked sets share a hash and so meet in a region. Sets that share fewer prefix
hashes than any link needs are in no link and leave before. Regions have one
order for all sets, by how many hashes a member has in them on average, and a set
leaves the first of them as long as it shares less than a link needs in them
together: of the hashes that two linked sets share, the last lies in a region
that neither has left. So a passage that many documents hold brings few together.

Voronoi cells: a region of more than ``LEAF`` sets is cut about eight pivots;
each set goes to its nearest pivot's cell and, as a boundary document, to every
other whose distance is within 2 * RADIUS of the nearest's: by the triangle
inequality each link keeps a common cell. Cells are cut again, recursively.
Regions of up to ``REGION_MOST`` sets are cut inside the task that joins them
(``_regions``), larger ones before they are dealt to tasks; what doesn't shrink,
such as a large group of near copies, is dealt as pairs of tiles over many tasks.

Every link is verified on whole sets and counted once: a pair that meets in
several regions counts in the least of them, so no pairs are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._components import SMALL, beside, components
from ._regions import PIVOTS, Sets, across, batched, boundary, roots, unseen
from ._regions import links as links_of
from ._shared import appended, cut, fresh, remove_folder, ship, text_bytes
from ._words import combine, document_of, groups, mix, word_hashes

WORDS, PERCENT = 5, 75
#: Most sets and shingles of a region that one task joins, how often regions are cut; tiles of what doesn't shrink, and most sets of a tile, beyond which there are more.
REGION_MOST, SHINGLES, LEVELS, TILES, TILE_SETS = 192, 1 << 22, 3, 24, 8192
#: Least prefix hashes that a link shares (of sets that have as many); postings of a bucket; most bytes of pivots that are broadcast.
SPARE, BUCKET, PIVOT_BYTES = 3, 1 << 18, 8 << 20
WHOLE, SLICE = 2, 8 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a range of documents, ascending in each, and the n + 1 places where they start."""
    h, counts = word_hashes(data, offsets)
    n, doc = len(counts), document_of(counts)
    starts = np.cumsum(counts) - counts
    hashes, docs = [], []
    if len(h) >= words:
        whole = doc[: len(h) - words + 1] == doc[words - 1 :]
        hashes.append(combine(*[h[i : len(h) - words + 1 + i][whole] for i in range(words)], salt=words))
        docs.append(doc[: len(h) - words + 1][whole])
    for k in range(1, words):
        short = np.flatnonzero(counts == k)
        if len(short):
            hashes.append(combine(*[h[starts[short] + i] for i in range(k)], salt=k))
            docs.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    s, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[first], d[first]
    return s, np.searchsorted(d, np.arange(n + 1))


def signatures(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, which equal sets share; 0 for the empty one."""
    sizes = np.diff(ends)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0x2545F4914F6CDD1D)))])
        sums = total[ends[1:]] - total[ends[:-1]]
        return np.where(sizes > 0, mix(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)).view(np.int64)


def least_partner(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest set that one of n can link with, and the least they share: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """k: how many prefix hashes two linked sets share at least, by the smaller k of the two."""
    return np.minimum(least_partner(n, percent), np.maximum(SPARE, n // 8))


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """With an overlap of at least ceil(percent / 100 * n), the j-th smallest common hash of two linked
    sets is among the first n - overlap + j of each; j = k gives the prefix."""
    return np.minimum(n, n - least_partner(n, percent) + spare(n, percent))


def _sets_of(batch: pa.RecordBatch, column: int, words: int):
    data, offsets = text_bytes(batch.column(column))
    for a, b in groups(offsets):
        yield a, b, *shingle_sets(data, offsets[a : b + 1], words)


def _postings(texts: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """Blocks of (hash, set name) of the prefixes, dealt by hash."""

    def run(batches):
        for batch in batches:
            keys, names, size = [], [], 0

            def blocks(keys, names):
                key, name = np.concatenate(keys), np.concatenate(names)
                bucket = (mix(key) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                key, name, bucket = key[order], name[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edges))
                return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary()) for x in (key, name))], ["bucket", "keys", "names"])

            for _, _, sets, ends in _sets_of(batch, 0, words):
                name, n = signatures(sets, ends), np.diff(ends)
                _, once = np.unique(name, return_index=True)  # copies within the batch
                once = once[n[once] > 0]
                take = prefix_sizes(n[once], percent)
                spots = np.repeat(ends[:-1][once] - (np.cumsum(take) - take), take) + np.arange(take.sum())
                keys.append(sets[spots])
                names.append(np.repeat(name[once], take))
                size += len(spots)
                if size >= SLICE // 16:
                    yield blocks(keys, names)
                    keys, names, size = [], [], 0
            if size:
                yield blocks(keys, names)

    return texts.mapInArrow(run, "bucket int, keys binary, names binary")


def _elect(table: pa.Table) -> pa.Table:
    """From the postings of one bucket: how many of its hashes each set shares with others, by the pivot they elect."""
    key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
    name = np.frombuffer(b"".join(table.column("names").to_pylist()), np.int64)
    order = np.lexsort((mix(name.view(np.uint64)), key))  # the pivot of a hash is the set with the smallest mixed name
    key, name = key[order], name[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name = key[new], name[new]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.append(head, len(key)))
    pivot = np.repeat(name[head], runs)
    shared = np.repeat(runs > 1, runs)
    name, pivot = name[shared], pivot[shared]
    order = np.lexsort((pivot, name))
    name, pivot = name[order], pivot[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (pivot[1:] != pivot[:-1])
    first = np.flatnonzero(new)
    return pa.table({"node": name[first], "region": pivot[first], "hits": np.diff(np.append(first, len(name))).astype(np.int64)})


def _rows(sets: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in sets]


def _join_regions(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b, null) of a spanning forest of each region's links, and rows (a, null, links) with what the
    region adds to a set's links. A pair that meets in several of the regions ``bases`` counts in the least.
    Regions come one after the other in sorted partitions."""

    def run(batches):
        region, rows, done = None, [], []

        def close():
            if len(rows) < 2:
                return
            base, side, names, sets, copies, bases = zip(*rows, strict=True)
            own, side, copies = Sets(_rows(sets)), np.asarray(side), np.asarray(copies)
            earlier = [np.asarray([x for x in b if x < base[0]], np.int64) for b in bases]
            top, more = np.arange(len(rows)), np.zeros(len(rows))
            for i, j in batched(links_of(own, np.arange(len(rows)), percent) if side[0] == WHOLE else across(own, side, percent)):
                top = roots(len(rows), i, j, top)
                fresh = unseen(earlier, i, j)
                i, j = i[fresh], j[fresh]
                more += np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
            done.extend((names[k], names[int(top[k])], 0) for k in np.flatnonzero(top != np.arange(len(rows))).tolist())
            done.extend((names[k], None, int(more[k])) for k in np.flatnonzero(more).tolist())

        def out():
            a, b, n = zip(*done, strict=True) if done else ((), (), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "links"])

        for batch in batches:
            for r, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != region:
                    close()
                    region, rows = r, []
                elif row[2] == rows[-1][2]:
                    continue
                rows.append(row)
            if done:
                yield out()
        close()
        yield out()

    dealt = members.select("region", "base", "side", "node", "own", "copies", "bases").repartition("region").sortWithinPartitions("region", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, links bigint")


def _split(members: DataFrame, percent: int, level: int, scratch: list[str]) -> DataFrame:
    """One Voronoi step on regions that one task should not join: each set with the names of the cells it belongs to."""
    picks = [F.min_by("own", F.xxhash64("node", F.lit(level * 100 + i))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots, uri = cut(members.groupBy("region").agg(*picks), "pivots")
    scratch.append(uri)
    size = pivots.agg(F.sum(sum(F.length(f"p{i}") for i in range(PIVOTS)))).first()[0] or 0
    shared, columns = None, ["region", "node", "own"]
    if size <= PIVOT_BYTES:
        shared = members.sparkSession.sparkContext.broadcast({r[0]: [bytes(x) for x in r[1:]] for r in pivots.collect()})
    else:
        members = members.join(pivots.hint("merge"), "region")
        columns += [f"p{i}" for i in range(PIVOTS)]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = batch.slice(a, 256)
                region, node, sets, *picked = (c.to_pylist() for c in own.columns)
                held, d = Sets(_rows(sets)), np.empty((PIVOTS, len(sets)))
                for r in set(region):  # all rows of a region have the same pivots
                    at = np.asarray([k for k, x in enumerate(region) if x == r])
                    for p, pivot in enumerate(shared.value[r] if shared else [x[at[0]] for x in picked]):
                        d[p, at] = held.distances(np.frombuffer(pivot, np.uint64), at)
                at, cell = np.nonzero(boundary(d, percent).T)
                names = np.asarray(region, np.int64)[at].view(np.uint64)
                cells = combine(names, cell.astype(np.uint64), salt=level + 1).view(np.int64)
                ends = np.searchsorted(at, np.arange(len(sets) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(cells))], ["region", "node", "own", "cells"])

    return members.select(*columns).mapInArrow(run, "region bigint, node bigint, own binary, cells array<bigint>")


def _cells(members: DataFrame, meet: DataFrame, percent: int, most: int, scratch: list[str]) -> DataFrame:
    """``base, node, own, tiles``: regions cut into Voronoi cells until none has more than ``most`` sets or
    SHINGLES shingles. Where cells together have over half of their region's pairs, the region stays whole and
    gets a number of tiles; the others have 1."""

    def kept(df: DataFrame, kind: str) -> DataFrame:
        out, uri = cut(df, kind)
        scratch.append(uri)
        return out

    def placed(df: DataFrame, tiles: Column = F.lit(1)) -> DataFrame:
        return df.select(F.col("region").alias("base"), "node", "own", tiles.alias("tiles"))

    large = (F.col("k") > most) | (F.col("shingles") > SHINGLES)
    measures = F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")
    tiles = F.greatest(F.least(F.ceil(F.col("k") / most), F.lit(TILES)), F.ceil(F.col("k") / TILE_SETS), F.ceil(2 * F.col("shingles") / SHINGLES)).cast("int")
    sizes = kept(meet.groupBy("region").agg(*measures).where(large), "sizes")
    if not sizes.count():
        return placed(members)
    members = kept(members.select("region", "node", "own"), "members")
    done = [placed(beside(members, sizes.select("region"), "region", "left_anti"))]
    open_ = beside(members, sizes.select("region"), "region", "left_semi")
    for level in range(LEVELS):
        found = kept(_split(open_, percent, level, scratch), "regions")
        grown = found.select("region", F.explode("cells").alias("cell"), (F.length("own") / 8).cast("bigint").alias("n")).groupBy("region", "cell").agg(*measures)
        pairs = grown.groupBy("region").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
        stuck = kept(sizes.join(pairs, "region").where("2 * pairs > k * k").select("region", tiles.alias("tiles")), "stuck")
        done.append(placed(beside(found, stuck, "region"), F.col("tiles")))
        moved = beside(found, stuck.select("region"), "region", "left_anti").select(F.explode("cells").alias("region"), "node", "own")
        grown = beside(grown, stuck.select("region"), "region", "left_anti")
        sizes = kept(grown.where(large).select(F.col("cell").alias("region"), "k", "shingles"), "sizes")
        done.append(placed(beside(moved, sizes.select("region"), "region", "left_anti")))
        if not sizes.count():
            break
        open_ = beside(moved, sizes.select("region"), "region", "left_semi")
    else:
        done.append(placed(beside(open_, sizes.select("region", tiles.alias("tiles")), "region"), F.col("tiles")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _dealt(cells: DataFrame) -> DataFrame:
    """With ``region`` and ``side``: a cell of one tile is a region; of more, every two tiles and each tile are one."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(
        F.xxhash64("base", F.least(own, j), F.greatest(own, j)).alias("region"), F.when(own == j, WHOLE).when(own < j, 0).otherwise(1).alias("side")))
    single = F.array(F.struct(F.col("base").alias("region"), F.lit(WHOLE).alias("side")))
    return cells.select("base", "node", "own", "copies", "bases", F.explode(F.when(F.col("tiles") == 1, single).otherwise(every)).alias("at")).select("*", "at.region", "at.side").drop("at")


def _joined(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, region_most: int) -> DataFrame:
    """``doc_id, node, n_shingles, component_id, n_links, root`` of every row: its set's name, and its component's."""
    spark = docs.sparkSession
    ship(spark)
    scratch: list[str] = []

    def kept(df: DataFrame, kind: str) -> DataFrame:
        out, uri = cut(df, kind)
        scratch.append(uri)
        return out

    def describe(batches):
        for batch in batches:
            for a, b, sets, ends in _sets_of(batch, 1, words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends)), pa.array(signatures(sets, ends))], ["doc_id", "n_shingles", "node"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = kept(texts.mapInArrow(describe, "doc_id bigint, n_shingles bigint, node bigint"), "sets")
    nodes = kept(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")), "nodes")

    partner = F.ceil(F.col("n") * percent / 100)  # least_partner, spare, prefix_sizes as columns
    spared = lambda n: F.least(F.ceil(n * percent / 100), F.greatest(F.lit(SPARE), F.floor(n / 8)))
    posted = nodes.agg(F.sum(F.least(F.col("n"), F.col("n") - partner + spared(F.col("n"))))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-posted // BUCKET))
    chosen = _postings(texts.select("text"), buckets, words, percent).groupBy("bucket").applyInArrow(_elect, "node bigint, region bigint, hits bigint")
    hits = kept(chosen.groupBy("node", "region").agg(F.sum("hits").alias("hits")), "hits")
    total = hits.groupBy("node").agg(F.sum("hits").alias("total"))
    able = kept(nodes.join(total, "node").withColumn("least", spared(partner)).where("total >= least").select("node", "doc_id", "n", "least"), "able")
    weight = kept(hits.groupBy("region").agg((F.sum("hits") / F.count(F.lit(1))).alias("weight")), "weights")
    upto = Window.partitionBy("node").orderBy("weight", "region").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    meet = beside(beside(hits, weight, "region"), able.select("node", "n", "least"), "node").withColumn("upto", F.sum("hits").over(upto))
    meet = kept(meet.where("upto >= least").select("node", "region", "n"), "meet")
    alone = kept(meet.groupBy("region").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("region"), "alone")
    meet = kept(beside(meet, alone, "region", "left_semi").select("node", "region", "n"), "meet")

    def sets_of(batches):
        for batch in batches:
            for _, _, sets, ends in _sets_of(batch, 0, words):
                name, once = np.unique(signatures(sets, ends), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([sets[ends[i] : ends[i + 1]].tobytes() for i in once], pa.binary())], ["node", "own"])

    wanted = able.where("doc_id is not null").select("doc_id").distinct()
    some = beside(texts, wanted, "doc_id", "left_semi").select("text").unionByName(texts.where("doc_id is null").select("text"))
    members = beside(some.mapInArrow(sets_of, "node bigint, own binary"), meet, "node").select("region", "node", "own")
    found = kept(_cells(members, meet, percent, region_most, scratch), "cells")
    places = found.groupBy("node").agg(F.collect_set("base").alias("bases"))
    places = kept(places.join(nodes.select("node", "copies"), "node"), "places")
    linked = kept(_join_regions(_dealt(beside(found, places, "node")), percent), "links")
    counted = kept(linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "counted")
    tops = kept(components(linked.where("b is not null").select("a", "b")), "found")
    named = kept(tops.join(nodes.select("node", "doc_id"), "node"), "named")
    first = kept(named.groupBy("root").agg(F.min("doc_id").alias("linked_id")), "first")
    own = nodes.select("node", F.col("doc_id").alias("first_id"), "copies").join(beside(named.select("node", "root"), first, "root"), "node", "left").join(counted, "node", "left")
    own = own.select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("linked_id")).alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    some = F.col("n_shingles") > 0
    out = beside(rows, kept(own, "own"), "node", "left").select("doc_id", "node", "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"), "root")
    out, _ = cut(out, "joined")
    for uri in scratch:
        remove_folder(spark, uri)
    return out


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", region_most: int = REGION_MOST, links: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``, and with ``links`` its ``n_links``.

    A text is lower-cased (A-Z) and cut into words; its set holds the distinct
    runs of ``words`` words, or the whole text's words as one if there are
    fewer. Two documents link when their intersection is at least ``percent``
    per cent of their union, and component_id is the smallest id reachable by
    links, the own one included; n_links is the number of other rows that the row
    links with, exact copies among them. Texts without words, and null, have an empty
    set and link with nothing, not even each other. Rows with a null id link
    like others and lend no id: their component may be null. Repeated rows come
    out as often; an empty table gives no rows. Hashes have 64 bits: two sets
    or shingles that differ are taken for equal with a chance of 2^-64 a pair.
    ``region_most``: sets of a region that one task joins without a further cut.
    """
    out = _joined(docs, words, percent, id_col, text_col, region_most)
    return out.select("doc_id", "n_shingles", "component_id", *["n_links"] * links)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", region_most: int = REGION_MOST) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays.

    That is a row with the component's smallest id, a null id counting as larger
    than any; where an id stands on rows of different texts, the text decides,
    so each row is kept or dropped by its own set and none is lost with a
    namesake. Rows with equal id and equal set are one document, of which the row
    whose columns come first as JSON stays. Texts without words are near nothing,
    and all such rows stay. An empty table gives no rows.
    """
    found = _joined(docs, words, percent, id_col, text_col, region_most).where("n_shingles > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    node, none, first = fresh(docs, "stay_node", "stay_none", "stay_first")
    stay, _ = cut(found.groupBy("root").agg(least.alias("x")).select(F.col("x.node").alias(node), F.col("x.none").alias(none), F.col("x.doc_id").alias(first)), "stay")
    keys = found.groupBy("doc_id", "node").count().where("count > 1")
    twice, _ = cut(stay.join(keys, (F.col(node) == keys["node"]) & F.col(first).eqNullSafe(keys["doc_id"]), "left_semi"), "twice")

    def name(data, offsets):
        parts = [signatures(*shingle_sets(data, offsets[a : b + 1], words)) for a, b in groups(offsets)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    own = fresh(docs, "stay_set")[0]
    named = appended(docs, docs.columns, text_col, own, "bigint", name)
    key = F.col(f"`{id_col}`").cast("bigint")
    on = (F.col(own) == F.col(node)) & (F.col(none) == key.isNull()) & key.eqNullSafe(F.col(first))
    side = lambda df: F.broadcast(df) if df.count() <= SMALL else df.hint("merge")
    out = named.join(side(stay), on, "left").where((F.col(own) == 0) | F.col(node).isNotNull()).drop(node, none, first)
    if twice.limit(1).count():
        row = F.struct(*[F.col(f"`{c}`") for c in out.columns])
        more = out.join(side(twice), on, "left_semi").select(F.col(own), F.col(f"`{id_col}`").alias(first), row.alias(none))
        more = more.groupBy(own, first).agg(F.min_by(none, F.to_json(none)).alias(none)).select(f"{none}.*")
        out = out.join(side(twice), on, "left_anti").unionByName(more)
    return out.drop(own)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id
"""
