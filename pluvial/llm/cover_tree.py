"""Hard negatives by cover trees over norm-augmented candidates.

A block of candidates gets one component more, so that all have the norm M of
its longest: inner products with a query q (0 in that component) are then
|q| M cos(angle). The block's tree covers every node's members by its children
within half the node's covering angle, level by level; a node keeps the angle
that its members really need. A query at angle t from a node's centre has
products between |q| M cos(t + radius) and |q| M cos(t - radius) with all
members. Descent is best-first: in each round every query opens its nodes of
highest bound; nodes outside of a query's window, or below the k-th score found
in it, are skipped with all they hold. A member is multiplied exactly, in whole
numbers, where it is the centre of an opened node's child.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vectors as V
from ._chunks import ragged
from ._shared import cut, remove_folder, ship
from .uniform_topk import LOWEST, partial_scores

#: Vectors of a tree; anchors of a block; nodes that a query opens in a round; products held at once.
MEMBERS, ANCHORS, WAVE, PRODUCTS = 2048, 256, 8, 1 << 20
HIGHEST, SLACK = (1 << 62) - 1, 1e-6
NODE = np.dtype([("center", "<i4"), ("first", "<i4"), ("children", "<i4"), ("level", "<i4"), ("angle", "<f8"), ("least", "<i8"), ("most", "<i8"), ("labels", "<u8")])


def build(z: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """NODE rows, the children of a node side by side, the root first; and M."""
    x = z.astype(np.float64)
    squares = (x * x).sum(axis=1)
    m = float(np.sqrt(squares.max()))
    unit = np.concatenate([x, np.sqrt(np.maximum(m * m - squares, 0))[:, None]], axis=1) / (m or 1.0)
    near = np.clip(unit @ unit.T, -1, 1)
    bit = np.uint64(1) << (labels % 64).astype(np.uint64)
    nodes: list[tuple] = [()]
    queue = [(0, int(squares.argmax()), np.delete(np.arange(len(z)), int(squares.argmax())), 0)]
    for at, center, members, level in queue:  # grows meanwhile
        own = np.append(members, center)
        angle = float(np.arccos(near[center, members].min())) if len(members) else 0.0
        parts: list[tuple[int, np.ndarray]] = []
        if angle <= SLACK:  # copies, or nearly
            parts = [(int(i), members[:0]) for i in members]
        else:
            left, limit = members, np.cos(angle / 2)
            close = near[center, left] >= limit
            if close.any():
                parts.append((center, left[close]))
            left = left[~close]
            while len(left):
                close = near[left[0], left] >= limit
                close[0] = False
                parts.append((int(left[0]), left[close]))
                close[0] = True
                left = left[~close]
        nodes[at] = (center, len(nodes), len(parts), level, angle + SLACK, labels[own].min(), labels[own].max(), np.bitwise_or.reduce(bit[own]))
        for c, some in parts:
            queue.append((len(nodes), c, some, level + 1))
            nodes.append(())
    return np.array(nodes, NODE), m


class Search:
    """Queries against one tree after the other; ``multiplied`` counts the products made."""

    def __init__(self, k: int, same: bool):
        self.k, self.same, self.multiplied = k, same, 0

    def _bounds(self, nodes: np.ndarray, m: float, norm: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = norm * m
        t = np.arccos(np.clip(np.divide(score, scale, out=np.zeros(len(score)), where=scale > 0), -1, 1))
        slack = SLACK * scale + SLACK
        return scale * np.cos(np.minimum(t + nodes["angle"], np.pi)) - slack, scale * np.cos(np.maximum(t - nodes["angle"], 0)) + slack

    def _holds(self, nodes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether a node may hold candidates for a query of that label."""
        if self.same:
            return (nodes["least"] <= label) & (label <= nodes["most"]) & ((nodes["labels"] >> (label % 64).astype(np.uint64)) & np.uint64(1) > 0)
        return (nodes["least"] != label) | (nodes["most"] != label)

    def meet(self, best: V.Best, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, z: np.ndarray, ids: np.ndarray, labels: np.ndarray, nodes: np.ndarray, m: float) -> None:
        """Adds to ``best`` what of the tree reaches each query's window [low, high] and its k best."""
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        again = np.zeros(len(nodes), bool)  # children with the centre of their parent, which was offered before
        inner = np.flatnonzero(nodes["children"])
        again[nodes["first"][inner]] = nodes["center"][nodes["first"][inner]] == nodes["center"][inner]

        def needed():
            return np.maximum(low, best.floor(LOWEST))

        def offer(who, centers, scores):
            need = needed()
            fits = (scores >= need[who]) & (scores <= high[who]) & (ids[centers] != q_ids[who]) & ((labels[centers] == q_labels[who]) == self.same)
            if fits.any():
                best.add(who[fits], ids[centers[fits]], scores[fits])

        def keep(who, node, score):
            """The nodes that may matter, and their upper bounds."""
            some = nodes[node]
            lower, upper = self._bounds(some, m, norm[who], score)
            fits = (some["children"] > 0) & (upper >= needed()[who]) & (lower <= high[who]) & self._holds(some, q_labels[who])
            return who[fits], node[fits], score[fits], upper[fits]

        def products(who, node):
            """(query, child, score) for the children of opened nodes."""
            order = np.argsort(node, kind="stable")
            who, node = who[order], node[order]
            edges = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
            small = np.ones(len(node), bool)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                row = nodes[node[a]]
                if (b - a) * row["children"] >= 512:
                    small[a:b] = False
                    child = np.arange(row["first"], row["first"] + row["children"])
                    step = max(1, PRODUCTS // len(child))
                    for c in range(a, b, step):
                        some = who[c : min(b, c + step)]
                        scores = partial_scores(q[some], z[nodes["center"][child]])
                        yield np.repeat(some, len(child)), np.tile(child, len(some)), scores.ravel()
            who, node = who[small], node[small]
            ends, a = np.cumsum(nodes["children"][node]), 0
            while a < len(who):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PRODUCTS // q.shape[1], "right")))
                n = nodes["children"][node[a:b]]
                child, some = ragged(nodes["first"][node[a:b]], n), np.repeat(who[a:b], n)
                yield some, child, (q[some] * z[nodes["center"][child]]).sum(axis=1)
                a = b

        who = np.arange(len(q))
        root = np.full(len(q), nodes["center"][0])
        score = partial_scores(q, z[root[:1]]).ravel()
        self.multiplied += len(q)
        offer(who, root, score)
        who, node, score, upper = keep(who, np.zeros(len(q), np.int64), score)
        while len(who):
            order = np.lexsort((-upper, who))
            who, node, score, upper = who[order], node[order], score[order], upper[order]
            opened = np.arange(len(who)) - np.searchsorted(who, who) < WAVE
            parts = [(who[~opened], node[~opened], score[~opened])]
            for some, child, scores in products(who[opened], node[opened]):
                self.multiplied += len(some)
                new = ~again[child]
                offer(some[new], nodes["center"][child[new]], scores[new])
                deeper = nodes["children"][child] > 0
                parts.append((some[deeper], child[deeper], scores[deeper]))
            who, node, score, upper = keep(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _blocks(rows: DataFrame, most: int, trees: bool) -> DataFrame:
    """Rows (dim, ids, labels, raw, and with ``trees`` nodes and top) of up to ``most`` vectors of one length each; they stay where they were read."""
    names = ["dim", "ids", "labels", "raw", *(["nodes", "top"] if trees else [])]

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids, labels, vectors = zip(*held.pop(dim), strict=True)
            labels, z = np.asarray(labels, np.int64), np.stack(vectors).astype(np.int64)
            made = [np.asarray(ids, np.int64).tobytes(), labels.tobytes(), z.tobytes()]
            if trees:
                nodes, m = build(z, labels)
                made += [nodes.tobytes(), np.float64(m).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], names)

        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat, ends = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(2).offsets) - batch.column(2).offsets[0].as_py()
            for i, (vec_id, label) in enumerate(zip(ids, labels, strict=True)):
                v = flat[ends[i] : ends[i + 1]]
                own = held.setdefault(len(v), [])
                own.append((vec_id, label, v))
                if len(own) == most:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, " + ", ".join(f"{n} binary" for n in names[1:]))


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


def _tree(row: dict):
    return _ints(row["raw"]).reshape(-1, row["dim"]), _ints(row["ids"]), _ints(row["labels"]), np.frombuffer(row["nodes"], NODE), float(np.frombuffer(row["top"])[0])


def _positives(k: int):
    search = Search(k, same=True)

    def meet(best: V.Best, row: dict) -> None:
        q_ids = _ints(row["q_ids"])
        every = np.full(len(q_ids), LOWEST), np.full(len(q_ids), HIGHEST)
        search.meet(best, _ints(row["q_raw"]).reshape(-1, row["dim"]), q_ids, _ints(row["q_labels"]), *every, *_tree(row))

    return meet


def _negatives(k: int, low: int, high: int):
    search = Search(k, same=False)

    def meet(best: V.Best, row: dict) -> None:
        own, score = _ints(row["q_anchor"]), _ints(row["q_score"])
        window = -(-low * score // 100), high * score // 100
        search.meet(best, _ints(row["q_raw"]).reshape(-1, row["dim"])[own], _ints(row["q_ids"]), _ints(row["q_labels"])[own], *window, *_tree(row))

    return meet


def _merge(n: int, k: int, table: pa.Table) -> V.Best:
    top = V.Best(n, k, np.int64)
    for q, i, s in zip(*(table.column(c).to_pylist() for c in ("query", "ids", "scores")), strict=True):
        top.add(_ints(q), _ints(i), _ints(s))
    return top


def mine(vectors: DataFrame, is_anchor, label: Column | str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x), x as double; scores are inner products
    of those with the anchor, a row with ``is_anchor(id)``; higher ones come
    first, ties by the smaller id. An anchor's positives are its first
    ``positives`` other rows of the same label. For each of them come the first
    ``negatives`` rows of another label with low * positive_score <= 100 *
    negative_score <= high * positive_score; none, if none fit (so for positive
    scores below 0). Fewer rows where there are fewer. Rows with a null id,
    label or vector, an empty vector, or null or non-finite components take no
    part; vectors of another length than the anchor's are no candidates. A row
    is its anchor's own if the ids agree; repeated ids count as several rows,
    and repeated anchors give repeated results. Labels are whole numbers.
    Scaled components and their sums have to fit in 62 bits.
    """
    spark = vectors.sparkSession
    ship(spark)
    label = F.col(label) if isinstance(label, str) else label
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine).select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.transform(v, lambda x: F.floor(scale * x).cast("double")).alias("v"))
    candidates, uri_1 = cut(_blocks(rows, MEMBERS, True), "trees")
    queries, uri_2 = cut(_blocks(rows.where(is_anchor(F.col("vec_id"))), ANCHORS, False).withColumn("block", F.xxhash64("ids")), "anchors")
    trees = ["ids", "labels", "raw", "nodes", "top"]
    found = V.scan(V.paired(candidates, queries), ["q_ids", "q_labels", "q_raw", *trees], positives, np.int64, _positives(positives))
    few = queries.count() <= 1000

    def chosen(table: pa.Table) -> pa.Table:
        top = _merge(table.column("bytes")[0].as_py() // 8, positives, table)
        return pa.table({"block": [table.column("block")[0].as_py()], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in (("anchor", top.query), ("positive", top.ids), ("score", top.scores))}})

    sizes = queries.select("block", F.length("ids").alias("bytes"))
    best = found.join(F.broadcast(sizes) if few else sizes, "block").groupBy("block").applyInArrow(chosen, "block bigint, anchor binary, positive binary, score binary")
    ready = queries.join(best, "block").where(F.length("anchor") > 0)

    def pairs(batches):
        """``ids`` become those of the pairs' anchors."""
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                row["ids"] = _ints(row["ids"])[_ints(row["anchor"])].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], batch.schema.field(n).type) for n in names], names)

    columns = ["dim", "ids", "labels", "raw", "block", "anchor", "positive", "score"]
    kinds = ", ".join(f"{c} {'int' if c == 'dim' else 'bigint' if c == 'block' else 'binary'}" for c in columns)
    ready, uri_3 = cut(ready.select(*columns).mapInArrow(pairs, kinds), "positives")
    found = V.scan(V.paired(candidates, ready), ["q_ids", "q_anchor", "q_score", "q_labels", "q_raw", *trees], negatives, np.int64, _negatives(negatives, low, high))

    def mined(table: pa.Table) -> pa.Table:
        anchors, positive, score = (_ints(table.column(c)[0].as_py()) for c in ("pair_ids", "positive", "score"))
        top = _merge(len(anchors), negatives, table)
        rank = np.arange(len(top.query)) - np.searchsorted(top.query, top.query) + 1
        return pa.table({"anchor_id": anchors[top.query], "positive_id": positive[top.query], "rank": rank.astype(np.int32), "negative_id": top.ids, "positive_score": score[top.query], "negative_score": top.scores})

    names = ready.select("block", F.col("ids").alias("pair_ids"), "positive", "score")
    out = found.join(F.broadcast(names) if few else names, "block").groupBy("block").applyInArrow(mined, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    out, _ = cut(out, "negatives")
    for uri in (uri_1, uri_2, uri_3):
        remove_folder(spark, uri)
    return out


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON len(a.w) = len(c.w) AND a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM r WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
