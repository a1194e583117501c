"""Exact top-k by inner product of integer vectors, by a uniform threshold in three phases.

The components fall into GROUPS; each group is a node that knows its partial
scores. Phase 1: every node gives its list of the k largest partial scores of
each query; the whole scores of what is listed give a cutoff below which no
result lies. Phase 2: with the cutoff t at hand, every node gives all entries
of at least t / GROUPS: whoever reaches t does so at one node at least. Phase
3: an entry's missing partial scores are added exactly, unless even the most
that they can be, less than t / GROUPS each, wouldn't reach t.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vectors as V
from ._shared import cut, remove_folder, ship

GROUPS, PAIRS, LOWEST = 2, 1 << 17, -(1 << 62)


def _cuts(dim: int, groups: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(groups, dim) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def partial_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q times c transposed, in the narrowest type that holds every sum exactly."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


def _exact(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    return np.concatenate([(q[qi[a : a + PAIRS]] * c[ci[a : a + PAIRS]]).sum(axis=1) for a in range(0, len(qi), PAIRS)]) if len(qi) else np.zeros(0, np.int64)


def _read(row: dict):
    q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q, c = (np.frombuffer(row[n], np.int64).reshape(-1, row["dim"]) for n in ("q_raw", "raw"))
    return q_ids, ids, q, c, q_ids[:, None] == ids


def _lists(k: int, groups: int):
    """Phase 1."""

    def meet(best: V.Best, row: dict) -> None:
        q_ids, ids, q, c, own = _read(row)
        listed = np.zeros(own.shape, bool)
        for a, b in _cuts(row["dim"], groups):
            part = partial_scores(q[:, a:b], c[:, a:b])
            part[own] = LOWEST
            if len(ids) > k:
                np.put_along_axis(listed, np.argpartition(-part, k - 1, axis=1)[:, :k], True, axis=1)
            else:
                listed[:] = True
        qi, ci = np.nonzero(listed & ~own)
        best.add(qi, ids[ci], _exact(q, c, qi, ci))

    return meet


def _collect(k: int, groups: int):
    """Phases 2 and 3."""

    def meet(best: V.Best, row: dict) -> None:
        q_ids, ids, q, c, own = _read(row)
        cutoff = np.frombuffer(row["q_cutoff"], np.int64)
        cuts = _cuts(row["dim"], groups)
        share = -(-cutoff // len(cuts))  # a whole score, so the next one up
        parts = [partial_scores(q[:, a:b], c[:, a:b]) for a, b in cuts]
        given = [p >= share[:, None] for p in parts]
        most = np.zeros(own.shape, np.int64)
        some = np.zeros(own.shape, bool)
        for p, g in zip(parts, given, strict=True):
            most += np.where(g, p, share[:, None] - 1)
            some |= g
        known = np.logical_and.reduce(given)
        qi, ci = np.nonzero(some & (most >= cutoff[:, None]) & ~own)
        scores = most[qi, ci]  # whole where every node gave an entry
        open_ = np.flatnonzero(~known[qi, ci])
        scores[open_] = _exact(q, c, qi[open_], ci[open_])
        stay = scores >= cutoff[qi]
        best.add(qi[stay], ids[ci[stay]], scores[stay])

    return meet


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, groups: int = GROUPS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row with ``is_query(id)``, the ``k`` other rows of largest integer inner product.

    Components become floor(scale * x), x as double. Returns ``query_id, rank,
    vec_id, score`` long, ties to the smaller id; all candidates if there are
    fewer than ``k``. Rows whose vector is null, empty, or holds null or
    non-finite components take no part, nor do null ids; vectors of another
    length than the query's are no candidates. A row is its query's own if the
    ids agree. Sums beyond 63 bits wrap.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = V.usable(vectors, id_col, vec_col, drop_zero=False)

    def whole(x: np.ndarray) -> dict[str, np.ndarray]:
        return {"raw": np.floor(scale * x).astype(np.int64)}

    candidates, uri_1 = cut(V.blocks(rows, V.CANDIDATES, "raw binary", whole), "candidates")
    queries, uri_2 = cut(V.blocks(rows.where(is_query(F.col("vec_id"))), V.QUERIES, "raw binary", whole).withColumn("block", F.xxhash64("ids")), "queries")
    names = ["q_ids", "q_raw", "ids", "raw"]
    lists = V.scan(V.paired(candidates, queries), names, k, np.int64, _lists(k, groups))
    sizes = queries.select("block", F.length("ids").alias("bytes"))

    def cutoffs(table: pa.Table) -> pa.Table:
        top = V.Best(table.column("bytes")[0].as_py() // 8, k, np.int64)
        for q, i, s in zip(*(table.column(n).to_pylist() for n in ("query", "ids", "scores")), strict=True):
            top.add(*(np.frombuffer(x, np.int64) for x in (q, i, s)))
        return pa.table({"block": [table.column("block")[0].as_py()], "cutoff": pa.array([top.floor(LOWEST).tobytes()], pa.binary())})

    named = lists.join(F.broadcast(sizes) if queries.count() <= 1000 else sizes, "block")
    safe = named.groupBy("block").applyInArrow(cutoffs, "block bigint, cutoff binary")
    ready, uri_3 = cut(queries.join(safe, "block"), "cutoffs")
    found = V.scan(V.paired(candidates, ready), [*names, "q_cutoff"], k, np.int64, _collect(k, groups))
    out, _ = cut(V.merged(found, ready.select("block", F.col("ids").alias("q_ids")), k, np.int64, "bigint"), "highest")
    for uri in (uri_1, uri_2, uri_3):
        remove_folder(spark, uri)
    return out


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.w) = len(c.w) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""
