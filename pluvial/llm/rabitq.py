"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

A vector o is scaled to unit length and turned by a random rotation; its code
holds the signs. With x the code as a unit vector and o' the turned vector,
<x, o'> is kept as the correction scalar, and <q, o> is estimated by
|o| <x, q'> / <x, o'>. The estimate's error is at most
|o| |q| sqrt(1 - <x, o'>^2) / <x, o'> * EPSILON / sqrt(D - 1), but for a chance
that falls off fast in EPSILON. Vectors whose upper bound reaches the k-th
exact score found so far are reranked on the original components: a tile of
queries meets the vectors chosen for any of them in one matrix product, of
which the chosen pairs are read, and those that may reach the k-th score, by
the product's own rounding, get their sum component by component.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vectors as V
from ._shared import cut, remove_folder, ship

EPSILON, PAIRS, TILE = 3.5, 1 << 14, 64


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """dim x D, with orthonormal rows; D is the next multiple of 8."""
    size = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def pack(x: np.ndarray) -> dict[str, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    turned = x @ rotation(x.shape[1]) / norm[:, None]
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return {"codes": np.packbits(turned > 0, axis=1), "scalars": np.stack([norm, fit]), "raw": x}


def _meet(k: int, epsilon: float):
    def meet(best: V.Best, row: dict) -> None:
        dim = row["dim"]
        turn = rotation(dim)
        size = turn.shape[1]
        q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        q, raw = (np.frombuffer(row[n]).reshape(-1, dim) for n in ("q_raw", "raw"))
        columns = np.ascontiguousarray(q.T), np.ascontiguousarray(raw.T)
        norm, fit = np.frombuffer(row["scalars"]).reshape(2, -1)
        bits = np.unpackbits(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), axis=1).astype(np.float32) * 2 - 1
        estimate = ((q @ turn).astype(np.float32) @ bits.T) * (norm / fit / np.sqrt(size)).astype(np.float32)
        spread = norm * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * epsilon / np.sqrt(max(size - 1, 1)) + 1e-5 * norm
        size_of = np.sqrt((q * q).sum(axis=1))
        bound = size_of[:, None].astype(np.float32) * spread.astype(np.float32)
        own = q_ids[:, None] == ids
        estimate[own] = -np.inf

        def exact(qi, ci):
            out = np.zeros(len(qi))
            for a in range(0, len(qi), PAIRS):
                x, y, sums = columns[0][:, qi[a : a + PAIRS]], columns[1][:, ci[a : a + PAIRS]], out[a : a + PAIRS]
                for d in range(dim):  # one component after the other, so that a score is the same sum everywhere
                    sums += x[d] * y[d]
            return out

        if len(ids) > k:
            first = np.argpartition(-estimate, k - 1, axis=1)[:, :k]
        else:
            first = np.broadcast_to(np.arange(len(ids)), (len(q_ids), len(ids)))
        qi, ci = np.repeat(np.arange(len(q_ids)), first.shape[1]), first.ravel()
        real = q_ids[qi] != ids[ci]
        qi, ci = qi[real], ci[real]
        done = own
        done[qi, ci] = True
        best.add(qi, ids[ci], exact(qi, ci))
        floor = best.floor(-np.inf)
        chosen = ~(estimate + bound < floor[:, None]) & ~done  # what has no estimate, by overflow, is chosen
        slack, parts = 4e-16 * dim * norm, []
        for a in range(0, len(q), TILE):
            part = chosen[a : a + TILE]
            some = np.flatnonzero(part.any(axis=0))
            near = q[a : a + TILE] @ raw[some].T
            qi, ci = np.nonzero(part[:, some] & ~(near + size_of[a : a + TILE, None] * slack[some] < floor[a : a + TILE, None]))
            parts.append((qi + a, some[ci]))
        qi, ci = (np.concatenate(x) for x in zip(*parts, strict=True))
        scores = exact(qi, ci)
        stay = scores >= floor[qi]
        best.add(qi[stay], ids[ci[stay]], scores[stay])

    return meet


def search(vectors: DataFrame, is_query, k: int = 20, epsilon: float = EPSILON, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row with ``is_query(id)``, the ``k`` other rows of largest inner product.

    Returns ``query_id, rank, vec_id, score``, scores in double precision from
    the original components, ties to the smaller id; all candidates if there
    are fewer than ``k``. Rows whose vector is null, empty, zero, or holds null
    or non-finite components take no part, nor do null ids; vectors of another
    length than the query's are no candidates. A row is its query's own if the
    ids agree. Repeated ids that are not the query's count as several rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = V.usable(vectors, id_col, vec_col, drop_zero=True)
    kinds = "codes binary, scalars binary, raw binary"
    candidates, uri_1 = cut(V.blocks(rows, V.CANDIDATES, kinds, pack), "candidates")
    queries, uri_2 = cut(V.blocks(rows.where(is_query(F.col("vec_id"))), V.QUERIES, "raw binary", lambda x: {"raw": x}).withColumn("block", F.xxhash64("ids")), "queries")
    found = V.scan(V.paired(candidates, queries), ["q_ids", "q_raw", "ids", "codes", "scalars", "raw"], k, np.float64, _meet(k, epsilon))
    out, _ = cut(V.merged(found, queries.select("block", F.col("ids").alias("q_ids")), k, np.float64, "double"), "nearest")
    for uri in (uri_1, uri_2):
        remove_folder(spark, uri)
    return out


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.w, c.w) AS score
  FROM v q JOIN v c ON len(q.w) = len(c.w) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""
