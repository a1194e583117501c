"""Vectors as packed blocks, and queries against all of them block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most vectors of a block; pairs of blocks that one task may hold one after the other.
CANDIDATES, QUERIES, FIELD = 2048, 1024, 64


def usable(vectors: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """``vec_id`` long and ``v`` array<double> of the rows whose vector is complete and finite."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if drop_zero:
        fine &= F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))


def blocks(rows: DataFrame, most: int, columns: str, pack) -> DataFrame:
    """Rows of (dim int, ids binary, ``columns``): up to ``most`` vectors of one length each, with what
    ``pack`` (an array of vectors to a dict of arrays) makes of them. Blocks stay where their rows were read."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, vs = held.pop(dim)
            x = np.stack(vs)
            made = pack(x)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()), *(pa.array([np.ascontiguousarray(made[n]).tobytes()], pa.binary()) for n in names)], ["dim", "ids", *names])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            col = batch.column(1)
            flat, ends = np.asarray(col.flatten()), np.asarray(col.offsets) - col.offsets[0].as_py()
            for i, vec_id in enumerate(ids):
                v = flat[ends[i] : ends[i + 1]]
                own = held.setdefault(len(v), ([], []))
                own[0].append(vec_id)
                own[1].append(v)
                if len(own[0]) == most:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, ids binary, " + columns)


def paired(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Each block of queries beside every block of candidates of its length.

    The pairs form a grid of candidate slices by query groups, with as many
    fields as the shuffle has partitions a few times over, and more where a
    field would hold over FIELD pairs; the two numbers are chosen for the least
    copying. A block of candidates is copied to each query group and a block of
    queries to each slice. A field's pairs follow each other by query block, and
    no task holds more than two blocks and a query block's results.
    """
    vectors = lambda df: df.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0)), F.count(F.lit(1))).first()
    (c_bytes, c_blocks), (q_bytes, q_blocks) = vectors(candidates), vectors(queries)
    fields = max(4 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), c_blocks * q_blocks // FIELD)
    groups = min(max(1, q_blocks), max(1, round((fields * q_bytes / max(1, c_bytes)) ** 0.5)))
    slices = min(max(1, c_blocks), -(-fields // groups))
    place = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.withColumn("slice", place(slices)).withColumn("group", every(groups))
    q = queries.withColumn("group", place(groups)).withColumn("slice", every(slices))
    on = ["dim", "slice", "group"]
    q = q.select(*[F.col(x).alias(x if x in on else f"q_{x}") for x in q.columns])
    return q.hint("merge").join(c, on)


class Best:
    """For each query of a block the ``k`` largest scores so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, dtype):
        self.k, self.n = k, n
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]

    def floor(self, none) -> np.ndarray:
        """Each query's k-th score, or ``none`` if there are fewer."""
        out = np.full(self.n, none, self.scores.dtype)
        full = np.bincount(self.query, minlength=self.n) >= self.k
        last = np.searchsorted(self.query, np.arange(self.n), "right") - 1
        out[full] = self.scores[last[full]]
        return out

    def row(self, block: int) -> pa.RecordBatch:
        parts = {"query": self.query, "ids": self.ids, "scores": self.scores}
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts.values())], ["block", *parts])


FOUND = "block bigint, query binary, ids binary, scores binary"


def scan(pairs: DataFrame, names: list[str], k: int, dtype, meet) -> DataFrame:
    """FOUND rows. ``meet(best, row)`` adds what one pair of blocks, a dict of bytes, has; results are
    given out when the next query block begins."""

    def run(batches):
        block, found = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(["q_block", "dim", *names])}
                if row["q_block"] != block:
                    if found is not None:
                        yield found.row(block)
                    block, found = row["q_block"], Best(len(row["q_ids"]) // 8, k, dtype)
                meet(found, row)
        if found is not None:
            yield found.row(block)

    return pairs.select("q_block", "dim", *names).mapInArrow(run, FOUND)


def merged(found: DataFrame, blocks_of: DataFrame, k: int, dtype, kind: str) -> DataFrame:
    """``query_id, rank, vec_id, score`` from the FOUND rows, of which a query block has one or two for each slice."""

    def run(table: pa.Table) -> pa.Table:
        names = np.frombuffer(table.column("q_ids")[0].as_py(), np.int64)
        top = Best(len(names), k, dtype)
        for q, i, s in zip(*(table.column(c).to_pylist() for c in ("query", "ids", "scores")), strict=True):
            top.add(np.frombuffer(q, np.int64), np.frombuffer(i, np.int64), np.frombuffer(s, dtype))
        rank = np.arange(len(top.query)) - np.searchsorted(top.query, top.query) + 1
        return pa.table({"query_id": names[top.query], "rank": rank.astype(np.int32), "vec_id": top.ids, "score": top.scores})

    named = found.join(F.broadcast(blocks_of) if blocks_of.count() <= 1000 else blocks_of, "block")
    return named.groupBy("block").applyInArrow(run, f"query_id bigint, rank int, vec_id bigint, score {kind}")
