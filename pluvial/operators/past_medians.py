"""Medians of strictly earlier values, for the rows that need one.

A key's time is cut into blocks of about sqrt(n) rows (LEAST at least). Values
are counted by block and bucket, buckets being borders of values over all keys;
running sums over the blocks tell, for each block, how many earlier values lie
in each bucket. Within a block of b rows the median's rank among the values
before the block moves by b at most, so only the few buckets that hold those
ranks are fetched, as values with counts. One sorted pass over a block then
adds its own values in time and reads each median from both lists. Fetched rows
grow with n, where meeting every earlier value would grow with its square, and
no key is one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from . import store

#: Rows of a block at least; buckets of values.
LEAST, BUCKETS = 1024, 1024


class Earlier:
    """The values before a block near the median, with counts, and the block's own so far."""

    def __init__(self):
        self.values, self.upto, self.below, self.before, self.own = [], [], 0, 0, []

    def fetched(self, value: float, count: int, below: int, before: int) -> None:
        """In rising order. ``below``: earlier values under the first fetched one; ``before``: all of them."""
        self.values.append(value)
        self.upto.append((self.upto[-1] if self.upto else below) + count)
        self.below, self.before = below, before

    def add(self, value: float) -> None:
        insort(self.own, value)

    def _at(self, rank: int) -> float:
        """The value of a rank, from 0, among all values so far."""
        own, values, upto = self.own, self.values, self.upto
        i = bisect_left(range(len(values)), True, key=lambda i: upto[i] + bisect_right(own, values[i]) > rank)

        def under(x: float) -> int:
            k = bisect_right(values, x)
            return upto[k - 1] if k else self.below

        j = bisect_left(range(len(own)), True, key=lambda j: j + 1 + under(own[j]) > rank)
        found = ([values[i]] if i < len(values) else []) + ([own[j]] if j < len(own) else [])
        return min(found)

    def median(self) -> float | None:
        n = self.before + len(self.own)
        if not n:
            return None
        low, high = self._at((n - 1) // 2), self._at(n // 2)
        return low if low == high else 0.5 * low + 0.5 * high


def _position(df: DataFrame, order: str) -> Column:
    """A number that does not fall as ``order`` rises."""
    kind = df.schema[order].dataType
    if isinstance(kind, NumericType):
        return F.col(order).cast("double")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.col(order).cast("timestamp").cast("double")
    return F.lit(0.0)


def _fetched(values: DataFrame, targets: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, block, v, n, below, before``: for each target block the earlier values that its medians may be or lie next to."""
    borders = values.agg(F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS)).first()[0]  # one row
    inner = sorted({b for b in borders or () if abs(b) < float("inf")}) or [0.0]
    placed = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="v", outputCol="bucket", handleInvalid="keep").transform(values)
    counted, _ = store.written(placed.groupBy(*groups, "block", "bucket", "v").agg(F.count(F.lit(1)).alias("n")), "counted")
    by_bucket = counted.groupBy(*groups, "block", "bucket").agg(F.sum("n").alias("n"))
    blocks = counted.select(*groups, "block").unionByName(targets.select(*groups, "block")).distinct()
    grid = blocks.join(by_bucket.select(*groups, "bucket").distinct(), groups).join(by_bucket, [*groups, "block", "bucket"], "left").na.fill(0, ["n"])
    earlier = Window.partitionBy(*groups, "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*groups, "block")
    under = inside.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    grid = grid.withColumn("was", zero(F.sum("n").over(earlier)))
    grid = grid.withColumns({"below": zero(F.sum("was").over(under)), "own": F.sum("n").over(inside), "before": F.sum("was").over(inside)})
    near = (F.col("below") < (F.col("before") + F.col("own")) / 2 + 1) & (F.col("below") + F.col("was") > (F.col("before") - 1) / 2 - F.col("own") - 1)
    needed = grid.where((F.col("was") > 0) & near).join(targets.select(*groups, "block"), [*groups, "block"], "left_semi")
    needed = needed.withColumn("below", F.min("below").over(inside)).select(*groups, "block", "bucket", "below", "before")
    then = counted.withColumnRenamed("block", "then")
    met = needed.join(then, [*groups, "bucket"]).where("then < block")
    return met.groupBy(*groups, "block", "v").agg(F.sum("n").alias("n"), F.first("below").alias("below"), F.first("before").alias("before"))


def _swept(width: int):
    """Rows sorted by group, block, kind and order, to a median for each gap. Columns: the ``width`` of a block's
    name, kind (0: fetched, 1: own), order, v, gap, n, below, before."""

    def run(batches):
        name, state = None, Earlier()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            kinds, v, gap, n, below, before = (columns[i] for i in (width, width + 2, width + 3, width + 4, width + 5, width + 6))
            at, medians = [], []
            for i, own in enumerate(zip(*columns[:width], strict=True)):
                if own != name:
                    name, state = own, Earlier()
                if kinds[i] == 0:
                    state.fetched(v[i], n[i], below[i], before[i])
                    continue
                if gap[i]:
                    at.append(i)
                    medians.append(state.median())
                if v[i] is not None:
                    state.add(v[i])
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[: width - 1], some.column(width + 1), pa.array(medians, pa.float64())], [*batch.schema.names[: width - 1], "o", "m"])

    return run


def _swept_short(width: int, finer: list[list[int]]):
    """Rows sorted by key and order, whole keys together, to a row of medians for each gap. Columns: the ``width`` of the
    key, order, v, gap, and those that ``finer`` has the places of, for each median."""

    def run(batches):
        name, states = None, [{} for _ in finer]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            v, gap = columns[width + 1], columns[width + 2]
            at, medians = [], [[] for _ in finer]
            for i, own in enumerate(zip(*columns[:width], strict=True)):
                if own != name:
                    name, states = own, [{} for _ in finer]
                if gap[i]:
                    at.append(i)
                for state, places, out in zip(states, finer, medians, strict=True):
                    key = tuple(columns[p][i] for p in places)
                    if gap[i]:
                        out.append(state[key].median() if key in state else None)
                    if v[i] is not None and None not in key:
                        state.setdefault(key, Earlier()).add(v[i])
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[: width + 1], *(pa.array(m, pa.float64()) for m in medians)], [*batch.schema.names[: width + 1], *[f"m{j}" for j in range(len(finer))]])

    return run


def medians(df: DataFrame, c: str, keys: Sequence[str], order: str, outs: dict[str, Sequence[str]], where: Column) -> DataFrame:
    """``keys, order`` and the columns ``outs`` for the rows ``where`` with whole keys: medians of ``c`` over the key's
    strictly earlier rows that also agree in an out's columns, null without any.

    (keys, order) has to identify a row; NaN counts as no value. The values of
    the largest key are counted first: up to LEAST, keys are swept whole, for
    all medians at once; beyond, the needed columns are written to the shared
    folder, since many passes read them.
    """
    spark = df.sparkSession
    store.ship(spark)
    names, extra = [f"g{i}" for i in range(len(keys))], sorted({x for columns in outs.values() for x in columns})
    v = F.col(c).cast("double")
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(order).alias("o"), F.when(~F.isnan(v), v).alias("v"),
        F.coalesce(where, F.lit(False)).alias("gap"), *[F.col(x).alias(f"f{i}") for i, x in enumerate(extra)], _position(df, order).alias("p"),
    )
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    most = rows.where("v is not null").groupBy(*names).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]  # one row
    rows = rows.where("v is not null or gap")
    kind = dict(rows.dtypes)
    head = [*names, "o"]
    if (most or 0) <= LEAST:
        dealt = rows.withColumn("deal", F.xxhash64(*names)).repartition("deal").sortWithinPartitions(*head)
        places = [[len(names) + 3 + extra.index(x) for x in columns] for columns in outs.values()]
        schema = ", ".join([*(f"{n} {kind[n]}" for n in head), *(f"m{j} double" for j in range(len(outs)))])
        found = dealt.select(*head, "v", "gap", *[f"f{i}" for i in range(len(extra))]).mapInArrow(_swept_short(len(names), places), schema)
    else:
        found, (rows, _) = None, store.written(rows, "past")
        for j, columns in enumerate(outs.values()):
            groups = [*names, *[f"f{extra.index(x)}" for x in columns]]
            one = _by_blocks(rows, groups, kind).select(*head, F.col("m").alias(f"m{j}"))
            found = one if found is None else found.join(one, head, "full")
    return found.select(*[F.col(n).alias(k) for n, k in zip(head, [*keys, order], strict=True)], *[F.col(f"m{j}").alias(out) for j, out in enumerate(outs)])


def _by_blocks(rows: DataFrame, names: list[str], kind: dict[str, str]) -> DataFrame:
    """``names, o, m`` for the gaps of ``rows`` (names, o, v, gap, p)."""
    sizes = rows.groupBy(*names).agg(F.count("v").alias("m"), F.min("p").alias("a"), F.max("p").alias("z"), F.max("gap").alias("any")).where("any")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("m") / F.greatest(F.lit(LEAST), F.sqrt("m"))))
    share = F.try_divide(F.col("p") - F.col("a"), F.col("z") - F.col("a"))
    block = F.when(F.col("blocks") > 1, F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("blocks")), F.col("blocks") - 1)).otherwise(0).cast("int")
    placed = rows.join(sizes, names).select(*names, "o", "v", "gap", "blocks", block.alias("block"))
    columns = [*names, "block", "kind", "o", "v", "gap", "n", "below", "before"]
    targets = placed.where("gap").select(*names, "block", "blocks").distinct()
    own = placed.join(targets.select(*names, "block"), [*names, "block"], "left_semi")
    own = own.select(*names, "block", F.lit(1).alias("kind"), "o", "v", "gap", *[F.lit(None).cast("bigint").alias(x) for x in ("n", "below", "before")])
    many = F.col("blocks") > 1
    fetched = _fetched(placed.where(many & F.col("v").isNotNull()).select(*names, "block", "v"), targets.where(many), names)
    own = own.unionByName(fetched.select(*names, "block", F.lit(0).alias("kind"), F.lit(None).cast(kind["o"]).alias("o"), "v", F.lit(False).alias("gap"), "n", "below", "before"))
    # by a fresh column: an exchange on the columns themselves may be left out where both parts of the union have it,
    # and their own exchanges may then be read where they lie
    dealt = own.select(*columns).withColumn("deal", F.xxhash64(*names, "block")).repartition("deal")
    swept = dealt.sortWithinPartitions(*names, "block", "kind", "o", "v").select(*columns)
    schema = ", ".join([*(f"{n} {kind[n]}" for n in names), f"o {kind['o']}", "m double"])
    return swept.mapInArrow(_swept(len(names) + 1), schema)
