"""Gradient-boosted trees by histograms: Tweedie, logistic and squared loss.

Features become at most 255 bins, by borders from quantiles, and one binary
column. A pass over the rows gives each task's histograms of gradients, second
derivatives and rows by node, feature and bin; one shuffle by feature adds them
up and leaves the best split of each node and feature, and the driver, which
sees a row for each node and feature of one tree, picks the node's. Trees grow
best-first to ``leaves`` leaves; since a node's best split hangs on its own rows
only, a pass opens every node that best-first growth would open by what is known
so far, and a tree takes about as many passes as it is deep.

Rows lie in blocks, a block's bins, labels and scores as bytes, so that Spark
moves some thousand rows as one and numpy reads them where they lie; training
and validation rows lie in blocks of their own. Sums are of whole numbers (gradients times a power of two), row and column
samples are drawn by hashes, and borders come from a hashed sample: reruns and
other partitions give the same trees. Scores are written every KEEP trees, with
the losses and largest gradients of each block beside them, so a pass applies
only the trees since then and a lost executor repeats one pass.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Trees between two written scores; rows that the borders of bins are taken from, about.
KEEP, SAMPLE = 1, 200_000
FINE = 20  # binary digits of a loss that count


@dataclass(frozen=True)
class Settings:
    """How to boost. ``patience``: rounds without a better ``measure`` on validation rows before the end, the best
    round stays; 0: all rounds. ``rows`` and ``columns``: shares that each tree sees. ``l1``, ``l2``: on leaf values."""

    objective: str = "tweedie"
    rounds: int = 2000
    rate: float = 0.03
    leaves: int = 31
    least_rows: int = 20
    least_weight: float = 1e-3
    l1: float = 0.1
    l2: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    patience: int = 100
    measure: str = "own"
    power: float = 1.3
    bins: int = 255
    seed: int = 42


#: The evaluation's, the dashboard's and the feature selection's settings.
EVALUATION = Settings()
DASHBOARD = Settings(rounds=1200, rows=0.9, columns=0.9, patience=80, measure="rmse")
DASHBOARD_CLASSIFIER = Settings(objective="binary", rounds=1000, rows=0.9, columns=0.9, patience=80)
SELECTION = Settings(rounds=350, rate=0.04, least_rows=30, rows=0.9, columns=0.9, l1=0.0, l2=0.0, patience=0)


class Objective:
    """Start, gradients, second derivatives, losses and predictions by raw scores f."""

    def __init__(self, kind: str, power: float = 1.3):
        if kind not in ("tweedie", "binary", "squared"):
            raise ValueError(f"no such objective: {kind}")
        self.kind, self.power = kind, power

    def start(self, mean: float) -> float:
        if self.kind == "tweedie":
            return math.log(max(mean, 1e-12))
        if self.kind == "binary":
            mean = min(max(mean, 1e-12), 1 - 1e-12)
            return math.log(mean / (1 - mean))
        return mean

    def slopes(self, f: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "tweedie":
            a, b = 1 - self.power, 2 - self.power
            up, down = np.exp(b * f), y * np.exp(a * f)
            return w * (up - down), w * (b * up - a * down)
        if self.kind == "binary":
            p = 1 / (1 + np.exp(-f))
            return w * (p - y), w * p * (1 - p)
        return w * (f - y), w.copy()

    def loss(self, f: np.ndarray, y: np.ndarray, measure: str = "own") -> np.ndarray:
        if measure == "rmse":
            return (self.predicted(f) - y) ** 2
        if self.kind == "tweedie":
            a, b = 1 - self.power, 2 - self.power
            return np.exp(b * f) / b - y * np.exp(a * f) / a
        if self.kind == "binary":
            return np.logaddexp(0, f) - y * f
        return (f - y) ** 2

    def predicted(self, f: np.ndarray) -> np.ndarray:
        return np.exp(f) if self.kind == "tweedie" else 1 / (1 + np.exp(-f)) if self.kind == "binary" else f


@dataclass
class Tree:
    """Nodes side by side; node 0 is the root, ``left`` is -1 at leaves. A bin up to ``bin`` goes left; bin 0, which
    holds what is missing, where ``missing_left`` says."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for column, x in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0), (self.rows, rows)):
            column.append(x)
        return len(self.left) - 1

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        return self.walk()(np.ascontiguousarray(x.T))

    def walk(self):
        """A function from bins, features by rows, to the leaf of each row: one table of the next node by node and bin."""
        feature, bin_, miss, left, right = (np.asarray(c)[:, None] for c in (self.feature, self.bin, self.missing_left, self.left, self.right))
        b, own = np.arange(256), np.arange(len(left))[:, None]
        after = np.where(left < 0, own, np.where(np.where(b == 0, miss, b <= bin_), left, right)).ravel()
        depth = np.zeros(len(left), int)
        for i in range(len(left)):  # children come after their parents
            if self.left[i] >= 0:
                depth[[self.left[i], self.right[i]]] = depth[i] + 1
        steps, of = int(depth.max()), np.maximum(feature.ravel(), 0)

        def found(x: np.ndarray) -> np.ndarray:
            flat, n = x.ravel(), x.shape[1]
            node, rows, first = np.zeros(n, np.int64), np.arange(n), of * n
            for _ in range(steps):
                bins = flat.take(first.take(node) + rows)
                node <<= 8
                node += bins
                node = after.take(node)
            return node

        return found

    def values_of(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.nodes_of(x)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(key: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows the tree sees, by a hash of their keys (int64)."""
    if share >= 1:
        return np.ones(len(key), bool)
    salt = _mixed(np.array([seed * 1_000_003 + tree + 1], np.uint64))[0]
    return (_mixed(key.view(np.uint64) ^ salt) >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


def columns_of(n: int, tree: int, seed: int, share: float) -> np.ndarray:
    """The features that the tree may split on: at least one."""
    order = np.argsort(_mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919) + np.uint64(seed * 65_537 + tree)), kind="stable")
    return np.sort(order[: max(1, round(n * share))])


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(hist: np.ndarray, unit: tuple[float, float], s: Settings) -> tuple[float, int, bool, tuple[int, int, int]]:
    """The best split of one node by one feature: gain, bin, whether missing values go left, and the left sums.

    ``hist``: whole numbers by bin (0: missing) and g, h, rows; ``unit``: what 1 is worth in g and h. Of equal
    gains the smaller bin, and missing values to the right, win. No split: gain 0.
    """
    total = hist.sum(axis=0)
    worth = lambda x: shrunk(x[..., 0] * unit[0], s.l1) ** 2 / (x[..., 1] * unit[1] + s.l2 + 1e-300)
    upto = np.cumsum(hist[1:], axis=0)[:-1]
    best = (0.0, 0, False, (0, 0, 0))
    for missing_left in (False, True) if hist[0, 2] else (False,):
        left = upto + hist[0] if missing_left else upto
        right = total - left
        fine = (left[:, 2] >= s.least_rows) & (right[:, 2] >= s.least_rows) & (left[:, 1] * unit[1] >= s.least_weight) & (right[:, 1] * unit[1] >= s.least_weight)
        gain = np.where(fine, worth(left) + worth(right) - worth(total), -np.inf)
        if len(gain) and gain.max() > best[0] * (1 + 1e-12) + 1e-12:
            b = int(gain.argmax())
            best = (float(gain[b]), b + 1, missing_left, tuple(int(v) for v in left[b]))
    return best


def grow(passed, features: np.ndarray, unit: tuple[float, float], s: Settings) -> Tree:
    """A tree grown best-first. ``passed(tree, nodes)`` gives for each of the nodes its total and, by feature, ``best_split``'s answers."""
    tree, sums, found = Tree(), {}, {}

    def learn(nodes: list[int]) -> None:
        for node, (total, splits) in passed(tree, nodes).items():
            sums[node] = total
            tree.value[node] = float(-s.rate * shrunk(total[0] * unit[0], s.l1) / (total[1] * unit[1] + s.l2 + 1e-300))
            tree.rows[node] = int(total[2])
            found[node] = max(((split[0], -f, split) for f, split in splits.items()), default=(0.0, 0, None), key=lambda x: x[:2])

    learn([tree.add(0.0, 0)])
    while True:
        heap, order, unknown = [(-found[0][0], 0)], [], []
        while heap and len(order) < s.leaves - 1:
            gain, node = heapq.heappop(heap)
            if gain >= 0:
                break
            order.append(node)
            if tree.left[node] < 0:
                unknown.append(node)
            else:
                for child in (tree.left[node], tree.right[node]):
                    heapq.heappush(heap, (-found[child][0], child))
        if not unknown:
            return _kept(tree, set(order))
        new = []
        for node in unknown:
            gain, minus_f, split = found[node]
            tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = -minus_f, split[1], split[2], gain
            tree.left[node], tree.right[node] = tree.add(0.0, 0), tree.add(0.0, 0)
            new += [tree.left[node], tree.right[node]]
        learn(new)


def _kept(tree: Tree, split: set[int]) -> Tree:
    """The tree without the nodes that were opened ahead and not needed."""
    out, queue = Tree(), [(0, -1, "")]
    for node, parent, side in queue:
        at = out.add(tree.value[node], tree.rows[node])
        if parent >= 0:
            getattr(out, side)[parent] = at
        if node in split:
            out.feature[at], out.bin[at], out.missing_left[at], out.gain[at] = tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node]
            queue += [(tree.left[node], at, "left"), (tree.right[node], at, "right")]
    return out


def borders(df: DataFrame, features: Sequence[str], key: str, bins: int, sample: int = SAMPLE) -> list[list[float]]:
    """At most ``bins`` - 1 borders for each feature: distinct quantiles of a sample drawn by a hash of ``key``, about ``sample`` rows."""
    n = df.count()
    some = df if n <= sample else df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) < F.lit((1 << 40) * sample // n))
    long = some.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in features])).alias("f", "v")).where(F.col("v").isNotNull())
    p = [i / bins for i in range(1, bins)]
    # percentile counts a feature's values in one task: of the sample only
    rows = long.groupBy("f").agg(F.percentile("v", F.array(*[F.lit(x) for x in p])).alias("q"))
    found = {r.f: r.q for r in rows.collect()}  # a row for each feature
    return [sorted(set(found.get(i) or [])) for i in range(len(features))]


def _finite(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


#: A block of rows of one part: their bins (a row of bytes for each feature), labels, weights, keys and scores as bytes,
#: and of the training rows the largest |g| and h, of validation rows the sum of their losses in units of 2^-FINE.
STATE = "n int, valid boolean, x binary, y binary, w binary, key binary, f binary, g double, h double, loss bigint"
HELD = [c.split()[0] for c in STATE.split(", ")]
#: Bytes of a block, about, and rows at most (their losses fit 64 bits); row groups of a few blocks, so that tasks are even.
BLOCK_BYTES, BLOCK_ROWS = 1 << 18, 8192
AS_BLOCKS = {"parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "4", "parquet.enable.dictionary": "false"}
#: Rows whose histograms are added at once; digits of the whole numbers' lower parts, whose sums doubles hold exactly.
AT_ONCE, LOW = 1 << 16, 30


def _block(valid: bool, x: np.ndarray, y, w, key, f, objective: Objective, measure: str) -> dict:
    """A row of STATE. ``x``: features by rows."""
    g = h = np.zeros(0)
    loss = 0
    if valid:
        lost = np.clip(objective.loss(f, y, measure), -1e9, 1e9)
        loss = int(np.rint(lost * (1 << FINE)).astype(np.int64).sum())
    else:
        g, h = objective.slopes(f, y, w)
    return {"n": len(y), "valid": valid, "x": x.tobytes(), "y": y.tobytes(), "w": w.tobytes(), "key": key.tobytes(), "f": f.tobytes(), "g": float(np.abs(g).max(initial=0)), "h": float(h.max(initial=0)), "loss": loss}


_ARROW = pa.schema([("n", pa.int32()), ("valid", pa.bool_()), *[(c, pa.binary()) for c in ("x", "y", "w", "key", "f")], ("g", pa.float64()), ("h", pa.float64()), ("loss", pa.int64())])


def _binned(rows: DataFrame, n: int, edges: list[list[float]], start: float, objective: Objective, measure: str) -> DataFrame:
    """Blocks of STATE from (v: array of n doubles, y, w, valid, key)."""
    cuts = [np.asarray(e, np.float64) for e in edges]
    size = min(BLOCK_ROWS, max(256, BLOCK_BYTES // (n + 32)))

    def run(batches):
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)  # null is NaN
            y, w, valid, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            x = np.zeros((n, len(flat)), np.uint8)
            for i, e in enumerate(cuts):
                known = ~np.isnan(flat[:, i])
                x[i, known] = np.searchsorted(e, flat[known, i], "left") + 1
            for part in (False, True):
                rows_of = np.flatnonzero(valid.astype(bool) == part)
                for a in range(0, len(rows_of), size):
                    at = rows_of[a : a + size]
                    yield pa.RecordBatch.from_pylist([_block(part, x[:, at], y[at], w[at], key[at], np.full(len(at), start), objective, measure)], _ARROW)

    return rows.mapInArrow(run, STATE)


def _blocks(batches, names: Sequence[str]):
    """The columns of each block: numbers, or arrays over the bytes where they lie."""
    kinds = {"x": np.uint8, "y": np.float64, "w": np.float64, "key": np.int64, "f": np.float64}
    for batch in batches:
        for i in range(batch.num_rows):
            row = (batch.column(j)[i] for j in range(len(names)))
            yield [np.frombuffer(v.as_buffer(), kinds[c]) if c in kinds else v.as_py() for c, v in zip(names, row, strict=True)]


def _scored(state: DataFrame, trees: list[Tree], objective: Objective, measure: str) -> DataFrame:
    """The blocks with the trees' values added to their scores."""

    def run(batches):
        walks = [t.walk() for t in trees]
        for n, valid, x, y, w, key, f, *_ in _blocks(batches, HELD):
            x, f = x.reshape(-1, n), f.copy()
            for t, walk in zip(trees, walks, strict=True):
                f += np.asarray(t.value)[walk(x)]
            yield pa.RecordBatch.from_pylist([_block(valid, x, y, w, key, f, objective, measure)], _ARROW)

    return state.mapInArrow(run, STATE)


def _pieces(v: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Whole numbers as doubles whose sums are exact: in one piece, or in two by shift."""
    if len(v) * max(abs(int(v.min(initial=0))), int(v.max(initial=0))) < 1 << 53:
        return [(0, v.astype(np.float64))]
    return [(0, (v & ((1 << LOW) - 1)).astype(np.float64)), (LOW, (v >> LOW).astype(np.float64))]


def _added(sums: np.ndarray, cell: np.ndarray, parts: list[tuple[int, list[tuple[int, np.ndarray]]]]) -> None:
    """Adds whole numbers up by cell, exactly: ``sums`` (cells; g, h, rows), ``parts``: the pieces of g and h."""
    n = len(sums)
    for j, pieces in parts:
        for shift, v in pieces:
            sums[:, j] += np.bincount(cell, v, n).astype(np.int64) << shift
    sums[:, 2] += np.bincount(cell, minlength=n)


class _Rounds:
    """Passes over the blocks of STATE: what each needs of them, with the trees since they were written."""

    def __init__(self, state: DataFrame, objective: Objective, s: Settings):
        self.state, self.objective, self.s, self.recent, self.uri = state, objective, s, [], None

    def stats(self) -> tuple[int, float, float, int, int]:
        """Training rows, their largest |g| and h, validation rows and the sum of their losses in units of 2^-FINE."""
        rows = _scored(self.state, self.recent, self.objective, self.s.measure) if self.recent else self.state
        train, valid = F.when(~F.col("valid"), F.col("n")), F.when(F.col("valid"), F.col("n"))
        out = rows.agg(F.sum(train), F.max("g"), F.max("h"), F.sum(valid), F.sum(F.col("loss").cast("decimal(38,0)"))).first()  # one row
        return out[0] or 0, out[1] or 0.0, out[2] or 0.0, out[3] or 0, int(out[4] or 0)

    def pass_for(self, number: int, features: np.ndarray, scale: tuple[float, float], unit: tuple[float, float]):
        recent, objective, s, bins = list(self.recent), self.objective, self.s, self.s.bins + 1

        def passed(tree: Tree, nodes: list[int]) -> dict:
            place = np.full(len(tree.left), -1)
            place[nodes] = np.arange(len(nodes))

            def part(batches):
                sums = np.zeros((len(features), len(nodes) * bins, 3), np.int64)
                walk, walks, held = tree.walk(), [t.walk() for t in recent], []

                def flush():
                    at, x, g, h = (np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
                    held.clear()
                    pieces = list(enumerate(map(_pieces, (g, h))))
                    for i in range(len(features)):
                        _added(sums[i], at + x[i], pieces)

                for n, x, y, w, key, f in _blocks(batches, ["n", "x", "y", "w", "key", "f"]):
                    x = x.reshape(-1, n)
                    for t, old in zip(recent, walks, strict=True):
                        f = f + np.asarray(t.value)[old(x)]
                    at = place[walk(x)]
                    use = np.flatnonzero((at >= 0) & sampled(key, number, s.seed, s.rows))
                    g, h = objective.slopes(f[use], y[use], w[use])
                    held.append((at[use] * bins, np.stack([x[c].take(use) for c in features]), np.rint(g * scale[0]).astype(np.int64), np.rint(h * scale[1]).astype(np.int64)))
                    if sum(len(v[0]) for v in held) >= AT_ONCE:
                        flush()
                if held:
                    flush()
                yield pa.RecordBatch.from_arrays([pa.array(features.astype(np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], ["feature", "sums"])

            def whole(batches):
                held: dict[int, np.ndarray] = {}
                for batch in batches:
                    for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        hist = np.frombuffer(x, np.int64).reshape(len(nodes), bins, 3)
                        held[c] = held[c] + hist if c in held else hist
                for c, hist in held.items():
                    found = [best_split(x, unit, s) for x in hist]
                    total = hist.sum(axis=1)
                    columns = {"feature": [c] * len(nodes), "node": nodes, "gain": [x[0] for x in found], "bin": [x[1] for x in found], "missing_left": [x[2] for x in found], "g": total[:, 0], "h": total[:, 1], "n": total[:, 2]}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("feature", "node", "bin") else None) for k, v in columns.items()})

            sums = self.state.where("not valid").select("n", "x", "y", "w", "key", "f").mapInArrow(part, "feature int, sums binary")
            rows = sums.repartition(min(len(features), int(self.state.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "feature").mapInArrow(whole, "feature int, node int, gain double, bin int, missing_left boolean, g bigint, h bigint, n bigint")
            out: dict = {node: ((0, 0, 0), {}) for node in nodes}
            for r in rows.collect():  # a row for each node of the pass and each feature
                out[r.node] = ((r.g, r.h, r.n), out[r.node][1] | ({r.feature: (r.gain, r.bin, r.missing_left)} if r.gain > 0 else {}))
            return out

        return passed

    def add(self, tree: Tree) -> None:
        self.recent.append(tree)
        if len(self.recent) == KEEP:
            spark = self.state.sparkSession
            self.state, uri = store.written(_scored(self.state, self.recent, self.objective, self.s.measure), "scores", AS_BLOCKS)
            if self.uri:
                store.removed(spark, self.uri)
            self.uri, self.recent = uri, []


class Boosted:
    """A fitted model. ``best``: trees in use; ``history``: mean validation loss before the first and after each round."""

    def __init__(self, features: Sequence[str], edges: list[list[float]], start: float, trees: list[Tree], objective: Objective, history: list[float]):
        self.features, self.edges, self.start, self.trees, self.objective, self.history = list(features), edges, start, trees, objective, history

    @property
    def best(self) -> int:
        return len(self.trees)

    def bins(self, values: np.ndarray) -> np.ndarray:
        x = np.zeros(values.shape, np.uint8)
        for i, e in enumerate(self.edges):
            known = np.isfinite(values[:, i])
            x[known, i] = np.searchsorted(np.asarray(e, float), values[known, i], "left") + 1
        return x

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the predicted mean, chance or value; batches go through all trees in Arrow."""
        own = self

        @F.arrow_udf("double")
        def scored(v: pa.Array) -> pa.Array:
            x = own.bins(v.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(own.features)).astype(np.float64)).T.copy()
            f = np.full(x.shape[1], own.start)
            for t in own.trees:
                f += np.asarray(t.value)[t.walk()(x)]
            return pa.array(own.objective.predicted(f))

        return df.withColumn(out, scored(F.array(*[_finite(c) for c in self.features])))

    def nodes(self, spark) -> DataFrame:
        """``tree, node, feature, threshold, missing_left, left, right, value, gain, rows``: the model as a table; leaves have no feature."""
        rows = []
        for i, t in enumerate(self.trees):
            for j in range(len(t.left)):
                inner = t.left[j] >= 0
                f = t.feature[j]
                rows.append((i, j, self.features[f] if inner else None, float(self.edges[f][t.bin[j] - 1]) if inner else None, bool(t.missing_left[j]) if inner else None, t.left[j] if inner else None, t.right[j] if inner else None, float(t.value[j]), float(t.gain[j]), int(t.rows[j])))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, value double, gain double, rows bigint")

    def importances(self, spark, name: str = "importance") -> DataFrame:
        """``feature``, ``name`` (number of splits, 0 for features without) and ``name_gain`` (sum of their gains)."""
        used = self.nodes(spark).where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias(name), F.sum("gain").alias(f"{name}_gain"))
        return spark.createDataFrame([(f,) for f in self.features], "feature string").join(F.broadcast(used), "feature", "left").na.fill(0.0)


def fit(train: DataFrame, features: Sequence[str], label: str, settings: Settings = EVALUATION, valid: DataFrame | None = None, key: Sequence[str] | None = None, balanced: bool = False) -> Boosted:
    """Boosts on the rows of ``train`` with a label, and stops by those of ``valid``.

    Features are cast to doubles; nulls, NaN and infinities are missing. Rows
    are known by a hash of ``key`` (default: the label and all features), which
    the samples go by; rows of equal keys are drawn together. ``balanced``: a
    label's training rows together weigh as much as another's; validation rows
    count alike. No rows with a label: an error.
    """
    s, spark, n = settings, train.sparkSession, len(features)
    store.ship(spark)
    objective = Objective(s.objective, s.power)
    if not features or not 1 < s.bins <= 255:
        raise ValueError("needs features, and 2 to 255 bins")

    def ready(df: DataFrame, is_valid: bool) -> DataFrame:
        known = F.array(*[_finite(c) for c in features])
        key_of = F.xxhash64(*[F.col(f"`{c}`") for c in key or [label, *features]])
        return df.where(F.col(label).isNotNull()).select(known.alias("v"), F.col(label).cast("double").alias("y"), key_of.alias("key"), F.lit(is_valid).alias("valid"))

    rows = ready(train, False)
    totals = rows.groupBy("y").count() if balanced else None
    exact = F.sum(F.col("y").try_cast("decimal(38,12)")).cast("double") / F.count(F.lit(1))  # the same in any order of rows
    mean, count = rows.agg(F.coalesce(exact, F.avg("y")), F.count(F.lit(1))).first()  # one row
    if not count:
        raise ValueError("no training rows")
    edges = borders(rows.select("key", *[F.get("v", i).alias(f"v{i}") for i in range(n)]), [f"v{i}" for i in range(n)], "key", s.bins)
    weight = F.lit(1.0)
    if balanced:
        by = {r.y: r["count"] for r in totals.collect()}  # a row for each class
        weight = F.element_at(F.create_map(*[F.lit(x) for y, c in by.items() for x in (y, count / (len(by) * c))]), F.col("y"))
        mean = 0.5 if len(by) == 2 else mean
    rows = rows.withColumn("w", weight)
    if valid is not None:
        rows = rows.unionByName(ready(valid, True).withColumn("w", F.lit(1.0)))
    start = objective.start(mean)
    state, uri = store.written(_binned(rows.select("v", "y", "w", "valid", "key"), n, edges, start, objective, s.measure), "bins", AS_BLOCKS)
    rounds = _Rounds(state, objective, s)
    trees, history, best = [], [], 0
    while True:
        n_train, g_top, h_top, n_valid, loss = rounds.stats()
        history.append(loss / n_valid / (1 << FINE) if n_valid else math.nan)
        if not trees or n_valid and loss < least:
            least, best = loss, len(trees)
        if len(trees) == s.rounds or s.patience and n_valid and len(trees) - best >= s.patience:
            break
        scale = tuple(2.0 ** math.floor(61 - math.log2(n_train) - math.log2(top)) if top > 0 else 1.0 for top in (g_top, h_top))
        unit = (1 / scale[0], 1 / scale[1])
        chosen = columns_of(n, len(trees), s.seed, s.columns)
        tree = grow(rounds.pass_for(len(trees), chosen, scale, unit), chosen, unit, s)
        trees.append(tree)
        if len(tree.left) == 1:  # nothing to split
            break
        rounds.add(tree)
    store.removed(spark, uri, *([rounds.uri] if rounds.uri else []))
    stopped = s.patience and not math.isnan(history[0])
    return Boosted(features, edges, start, trees[:best] if stopped else trees, objective, history)


def with_objective(settings: Settings, objective: str) -> Settings:
    """The settings for another loss; chances are stopped by their own measure."""
    return replace(settings, objective=objective, measure="own" if objective == "binary" else settings.measure)
