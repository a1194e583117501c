"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, as 32-bit hashes, each present or not: its words, the
words' first 4 to 8 bytes, pairs of neighbours, and pairs with one or two
words between. Training sees a bounded sample once per epoch in a fixed order,
with a learning rate of its own for each coordinate; the L1 term leaves few
weights, which go to the scoring tasks as a broadcast sorted array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _labels
from ._shared import appended, ship, text_bytes
from ._words import combine, document_of, groups, word_hashes

#: Most labelled documents of each label that training reads.
PER_LABEL = {0: 8_000, 1: 4_000}
PREFIXES = (4, 5, 6, 7, 8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of a range of documents and the place of each one's document, with repeats."""
    words, counts, *stems = word_hashes(data, offsets, PREFIXES)
    doc = document_of(counts)
    hashes, docs = [words], [doc]
    for s in stems:
        hashes.append(s[s != 0])
        docs.append(doc[s != 0])
    for gap in (1, 2, 3):
        same = doc[:-gap] == doc[gap:]
        hashes.append(combine(words[:-gap][same], words[gap:][same], salt=gap))
        docs.append(doc[gap:][same])
    return (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32), np.concatenate(docs)


class Ftrl:
    """FTRL-proximal for one-hot features: alpha, beta set the rates, l1 and l2 the penalties."""

    def __init__(self, dim: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1):
        self.z, self.n = np.zeros(dim), np.zeros(dim)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _fit(rows: list[tuple[int, int, np.ndarray]], epochs: int, least_docs: int, **rates) -> tuple[np.ndarray, np.ndarray, float]:
    """rows: (place, label, distinct feature hashes). Returns sorted hashes, their weights, the bias."""
    rows.sort(key=lambda r: (r[0], len(r[2])))
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0), 0.0
    times = np.zeros(1 << 24, np.uint16)  # a first count by part of the hash, so that few have to be sorted
    for *_, own in rows:
        spot = own >> np.uint32(8)
        times[spot] += 1
    for k, (place, label, own) in enumerate(rows):  # one after the other, so that what was gathered is let go of
        rows[k] = (place, label, own[times[own >> np.uint32(8)] >= least_docs])
    del times, own
    known, times = np.unique(np.concatenate([r[2] for r in rows]), return_counts=True)
    known = known[times >= least_docs]
    model = Ftrl(len(known) + 1, **rates)
    at = []
    for place, label, own in rows:
        spot = np.searchsorted(known, own)
        spot = spot[spot < len(known)] if not len(known) else spot[known[np.minimum(spot, len(known) - 1)] == own]
        at.append((np.append(spot, len(known)), label))
    for _ in range(epochs):
        for spot, label in at:
            model.learn(spot, label)
    w = model.weights()
    keep = np.flatnonzero(w[:-1])
    return known[keep], w[keep], float(w[-1])


def train(sampled: DataFrame, epochs: int = 4, least_docs: int = 3, **rates) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from ``_labels.sample``'s rows: features in parallel, the passes in one task.

    Features of fewer than ``least_docs`` sampled documents stay out. Rows of
    equal place are ordered by their number of features.
    """

    def featurize(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out = []
            for a, b in groups(offsets):
                f, doc = features(data, offsets[a : b + 1])
                order = np.lexsort((f, doc))
                f, doc = f[order], doc[order]
                first = np.ones(len(f), bool)
                first[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
                f, doc = f[first], doc[first]
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                out += [f[ends[i] : ends[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["place", "label", "features"])

    def rows_of(batch):
        """The features are views of the batch, not copies."""
        place, label, found = batch.columns
        at = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1] // 4
        flat = np.frombuffer(found.buffers()[2] or b"", np.uint32)
        return [(p, y, flat[a:b]) for p, y, a, b in zip(place.to_pylist(), label.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def learn(batches):
        hashes, weights, bias = _fit([row for batch in batches for row in rows_of(batch)], epochs, least_docs, **rates)
        yield pa.RecordBatch.from_pydict({"hashes": [hashes.tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    found = sampled.select("place", "label", "text").mapInArrow(featurize, "place bigint, label int, features binary").repartition(1).mapInArrow(learn, "hashes binary, weights binary, bias double").collect()
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0), 0.0
    return np.frombuffer(found[0].hashes, np.uint32), np.frombuffer(found[0].weights), found[0].bias


def _seen(hashes: np.ndarray) -> np.ndarray:
    """By the first bits of a feature whether any weight may be meant; most features end here."""
    out = np.zeros(1 << 20, bool)
    out[hashes >> np.uint32(12)] = True
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns ``keep``) and ``score``: 1 / (1 + exp(-sum of the weights of the text's distinct features)).

    Null and empty texts score the bias alone; rows that repeat come out as
    often; a model without weights gives every text its bias.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the features of the sample

    def make(data, offsets):
        hashes, weights, bias = shared.value
        seen = _seen(hashes)
        total = np.full(len(offsets) - 1, bias)
        for a, b in groups(offsets):
            f, doc = features(data, offsets[a : b + 1])
            maybe = seen[f >> np.uint32(12)]
            f, doc = f[maybe], doc[maybe]
            if not len(f):
                continue
            spot = np.minimum(np.searchsorted(hashes, f), len(hashes) - 1)
            hit = hashes[spot] == f
            pairs = np.unique(doc[hit] * len(hashes) + spot[hit])
            total[a:b] += np.bincount(pairs // len(hashes), weights[pairs % len(hashes)], b - a)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return appended(docs, [id_col] if keep is None else keep, text_col, "score", "double", make)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_label: dict[int, int] | None = None, held_out: int | None = 0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """Train on a bounded sample of ``labels`` and score every whole text of ``docs``.

    Null and empty texts score the bias alone; repeated rows come out as often;
    an empty table gives no rows; without labelled rows every score is 0.5.
    """
    ship(docs.sparkSession)
    sampled = _labels.sample(docs, labels, label_col, per_label or PER_LABEL, held_out, id_col, text_col)
    return score(docs, train(sampled, **options), id_col, text_col, keep)
