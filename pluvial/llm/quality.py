"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, its triples of bytes with letters and scripts as
they are (but A-Z lower-cased and digits alike) and its triples of character
classes (letters by case, digits, others as themselves), each kind hashed to a
number of places of its own, and statistics of its words, each cut into steps:
share of distinct words, share of the commonest word, words, their mean length
and words a line. Counts grow as 1 + log, are weighted by rarity and scaled to
unit length; a truncated singular value decomposition of the labelled sample
gives the latent space. Each document meets all labelled vectors in blocked
products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _labels
from ._shared import appended, ship, text_bytes
from ._words import _SPACE, document_of, groups, word_hashes

#: Most labelled documents of each label that are kept as neighbours.
PER_LABEL = {0: 4_000, 1: 8_000}
SHAPES, SPELLED, WORDS = 512, 1024, 1024
PLACES, STEPS, RANK, NEIGHBOURS, BLOCK = SHAPES + SPELLED + WORDS, 12, 48, 25, 512
#: Weight of words and spelled triples beside shapes, chosen on fold 1 with folds 2 to 4 to learn from.
SPELLING = 0.35
STATS = 5
DIM = PLACES + STATS * STEPS

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = _CLASS[128:256] = 97
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[48:58] = 48
_LETTER[65:91] = _LETTER[97:123]


def _triples(c: np.ndarray, places: int) -> np.ndarray:
    """The place of each three neighbouring values."""
    return ((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(places)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of term weights for each document of the range: 1 + log of counts, and the steps of the statistics."""
    n = len(offsets) - 1
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    lens = np.diff(at)
    doc = np.repeat(np.arange(n), lens)
    words, per_doc = word_hashes(data, offsets)
    of = document_of(per_doc)
    same = doc[:-2] == doc[2:]
    within = doc[:-2][same]
    out = np.empty((n, DIM), np.float32)
    kinds = (
        (SHAPES, 1, within, _triples(_CLASS[raw], SHAPES)[same]),
        (SPELLED, SPELLING, within, _triples(_LETTER[raw], SPELLED)[same]),
        (WORDS, SPELLING, of, words % np.uint64(WORDS)),
    )
    begin = 0
    for places, weight, owner, place in kinds:
        found = np.bincount(owner * places + place.astype(np.int64), minlength=n * places).reshape(n, places)
        out[:, begin : begin + places] = np.log1p(found) * weight
        begin += places
    out[:, PLACES:] = 0
    order = np.lexsort((words, of))
    w, d = words[order], of[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(w)))
    distinct = np.bincount(d[new], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, d[new], runs)
    some = np.maximum(per_doc, 1)
    lines = np.bincount(doc[raw == 10], minlength=n) + 1
    size = np.bincount(doc[~_SPACE[raw]], minlength=n)
    # the words of a text grow more slowly than the text: compare with its square root too
    stats = [
        distinct / some * STEPS,
        np.log2(some / np.maximum(most, 1)) * 1.5,
        np.log2(some),
        size / some,
        np.log2(some / lines + 1) * 1.5,
    ]
    scale = np.sqrt(np.einsum("ij,ij->i", out, out)) * 0.35 + 1e-3
    for k, s in enumerate(stats):
        step = np.clip(s, 0, STEPS - 1).astype(int)
        out[np.arange(n), PLACES + k * STEPS + step] = scale
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def decompose(x: np.ndarray, rank: int, rounds: int = 5) -> np.ndarray:
    """The leading right singular vectors (columns), by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(17).standard_normal((x.shape[1], min(rank + 12, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v[:rank].T).astype(np.float32)


def fit(sampled: DataFrame) -> dict:
    """The model from ``_labels.sample``'s rows: term weights, latent axes, and labelled vectors."""

    def featurize(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out = [r.tobytes() for a, b in groups(offsets) for r in counts(data, offsets[a : b + 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["place", "label", "row"])

    def learn(batches):
        rows = sorted((p, r, y) for batch in batches for p, y, r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not rows:
            return
        x = np.empty((len(rows), DIM), np.float32)
        for k, (_, r, _) in enumerate(rows):
            x[k] = np.frombuffer(r, np.float32)
        y = np.asarray([y for *_, y in rows], np.float32)
        del rows
        idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        x *= idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)
        axes = decompose(x, RANK)
        yield pa.RecordBatch.from_pydict({k: [v.astype(np.float32).tobytes()] for k, v in (("idf", idf), ("axes", axes), ("vectors", _unit(x @ axes)), ("labels", y))})

    found = sampled.select("place", "label", "text").mapInArrow(featurize, "place bigint, label int, row binary").repartition(1).mapInArrow(learn, "idf binary, axes binary, vectors binary, labels binary").collect()
    if not found:
        return {}
    got = {k: np.frombuffer(v, np.float32) for k, v in found[0].asDict().items()}
    got["axes"] = got["axes"].reshape(DIM, -1)
    got["vectors"] = got["vectors"].reshape(len(got["labels"]), -1)
    return got


def vote(x: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of term rows: labels of the nearest, each with weight max(cosine, 0)^4, and the sample's mean as one weak vote."""
    mean = model["labels"].mean()
    out = np.empty(len(x))
    k = min(neighbours, len(model["labels"]))
    turned = np.ascontiguousarray(model["vectors"].T)
    for a in range(0, len(x), BLOCK):
        near = _unit((_unit(x[a : a + BLOCK] * model["idf"])) @ model["axes"]) @ turned
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 4
        out[a : a + BLOCK] = ((w * model["labels"][best]).sum(axis=1) + 1e-3 * mean) / (w.sum(axis=1) + 1e-3)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns ``keep``) and ``score``, the weighted share of label 1 among the nearest.

    Null and empty texts are scored as texts without terms; rows that repeat
    come out as often; without labelled rows every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PER_LABEL

    def make(data, offsets):
        m = shared.value
        s = np.full(len(offsets) - 1, 0.5)
        for a, b in groups(offsets) if m else ():
            s[a:b] = vote(counts(data, offsets[a : b + 1]), m)
        return s

    return appended(docs, [id_col] if keep is None else keep, text_col, "score", "double", make)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_label: dict[int, int] | None = None, held_out: int | None = 0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fit on a bounded sample of ``labels`` and score every whole text of ``docs``.

    Null and empty texts are scored as texts without terms; repeated rows come
    out as often; an empty table gives no rows; without labelled rows every
    score is 0.5. Rows without label, id or text in the sample's fold take no
    part in fitting.
    """
    ship(docs.sparkSession)
    sampled = _labels.sample(docs, labels, label_col, per_label or PER_LABEL, held_out, id_col, text_col)
    return score(docs, fit(sampled), id_col, text_col, keep)
