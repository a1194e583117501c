"""SimHash near copies against comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from pluvial.llm import anchor_dedup, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, limit=3):
    """Smallest id by row, for rows (id, fingerprint)."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= limit:
                root[find(x)] = find(y)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, f"{p:016x}", least.get(find(p))) for i, p in prints]


def test_the_code_covers_and_has_one_home_for_each():
    assert anchor_dedup.syndrome(np.array([anchor_dedup.GENERATOR]))[0] == 0
    _, _, count = anchor_dedup.patterns(3)
    assert (count[:, 0] == 1).all() and count.sum() == 145499  # words of up to 6 of 23 bits
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    (x1, x2), (y1, y2) = anchor_dedup._parts(x), anchor_dedup._parts(y)
    who, first, left = anchor_dedup.visits(y1, np.full(len(y), 3), 3)
    again, second, _ = anchor_dedup.visits(y2[who], left, 3)
    goes = set(zip(who[again].tolist(), first[again].tolist(), second.tolist(), strict=True))
    assert all(a in goes for a in zip(range(len(x)), anchor_dedup.home(x1).tolist(), anchor_dedup.home(x2).tolist(), strict=True))
    assert len(goes) == len(again) and 250 < len(again) / len(x) < 350 and 68 < len(who) / len(x) < 74


def test_links_become_a_forest():
    a, b = anchor_dedup.joined(np.array([5, 9, 4, 7]), np.array([9, 4, 5, 8]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 4), (8, 7), (9, 4)]


def prints_with_neighbours(n, seed):
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1, 1]
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            out.append(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize(("limit", "tile"), [(3, 2048), (3, 2), (0, 2048), (1, 1), (4, 2048)])
def test_components_equal_all_pairs(spark, monkeypatch, limit, tile):
    monkeypatch.setattr(anchor_dedup, "RESIDENTS", tile)
    monkeypatch.setattr(anchor_dedup, "GUESTS", tile * 8)
    monkeypatch.setattr(anchor_dedup, "PAIRS", 64)
    prints = [(i, p) for i, p in enumerate(prints_with_neighbours(400, limit))]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints]
    monkeypatch.setattr(anchor_dedup, "fingerprints", lambda docs, *_: docs)
    got = anchor_dedup.dedup(spark.createDataFrame(rows, "doc_id long, fp long"), limit)
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(prints, limit))


def texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["Ärger", "日本語", "Don't"]
    out = [None, "", " \t\n", "one", "Two words", "two WORDS", "A b C", "a b c", "x" * 4000]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 300, 2000]))]
        for edits in (0, 0, 1, 1, 2, 4):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = "new"
            out.append(" ".join(own))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "n", 1) for i, t in enumerate(texts())] + [(None, "nobody has this text", "n", 1), (None, "one", "n", 1), (3, "one", "n", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string, anchor int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_simhash_anchors(spark, str(tmp_path)).collect()]
    want = brute_components([(r[0], brute_print(r[1])) for r in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 3 < len({r[2] for r in want}) < len(want) - 20


def test_nothing_and_long_texts(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert anchor_dedup.dedup(empty).count() == 0
    text = " ".join(f"w{i % 977}" for i in range(20000))
    whole = anchor_dedup.fingerprint(text.encode())
    monkeypatch.setattr(anchor_dedup, "SHINGLES", 1000)
    assert anchor_dedup.fingerprint(text.encode()) == whole == brute_print(text)
    with pytest.raises(ValueError):
        anchor_dedup.dedup(empty, 5)
