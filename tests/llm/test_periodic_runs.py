"""Runs of words against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pluvial.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, exponent=3):
    """(start, end, smallest period) of all runs, by comparing at every distance."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def wanted(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    runs = brute(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in runs)]
    best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *head, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(kept)))


def sequences(rng):
    k = rng.choice([1, 2, 3, 5])
    yield [rng.randrange(k) for _ in range(rng.randrange(1, 200))]
    piece = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
    yield [7] * rng.randrange(9) + (piece * 9)[: rng.randrange(1, 200)] + [8] * rng.randrange(9)
    x = [0] * rng.randrange(1, 30) + [1]
    yield x * rng.randrange(1, 9) + [2] + x * rng.randrange(1, 9)
    y = [rng.randrange(2) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 6) + [3]
    yield (y * rng.randrange(1, 6) + [0]) * rng.randrange(1, 4)
    a, b = [0], [0, 1]
    for _ in range(rng.randrange(1, 9)):
        a, b = b, b + a
    yield b * rng.randrange(1, 4)


@pytest.mark.parametrize("seed", range(25))
def test_catchers_find_all_runs_however_words_come(seed):
    rng = random.Random(seed)
    for w in sequences(rng):
        for least in (1, 24):
            for step in {len(w), 1, rng.randrange(1, 50)}:
                caught, squares = periodic_runs.Catchers(), []
                for i in range(0, len(w), step):
                    squares += caught.append(np.array(w[i : i + step]))
                assert [tuple(r) for r in caught.runs(least).tolist()] == brute(w, least)
                assert len(set(squares)) == len(squares) and all(w[s : s + q] == w[s + q : s + 2 * q] for q, s in squares)


def test_a_square_is_reported_with_its_last_word():
    caught = periodic_runs.Catchers()
    told = [caught.append(np.array([x])) for x in [5, 1, 2, 3, 1, 2, 3, 1]]
    assert told == [[], [], [], [], [], [], [(3, 1)], []]


def test_state_stays_linear():
    caught = periodic_runs.Catchers()
    for _ in range(40):
        caught.append(np.random.default_rng(1).integers(0, 9, 1000))
    assert sum(len(x) for x in caught.names) <= 6 * len(caught.words)


def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(50)] + ["Ärger", "日本", "W1", "w1"]
    out = [None, "", " \t\r\n\x0b\x0c", "one", "a b " * 40, "x " * 23, "x " * 24, " em space " * 30, "A a " * 12, " ".join(rng.choice(vocab) for _ in range(3000))]
    for _ in range(60):
        piece = [rng.choice(vocab) for _ in range(rng.randrange(1, 30))]
        out.append(" \n".join([rng.choice(vocab) for _ in range(rng.randrange(30))] + piece * rng.randrange(1, 6) + [rng.choice(vocab) for _ in range(rng.randrange(30))]))
    out.append("p q r " * 11 + "mid " + "s t " * 14 + "end")
    return out + out[-5:]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", "s") for i, t in enumerate(texts() * 3)] + [(None, "z z " * 30, "s", "s")] + [(4, "a b " * 40, "s", "s")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, id string").repartition(3)


def test_query_equals_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted((wanted(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert any(r[1] > 1 for r in got) and any(r[1] == 0 for r in got)


def test_real_outputs_and_small_chunks(docs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 37)
    for r in periodic_runs.find(docs, least=6).collect():
        assert list(r.asDict()) == ["doc_id", "n_words", "runs", "collapsed"]
        text = r.collapsed.split(" ")
        assert not r.runs or len(text) < r.n_words
    assert periodic_runs.find(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find(docs, exponent=2)


def test_query_covers_its_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text) < 6000:
            assert got[r.doc_id] == wanted(r.doc_id, r.text)
