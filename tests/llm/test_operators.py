"""The corpus operators against brute force, on texts that are null, empty, long, repeated, or in odd company."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pluvial.llm import (_components, _labels, _regions, _words, byte_bpe, jaccard_join, kneser_ney, mixing, quality, queries, rabitq, token_blocks, token_counts, toxicity, uniform_topk)
from tests.oracle import ordered, sql_rows

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ["label", "score", "node", "region", "size", "hits", "key", "n", "copies", "taken", "block", "place", "c0", "own"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def near(rng, base, edits):
    own = list(base)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
    return " ".join(own)


def odd_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "日本語", "don't", "<|endoftext|>", "it's!!"]
    out = [None, "", " ", "\n\t ", "one", "two words", "A b C d", "a b c d e", "A  b c   d\r\n\r\n e ", " lead", "trail ", "x" * 3000, " ".join(rng.choice(vocab) for _ in range(30000))]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        out += [" ".join(base)] * 2 + [near(rng, base, e) for e in (1, 2, 5, 12)]
    return out + ["one", "a b c d e"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "é", ""][i % 5], 1, *["z"] * len(CLASH)) for i, t in enumerate(odd_texts())]
    rows += [(None, "null id here " * 9, "en", "a", 1, *["z"] * len(CLASH)), rows[20], rows[20]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- words


def test_word_hashes_follow_words():
    texts = [t or "" for t in odd_texts()]
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    parts = [_words.word_hashes(data, ends[a : b + 1], (2,)) for a, b in _words.groups(ends, 500, 3)]
    hashes, counts, stems = (np.concatenate(x) for x in zip(*parts))
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len({*zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))
    assert all((s == 0) == (len(w.encode()) <= 2) for w, s in zip(flat, stems.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (7, 7)]
    found = {r.node: r.root for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert _components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 and 6: classifiers


@pytest.mark.parametrize("module, label, line, least", [(toxicity, "toxic", 0.5, 0.9), (quality, "quality", 0.3, 0.95)])
def test_classifier_on_held_out_rows(spark, docs, none, module, label, line, least):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = module.classify(table, labels).join(labels, "doc_id").where(_labels.fold(F.col("doc_id")) == 0).cache()
    right = scored.where((F.col("score") >= line).cast("int") == F.col(label)).count() / scored.count()
    assert right >= least
    assert scored.where("score < 0 or score > 1").count() == 0
    own = labels.where("doc_id < 0")  # nothing labelled
    found = module.classify(docs, own).collect()
    assert len(found) == docs.count() and len({r.score for r in found}) == 1
    assert module.classify(none, labels).count() == 0
    kept = module.classify(docs, labels.limit(50), keep=docs.columns)
    assert kept.columns == [*docs.columns, "score"] or set(docs.columns) <= set(kept.columns)
    assert kept.count() == docs.count()


def test_ftrl_against_a_scalar_version(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))) for i in range(60)] + [(60, None), (61, "")]
    labels = [(i, int("w3" in (t or "").split())) for i, t in docs]
    df, own_labels = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")

    def terms(t):
        data, ends = np.frombuffer((t or "").encode(), np.uint8), np.asarray([0, len((t or "").encode())])
        return set(toxicity.features(data, ends)[0].tolist())

    place = {r.doc_id: r.p for r in df.select("doc_id", F.xxhash64("doc_id").alias("p")).collect()}
    rows = sorted((place[i], terms(t), y) for (i, t), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5)
    often = collections.Counter(f for _, own, _ in rows for f in own)
    z, n = collections.Counter(), collections.Counter()
    weight = lambda f: 0.0 if abs(z[f]) <= 2 else -(z[f] - math.copysign(2, z[f])) / ((1 + math.sqrt(n[f])) / 0.5 + 0.1)
    for _ in range(4):
        for _, own, y in rows:
            own = [f for f in own if often[f] >= 3] + ["bias"]
            g = 1 / (1 + math.exp(-sum(weight(f) for f in own))) - y
            for f in own:
                s = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / 0.5
                z[f] += g - s * weight(f)
                n[f] += g * g
    got = {r.doc_id: r.score for r in toxicity.classify(df, own_labels).collect()}
    assert any(weight(f) for f in often)
    for i, t in docs:
        assert math.isclose(got[i], 1 / (1 + math.exp(-weight("bias") - sum(weight(f) for f in terms(t)))), rel_tol=1e-6)


def test_votes_against_all_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(_labels.sample(docs, labels, "quality", {0: 60, 1: 90}, 0))
    some = docs.limit(40)
    got = {r.doc_id: r.score for r in quality.score(some, model).collect()}
    unit = lambda v: v / max(math.sqrt(float(v @ v)), 1e-12)
    for r in some.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        own = unit(unit(quality.counts(data, np.asarray([0, len(data)]))[0].astype(float) * model["idf"]) @ model["axes"])
        votes = sorted(((max(float(own @ v), 0) ** 4, y) for v, y in zip(model["vectors"].astype(float), model["labels"].tolist())), reverse=True)[: quality.NEIGHBOURS]
        want = (sum(w * y for w, y in votes) + 1e-3 * model["labels"].mean()) / (sum(w for w, _ in votes) + 1e-3)
        assert math.isclose(got[r.doc_id], want, abs_tol=2e-3)


def plain_terms(text):
    """The terms of one text, in plain Python: places by kind, then the steps of the statistics."""
    raw = text.encode()
    shape = [97 if b >= 128 or 97 <= b < 123 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in raw]
    spelled = [b + 32 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in raw]
    own = words(text)
    name = lambda w: int(_words.word_hashes(np.frombuffer(w.encode(), np.uint8), np.asarray([0, len(w.encode())]))[0][0])
    triple = lambda c, places: [(((c[i] << 16 | c[i + 1] << 8 | c[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 12) % places for i in range(len(c) - 2)]
    out = []
    for places, weight, found in ((quality.SHAPES, 1, triple(shape, quality.SHAPES)), (quality.SPELLED, quality.SPELLING, triple(spelled, quality.SPELLED)), (quality.WORDS, quality.SPELLING, [name(w) % quality.WORDS for w in own])):
        often = collections.Counter(found)
        out += [weight * math.log1p(often[k]) for k in range(places)]
    scale = math.sqrt(sum(v * v for v in out)) * 0.35 + 1e-3
    n, most = max(len(own), 1), max(collections.Counter(own).values(), default=0)
    stats = [len(set(own)) / n * quality.STEPS, math.log2(n / max(most, 1)) * 1.5, math.log2(n), sum(len(w.encode()) for w in own) / n, math.log2(n / (raw.count(b"\n") + 1) + 1) * 1.5]
    for s in stats:
        out += [scale * (k == int(min(max(s, 0), quality.STEPS - 1))) for k in range(quality.STEPS)]
    return out


def test_terms_against_plain_ones():
    sentence = "The committee has published a careful report on river water quality and its causes."
    rng = random.Random(5)
    shuffled = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if c.islower() else c for c in sentence)
    texts = [sentence, shuffled, "мир дом", "кот лес", "", " ", "a", "ab", "é" * 4, "Go go GO 12 1999\n\nlines\tand, signs!!", "x" * 5000, sentence * 50]
    data = [t.encode() for t in texts]
    got = quality.counts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert np.allclose(got, [plain_terms(t) for t in texts], rtol=1e-4, atol=1e-5)
    spelled = slice(quality.SHAPES, quality.PLACES)
    for a, b in ((0, 1), (2, 3)):
        assert np.array_equal(got[a, : quality.SHAPES], got[b, : quality.SHAPES])
        x, y = got[a, spelled], got[b, spelled]
        assert x @ y < 0.5 * math.sqrt(x @ x * (y @ y))


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    rows = _labels.sample(docs, labels, "toxic", {0: 10, 1: 5}, 0).collect()
    assert collections.Counter(r.label for r in rows) == {0: 10, 1: 5}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    often = docs.unionByName(docs.selectExpr("doc_id", "concat('s', doc_id) AS text")).unionByName(docs.selectExpr("doc_id", "CAST(NULL AS string) AS text")).repartition(5)
    again = _labels.sample(often, labels, "toxic", {0: 10, 1: 5}, 0).collect()
    assert {(r.doc_id, r.label, r.text) for r in again} == {(r.doc_id, r.label, f"s{r.doc_id}") for r in rows} and len(again) == 15


# ---- 2 and 4: vectors


def vectors(spark, rng, n=700):
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)], "z", 1) for i in range(n)]
    rows += [(1000, None, "z", 1), (1020, [0.0] * 24, "z", 1), (1040, [1.0, None] + [0.0] * 22, "z", 1), (1060, [float("nan")] * 24, "z", 1), (1080, [float("inf")] * 24, "z", 1), (None, [1.0] * 24, "z", 1)]
    rows += [(1100 + i, rows[5][1], "z", 1) for i in range(30)] + [(2000, [0.5, 0.5], "z", 1), (2001, [0.25, 0.5], "z", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string, score int").repartition(3), rows


@pytest.mark.parametrize("module, integer", [(rabitq, False), (uniform_topk, True)])
def test_vector_search(spark, module, integer):
    df, rows = vectors(spark, np.random.default_rng(3))
    found = collections.defaultdict(list)
    for r in module.search(df, lambda i: i % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = [(i, np.asarray(v, float)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (integer or any(v))]
    if integer:
        fine = [(i, np.floor(64 * v).astype(np.int64)) for i, v in fine]
    for i, v in fine:
        if i % 20 == 0:
            best = sorted((-(v @ w).item(), j) for j, w in fine if j != i and len(w) == len(v))[:20]
            got = found.pop(i)
            assert [g[0] for g in got] == list(range(1, len(best) + 1))
            assert [g[1] for g in got] == [j for _, j in best]
            assert np.allclose([g[2] for g in got], [-s for s, _ in best], rtol=0, atol=0 if integer else 1e-9)
    assert not found
    assert module.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e37, 1e-200])
def test_codes_choose_at_any_magnitude(scale):
    """Scores of meeting blocks equal brute force, also where estimates overflow or lengths vanish."""
    from pluvial.llm import _vectors

    x = np.random.default_rng(1).standard_normal((900, 12)) * scale
    ids, q = np.arange(900), 60
    best, meet = _vectors.Best(q, 20, np.float64), rabitq._meet(20, rabitq.EPSILON)
    with np.errstate(all="ignore"):
        for a in range(0, 900, 300):
            made = {k: v.tobytes() for k, v in rabitq.pack(x[a : a + 300]).items()}
            meet(best, {"dim": 12, "q_ids": ids[:q].tobytes(), "q_raw": x[:q].tobytes(), "ids": ids[a : a + 300].tobytes(), **made})
    every = x[:q] @ x.T
    every[np.arange(q), np.arange(q)] = -np.inf
    top = np.sort(every, axis=1)[:, ::-1][:, :20]
    np.testing.assert_allclose(best.scores.reshape(q, 20), top, rtol=1e-12)


def test_large_integers_stay_exact():
    q, c = np.asarray([[1 << 26, 3]]), np.asarray([[1 << 26, 1], [(1 << 26) + 1, -7]])
    assert uniform_topk.partial_scores(q, c).tolist() == [[(1 << 52) + 3, (1 << 52) + (1 << 26) - 21]]


# ---- 3: language model


def test_kneser_ney(spark, docs, none):
    fold = _labels.fold(F.col("doc_id"))
    rows = docs.select("doc_id", "text", (fold != 1).alias("learn")).collect()
    token = lambda t: [*words(t), "\0"]
    count, pairs = collections.Counter(), collections.Counter()
    for r in rows:
        if r.learn:
            count.update(token(r.text))
            pairs.update(zip(["\1", *token(r.text)], token(r.text)))
    total, size = sum(count.values()), len(count)
    follows = collections.Counter(w for _, w in pairs)
    after = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (v, _), n in pairs.items():
        after[v][0] += n
        after[v][min(n, 3)] += 1
    classes = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, e = [0, *kneser_ney.discounts(classes(pairs))], [0, *kneser_ney.discounts(classes(follows))]
    kinds = [sum(1 for x in follows.values() if min(x, 3) == k) for k in (1, 2, 3)]
    hand = sum(a * b for a, b in zip(e[1:], kinds)) / len(pairs)
    low = lambda w: (follows[w] - e[min(follows[w], 3)]) / len(pairs) + hand / (size + 1)

    def p(v, w):
        if v not in after:
            return low(w)
        t, n = after[v], pairs[v, w]
        return (n - d[min(n, 3)] + sum(d[k] * t[k] for k in (1, 2, 3)) * low(w)) / t[0]

    assert abs(sum(p("w1", w) for w in count) + hand / (size + 1) * sum(d[k] * after["w1"][k] for k in (1, 2, 3)) / after["w1"][0] - 1) < 1e-9
    got = collections.defaultdict(list)
    for r in kneser_ney.train_and_score(docs, fold != 1).collect():
        got[r.doc_id].append(r)
    for r in rows:
        x = got[r.doc_id][0]
        own = token(r.text)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(count[w] > 0 for w in own), total)
        assert math.isclose(x.base_score, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (size + 1))) for w in own), rel_tol=1e-9)
        assert math.isclose(x.score, sum(math.log10(p(v, w)) for v, w in zip(["\1", *own], own)), rel_tol=1e-9)
    assert kneser_ney.train_and_score(none, fold != 1).count() == 0
    unseen = kneser_ney.train_and_score(docs, F.lit(False)).collect()
    assert len(unseen) == len(rows) and all(math.isfinite(r.score) and r.n_known == 0 for r in unseen)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_orders(spark, docs, none, order):
    fold = _labels.fold(F.col("doc_id"))
    often = spark.createDataFrame([(1000 + i, "often so often as", "en", "a", 1, *["z"] * len(CLASH)) for i in range(300)], SCHEMA)
    docs = docs.unionByName(often)
    rows = docs.select("doc_id", "text", (fold != 1).alias("learn")).collect()
    token = lambda t: [*words(t), "\0"]

    def grams(t, k):
        own = ["\1"] * (k - 1) + token(t)
        return [tuple(own[i : i + k]) for i in range(len(own) - k + 1)]

    adjusted = {order: collections.Counter(g for r in rows if r.learn for g in grams(r.text, order))}
    for k in range(order - 1, 0, -1):
        adjusted[k] = collections.Counter()
        for g, n in adjusted[k + 1].items():
            adjusted[k][g[1:]] += n if g[1] == "\1" else 1
    d, after = {}, {}
    for k, c in adjusted.items():
        d[k] = [0, *kneser_ney.discounts([sum(x == i for x in c.values()) for i in (1, 2, 3, 4)])]
        after[k] = collections.defaultdict(lambda: [0, 0.0])
        for g, n in c.items():
            after[k][g[:-1]][0] += n
            after[k][g[:-1]][1] += d[k][min(n, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(adjusted[1]) + 1)
        total, taken = after[k].get(g[:-1], (0, 0))
        n = adjusted[k][g]
        return (n - d[k][min(n, 3)] + taken * p(g[1:])) / total if total else p(g[1:])

    some = next(g for g, n in adjusted[order].items() if n > 1 and "\1" not in g)[:-1]
    assert abs(sum(p((*some, *w)) for w in adjusted[1]) + p((*some, "never seen")) - 1) < 1e-9
    got = {r.doc_id: r for r in kneser_ney.train_and_score(docs, fold != 1, order=order).collect()}
    for r in rows:
        assert math.isclose(got[r.doc_id].score, sum(math.log10(p(g)) for g in grams(r.text, order)), rel_tol=1e-9)
    assert kneser_ney.train_and_score(none, fold != 1, order=order).count() == 0
    unseen = kneser_ney.train_and_score(docs, F.lit(False), order=order).collect()
    assert len(unseen) == len(rows) and all(math.isfinite(r.score) and r.n_known == 0 for r in unseen)


def test_words_count_by_all_bits(monkeypatch, tmp_path):
    monkeypatch.setattr(kneser_ney, "HASH_BYTES", 1)  # n-grams may merge, words may not
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}" for i in range(500)), "w1 w1"])], ["text"])
    rows = pa.Table.from_batches(list(kneser_ney._counts(1)(iter([batch]))))
    found = kneser_ney._merge_counts(str(tmp_path))(rows).to_pylist()
    assert [(r["tokens"], sum(r["classes"])) for r in found] == [(504, 501)]  # with the end
    starts = {0: np.cumsum([2, *found[0]["classes"][:-1]])}
    list(kneser_ney._name_words(str(tmp_path), starts)(iter([pa.RecordBatch.from_arrays([pa.array([0, 1])], ["id"])])))
    model = kneser_ney.Model({"place": str(tmp_path), "n_words": 1, "files": {"counts-000000", "ids-000000"}})
    data, ends = np.frombuffer(b"w1 w7 never seen", np.uint8), np.asarray([0, 16])
    ids, counts = model.words(kneser_ney.tokens(data, ends)[0])
    assert counts.tolist() == [3, 1, 0, 0, 2] and ids[2] == ids[3] == 0
    assert {ids[0], ids[4]} == {2, 3} and ids[1] > 3  # frequent words have the smaller ids


def test_long_contexts_are_not_read_whole(spark, docs, tmp_path, monkeypatch):
    many = spark.createDataFrame([(i, f"so often x{i}", "en", "a", 1, *["z"] * len(CLASH)) for i in range(3000)], SCHEMA)
    model = kneser_ney.train(docs.unionByName(many), folder=f"file://{tmp_path}/m", order=3)
    read, get = [], kneser_ney.Bytes.__getitem__
    monkeypatch.setattr(kneser_ney.Bytes, "__getitem__", lambda self, at: read.append(np.size(at)) or get(self, at))
    token, ends = kneser_ney.tokens(np.frombuffer(b"so often x7", np.uint8), np.asarray([0, 11]))
    assert np.isfinite(kneser_ney.Model(model).score(token, ends)[0]).all()
    assert 0 < sum(read) < 200  # all 3,000 counts before


@pytest.mark.parametrize("size", [4, 1])
def test_gram_files_hold_every_count(monkeypatch, tmp_path, size):
    monkeypatch.setattr(kneser_ney, "HASH_BYTES", size)
    rng = np.random.default_rng(3)
    u, v, w = (rng.integers(0, n, 60_000).astype(np.uint64) for n in (400, 200, 4000))
    u[:9000], v[:9000], v[9000:9400], w[9000:9400] = 1, 2, 7, 9  # one context of many words, one n-gram of a large count
    u[9000:9400] = 3
    plain = collections.Counter(zip(u.tolist(), v.tolist(), w.tolist()))
    half = [kneser_ney._blocks(*kneser_ney._distinct([x[at] for x in (u, v, w)]), 1) for at in (slice(0, 30_000), slice(30_000, None))]
    table = pa.concat_tables([pa.table(x, names=["bucket", "contexts", "words", "notes"]) for x in half])
    kneser_ney._merge_grams(str(tmp_path), 3, 2, 8)(table)
    model = kneser_ney.Model({"place": str(tmp_path), "n_grams": 1, "width": 2, "files": {"grams-3-000000"}})
    contexts = sorted({g[:2] for g in plain}) + [(50, 50)]
    place = {c: i for i, c in enumerate(contexts)}
    asked = [*plain, (1, 2, 5000), (50, 50, 1)]
    d = np.asarray([0, 0.5, 0.75, 1.25])
    count, total, taken = model.gram_stats([np.asarray(x, np.uint64) for x in zip(*contexts)], np.asarray([place[g[:2]] for g in asked]), np.asarray([g[2] for g in asked], np.uint64), d)
    sums, takes = collections.Counter(), collections.Counter()
    for g, n in plain.items():
        sums[g[:2]] += n
        takes[g[:2]] += d[min(n, 3)]
    if size == 4:
        assert count.tolist() == [plain[g] for g in asked]
        assert total.tolist() == [sums[g[:2]] for g in asked] and taken.tolist() == [takes[g[:2]] for g in asked]
    else:  # 40,000 contexts share 27 bits: some are taken for one, whose words stay in order
        assert (count > 0)[: len(plain)].all() and (total[: len(plain)] >= [sums[g[:2]] for g in plain]).all()
        assert (total[: len(plain)] > [sums[g[:2]] for g in plain]).any()


def test_pairs_that_share_many_bits_keep_their_counts(tmp_path, monkeypatch):
    w = np.arange(2, 4_000_000, dtype=np.uint64)
    key = kneser_ney.combine(np.full(len(w), 78, np.uint64), w)
    order = np.argsort(key)
    close = np.flatnonzero(np.diff(key[order] >> np.uint64(24)) == 0)  # the same first 40 bits
    assert len(close)
    ids = np.sort(w[order[close[0] : close[0] + 2]])
    v = np.full(2, 78, np.uint64)
    monkeypatch.setattr(kneser_ney, "pair_bucket", lambda v, w, n: np.zeros(len(v), np.int32))
    block = kneser_ney._blocks([v, ids], np.asarray([1, 2]), 8)
    kneser_ney._merge_pairs(str(tmp_path), 4)(pa.table(block, names=["bucket", "contexts", "words", "notes"]))
    model = kneser_ney.Model({"place": str(tmp_path), "n_pairs": 8, "files": {"pairs-000000"}})
    assert model.pair_counts(v, ids).tolist() == [1, 2]


def test_lost_model_file_is_an_error(spark, docs, tmp_path):
    model = kneser_ney.train(docs, folder=f"file://{tmp_path}/m", order=3)
    assert {p.name for p in (tmp_path / "m").iterdir()} == model["files"]
    token, ends = kneser_ney.tokens(np.frombuffer(b"w1 w2 w3 w4", np.uint8), np.asarray([0, 11]))
    assert np.isfinite(kneser_ney.Model(model).score(token, ends)[0]).all()
    for kind in ("counts", "ids", "words", "pairs", "grams"):
        hidden = {p: p.rename(tmp_path / p.name) for p in (tmp_path / "m").glob(f"{kind}-*")}
        with pytest.raises(FileNotFoundError):
            kneser_ney.Model(model).score(token, ends)
        for p, q in hidden.items():
            q.rename(p)


# ---- 5 and 7: tokens


@pytest.mark.parametrize("values", [[], [7], [0] * 500, list(range(1000)), [3, 2**32 - 1] * 100, [5] * 127 + [60000]])
def test_blocks_round_trip(values):
    x = np.asarray(values, np.uint32)
    if len(x):
        assert (token_blocks.unpack(*token_blocks.pack(x)) == x).all()


def test_random_blocks_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 7, 16, 31):
        x = (rng.integers(0, 1 << bits, 5000) * (rng.random(5000) < 0.9) + (rng.random(5000) < 0.05) * 12345).astype(np.uint32)
        assert (token_blocks.unpack(*token_blocks.pack(x)) == x).all()


def test_token_files(spark, docs, none, tmp_path):
    import public_tokenizers as vocab
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    manifest = token_blocks.write(docs, vocab.path("byte_bpe_50k.json"), folder=f"file://{tmp_path}/tokens")
    rows = token_blocks.read(spark, manifest, with_ids=True).collect()
    assert len(rows) == docs.count()
    texts = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    for own in texts.values():
        own.sort(key=lambda t: (t is not None, t), reverse=True)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == tok.encode(texts[r.doc_id].pop() or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids))
        at += len(ids)
    twice = token_blocks.read(spark, token_blocks.write(docs.repartition(7), vocab.path("byte_bpe_50k.json"), folder=f"file://{tmp_path}/again"), with_ids=True).collect()
    assert sorted(map(tuple, twice), key=lambda r: r[1]) == sorted(map(tuple, rows), key=lambda r: r[1])
    assert any(50256 in np.frombuffer(r.ids, "<u4") for r in rows)  # <|endoftext|> in a text, by the library's default
    with pytest.raises(ValueError):
        token_blocks._encoder(vocab.path("word_bpe_49k.json"))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    empty = token_blocks.write(none, vocab.path("byte_bpe_50k.json"), folder=f"file://{tmp_path}/none")
    assert token_blocks.read(spark, empty).count() == 0


def test_byte_bpe(docs, none, monkeypatch):
    import public_tokenizers as vocab
    import tiktoken

    path = vocab.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_bpe.encode_decode(docs, path, vocab.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.decoded.decode() == (texts[r.doc_id] or "")
    assert byte_bpe.digests(byte_bpe.encode_decode(none, path, vocab.PATTERN)).count() == 0
    for t in texts.values():
        for size in (1, 7, 100):
            assert b"".join(np.asarray(enc.encode_ordinary(p), "<u4").tobytes() for p in byte_bpe.parts(t or "", size)) == np.asarray(enc.encode_ordinary(t or ""), "<u4").tobytes()
    r = byte_bpe.digests(byte_bpe.encode_decode(docs.where("doc_id = 4"), path, vocab.PATTERN)).first()
    assert r.decoded_sha256 == hashlib.sha256(b"one").hexdigest()


def test_batch_encoder_forgets_and_stays_right():
    from pluvial.llm._chunks import BatchEncoder

    texts = [(t or "").encode() for t in odd_texts()]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def by_word(text):  # ids: a token for each byte
        return np.frombuffer(text.encode(), np.uint8).astype(np.uint32)

    coder = BatchEncoder(by_word, np.ones(256, np.int64))
    coder.MOST, coder.JOINED = 200, 64
    for _ in range(2):
        ids, places = coder.encode(data, ends)
        assert ids.tolist() == data.tolist() and places.tolist() == ends.tolist()


# ---- 8: counts


def test_token_counts(docs, none):
    import public_tokenizers as vocab
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = list(token_counts.pieces_of(vocab.path("piece_bpe_32k.model")))
    tok = Tokenizer(models.Unigram([*pieces, ("<unk>", 0.0)], unk_id=len(pieces), byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count(docs, vocab.path("piece_bpe_32k.model")).collect():
        assert r.n_tokens == len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    assert token_counts.count(none, vocab.path("piece_bpe_32k.model")).count() == 0


def test_count_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    rng = random.Random(2)
    for _ in range(60):
        pieces = [(p, float(-rng.randrange(1, 4))) for p in {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(6)} | {"▁"}]
        tok = Tokenizer(models.Unigram([*pieces, ("<unk>", 0.0)], unk_id=len(pieces), byte_fallback=False))
        counter = token_counts.Counter(pieces, byte_fallback=False)
        counter.unknown = min(0.0, min(s for _, s in pieces)) - 10
        for _ in range(20):
            text = "▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            assert counter.count(text) == len(tok.encode(text).ids), (pieces, text)


def test_token_counts_with_runs_of_spaces(spark):
    import public_tokenizers as vocab
    from tokenizers import Tokenizer, models, pre_tokenizers

    def whole(pieces, fallback=True):
        tok = Tokenizer(models.Unigram([*pieces, ("<unk>", min(s for _, s in pieces))], unk_id=len(pieces), byte_fallback=fallback))
        tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        return lambda t: len(tok.encode(t, add_special_tokens=False).ids)

    path, rng = vocab.path("piece_bpe_32k.model"), random.Random(8)
    texts = ["a    b", "if x:\n        y = 1\n        z = 2", "   lead", "trail   ", "     ", "a" + " " * 40 + "b", "▁▁ mark", "\t  \t   é"]
    texts += ["".join(rng.choice(["  ", " ", "   ", "ab", "word", "\n", "日", "\u2003", "(", " " * 17]) for _ in range(40)) for _ in range(40)]
    want = whole(token_counts.pieces_of(path))
    assert (want(texts[0]), want(texts[1])) == (3, 15)
    df = spark.createDataFrame(list(enumerate([*texts, *[t or "" for t in odd_texts()]])), "doc_id long, text string")
    for r in token_counts.count(df, path).join(df, "doc_id").collect():
        assert r.n_tokens == want(r.text), r.text
    for own in ([("▁", -1.0), ("a", -1.0), ("b▁", -1.0), ("▁▁▁", -1.0), ("a▁▁b", -0.5)], [("a", -1.0), ("b", -1.0)]):  # pieces across a cut; a mark that is no piece
        for t in ("a  bab b  a", "c c  c", "b a   b"):
            assert token_counts.Counter(own, byte_fallback=False).text(t) == whole(own, False)(t), (own, t)


# ---- 9: mixing


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r.size for r in rows)
    per = {r.source: r for r in rows}
    assert math.isclose(sum(r.target for r in per.values()), 1.5 * total)
    for s, r in per.items():
        own = [x for x in rows if x.source == s]
        assert r.source_size == sum(x.size for x in own) and r.target <= 2 * r.source_size + 1e-6
        assert all(x.taken == x.copies * x.size <= 2 * x.size for x in own)
        assert sum(x.taken for x in own) <= r.target + 1e-6
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)


def test_mixing_fills_until_nothing_fits(spark):
    rng = random.Random(1)
    short = 0
    for k in range(4):  # two sources: the first takes twice its words, the second what is left
        sizes = [rng.choice([900, 700, 500, 300, 150, 80, 40, 20, 9, 4, 2, 1]) for _ in range(60)]
        rows = [(1000 * k + i, " ".join(["w"] * n), "b") for i, n in enumerate(sizes)] + [(1000 * k + 999, "w " * (sum(sizes) // 7), "a")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        taken = {}
        for rounds in (3, None):
            found = [r for r in mixing.mix(df, rounds=rounds).collect() if r.source == "b"]
            taken[rounds] = sum(r.taken for r in found)
        gap, epochs = found[0].target - taken[None], math.floor(found[0].target / found[0].source_size)
        assert 0 <= gap and not [r for r in found if r.copies == epochs and 0 < r.size <= gap]
        short += taken[3] < taken[None]
    assert short


def test_mixed_rows_with_clashing_names(spark):
    rows = [(i % 7 if i % 5 else None, f"w{i % 11} " * (1 + i % 4), "s", i) for i in range(60)]
    df = spark.createDataFrame(rows, "mix_id long, mix_text string, mix_source string, mix_copies int")
    names = {"id_col": "mix_id", "text_col": "mix_text", "source_col": "mix_source"}
    got = collections.Counter(map(tuple, mixing.mixed_rows(df, **names).collect()))
    assert set(got) <= set(rows) and max(got.values()) <= 2
    assert sum(len(words(r[1])) * n for r, n in got.items()) == sum(r.taken for r in mixing.mix(df, **names).collect())


def test_mixing_without_broadcast(spark, docs, monkeypatch):
    want = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 3)
    assert sorted(map(repr, mixing.mix(docs).collect())) == want


# ---- 10: join


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    first = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted([(k, len(sets[i]), first[root(i)]) for i, (k, _) in enumerate(rows)], key=repr)


def clusters(n=30):
    rng = random.Random(9)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for c in range(n):
        base = [f"c{c}_{rng.randrange(400)}" for _ in range(rng.randrange(8, 120))]
        if c % 3 == 0:
            base = base[:20] + passage + base[20:]
        texts += [" ".join(base)] + [near(rng, base, rng.randrange(1, 6)) for _ in range(rng.randrange(0, 12))]
    return list(enumerate(texts))


@pytest.mark.parametrize("most", [jaccard_join.REGION_MOST, 6])
def test_join_equals_brute_force(spark, docs, most):
    for df in (docs, spark.createDataFrame(clusters(), "doc_id long, text string").repartition(4)):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = sorted([tuple(r) for r in jaccard_join.join(df, region_most=most).collect()], key=repr)
        assert got == brute_components(rows)


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
    return links


@pytest.mark.parametrize("most", [jaccard_join.REGION_MOST, 6])
def test_join_counts_every_link(spark, docs, most):
    rng = random.Random(6)
    base = [f"g{i}" for i in range(200)]
    group = [(i, near(rng, base, rng.randrange(6))) for i in range(40)]
    group += [(100 + i, t) for i, (_, t) in enumerate(group[:5])]  # copies
    for df in (docs, spark.createDataFrame(clusters(), "doc_id long, text string").repartition(4), spark.createDataFrame(group, "doc_id long, text string")):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = jaccard_join.join(df, region_most=most, links=True)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
        want = brute_links(rows)
        found = got.collect()
        assert sorted(((r.doc_id, r.n_links) for r in found), key=repr) == sorted(((k, n) for (k, _), n in zip(rows, want)), key=repr)
        assert sorted([tuple(r)[:3] for r in found], key=repr) == brute_components(rows)
    assert max(want) > 30  # more links than a spanning forest has edges
    assert jaccard_join.join(docs.limit(0), links=True).count() == 0


def test_join_by_shuffles_alone(spark, monkeypatch):
    monkeypatch.setattr(_components, "SMALL", 0)
    monkeypatch.setattr(jaccard_join, "SMALL", 0)
    df = spark.createDataFrame(clusters(8), "doc_id long, text string")
    got = sorted([tuple(r) for r in jaccard_join.join(df).collect()], key=repr)
    assert got == brute_components([tuple(r) for r in df.collect()])


def test_join_of_nothing(none, docs):
    assert jaccard_join.join(none).count() == 0
    assert jaccard_join.join(docs.where("text is null or trim(text) = ''")).where("component_id <> doc_id or n_shingles > 0").count() == 0
    stay = jaccard_join.one_of_each(docs)
    assert stay.columns == docs.columns
    found = by_id(jaccard_join.join(docs))
    assert sorted(r.doc_id for r in stay.where("doc_id is not null").collect()) == sorted({k for k, r in found.items() if k is not None and r.component_id == k})


def pairs_of(sets):
    return {(i, j) for j in range(len(sets)) for i in range(j) for both in [len(np.intersect1d(sets[i], sets[j]))] if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)}


@pytest.mark.parametrize("leaf", [2, 8, 64])
def test_links_within_regions(monkeypatch, leaf):
    monkeypatch.setattr(_regions, "LEAF", leaf)
    monkeypatch.setattr(_regions, "BLOCK", 7)
    monkeypatch.setattr(_regions, "COLUMNS", 16)
    monkeypatch.setattr(_regions, "PAIRS", 50)
    rng = np.random.default_rng(4)
    cut = 0
    for k in range(20):
        sets, passage = [], np.unique(rng.integers(0, 1 << 60, 12, dtype=np.uint64))
        for _ in range(1 + k % 5):
            base = np.unique(rng.integers(0, 1 << 60, rng.integers(5, 60), dtype=np.uint64))
            for _ in range(12):
                own = np.where(rng.random(len(base)) < rng.random() * 0.3, rng.integers(0, 1 << 60, len(base), dtype=np.uint64), base)
                sets.append(np.unique(np.concatenate([own, passage]) if k % 2 else own))
        want, at, held = pairs_of(sets), np.arange(len(sets)), _regions.Sets(sets)
        for found in (_regions.together(f(held, at, 75)) for f in (_regions.links, _regions.direct)):
            assert len(found[0]) == len(want) and {*zip(*(x.tolist() for x in found))} == want
        side = rng.integers(0, 2, len(sets))
        assert {(min(p), max(p)) for p in zip(*(x.tolist() for x in _regions.together(_regions.across(held, side, 75))))} == {(i, j) for i, j in want if side[i] != side[j]}
        top = _regions.join_region(sets)
        up = list(range(len(sets)))
        for i, j in want:
            up = [up[j] if u == up[i] else u for u in up]
        assert len({*zip(up, top.tolist())}) == len(set(up)) == len(set(top.tolist()))
        earlier = [np.asarray(rng.choice(6, rng.integers(0, 3), replace=False)) for _ in sets]
        i, j = (np.asarray(x, int) for x in zip(*want))
        assert _regions.unseen(earlier, i, j).tolist() == [not set(earlier[a].tolist()) & set(earlier[b].tolist()) for a, b in zip(i, j)]
        cut += 2 * (_regions.cells(held, at, 75).sum(axis=1) ** 2).sum() <= len(sets) ** 2
    assert cut  # cells that are smaller than their region


@pytest.mark.parametrize("kind", ["across", "links", "direct"])
def test_large_tiles_in_bounded_memory(kind):
    rng = np.random.default_rng(3)
    text = np.unique(rng.integers(0, 1 << 60, 12, dtype=np.uint64))
    m = 16_000 if kind == "across" else 8_000
    sets = [np.unique(np.append(text[np.arange(12) != k % 13], rng.integers(0, 1 << 60, dtype=np.uint64))) for k in range(m)]  # every two share 10 of at most 14
    for near in (True, False):
        own = sets if near else [np.unique(np.append(s[:2], rng.integers(0, 1 << 60, 8, dtype=np.uint64))) for s in sets]
        held, top, n = _regions.Sets(own), np.arange(m), 0
        tracemalloc.start()
        for i, j in _regions.batched(_regions.across(held, np.arange(m) % 2, 60) if kind == "across" else getattr(_regions, kind)(held, np.arange(m), 60)):
            top, n = _regions.roots(m, i, j, top), n + len(i)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 << 20
        assert n == (0 if not near else (m // 2) ** 2 if kind == "across" else m * (m - 1) // 2) and (top == (0 if near else np.arange(m))).all()


def test_pairs_proposed_for_some_sets_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 60, 9, dtype=np.uint64)) for _ in range(40)]
    sets = [np.unique(np.append(base[k % 40], rng.integers(0, 1 << 60, dtype=np.uint64))) for k in range(400)]
    want = pairs_of(sets)
    for block, pairs in ((1024, 1 << 22), (16, 1000), (3, 10)):
        monkeypatch.setattr(_regions, "BLOCK", block)
        monkeypatch.setattr(_regions, "PAIRS", pairs)
        found = [*_regions.direct(_regions.Sets(sets), np.arange(400), 75)]
        i, j = _regions.together(found)
        assert len(i) == len(want) and {*zip(i.tolist(), j.tolist())} == want and (len(found) > 1) == (block < 1024)


def test_a_shared_element_is_no_work():
    rng = np.random.default_rng(1)
    sets = [np.unique(np.append(rng.integers(1, 1 << 60, 5, dtype=np.uint64), np.uint64(7))) for _ in range(50_000)]
    began = time.perf_counter()
    assert (_regions.join_region(sets) == np.arange(50_000)).all()
    assert time.perf_counter() - began < 20


def test_a_shared_shingle_is_no_work(spark):
    rows = spark.range(50_000).selectExpr("id as doc_id", "concat('a b c d e ', id, ' ', id * 7 % 50021, ' ', id * 11 % 50023, ' q', id, ' r', id) as text")
    found = jaccard_join.join(rows, links=True)
    assert found.where("n_shingles <> 6 or component_id <> doc_id or n_links > 0").count() == 0 and found.count() == 50_000


def test_large_groups_are_dealt_over_tasks(spark):
    rng = random.Random(3)
    base = [f"g{i}" for i in range(60)]
    texts = [near(rng, base, 1) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [tuple(r) for r in df.collect()]
    got = jaccard_join.join(df, region_most=40, links=True).collect()
    assert [r.n_links for r in sorted(got)] == brute_links(rows)
    assert sorted([tuple(r)[:3] for r in got], key=repr) == brute_components(rows)


@pytest.mark.parametrize("names", [("doc_id", "text", "source"), ("stay_node", "node", "stay_set")])
def test_one_of_each_loses_no_document(spark, names):
    schema = "{} long, {} string, {} string".format(*names)
    rng = random.Random(4)
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(3, " ".join(a), "x"), (3, " ".join(a), "w"), (5, " ".join([*a, "more"]), "y"), (5, " ".join(b), "z"), (7, " ".join(b), "q"), (None, near(rng, a, 1), "n"), (None, "none of this is here yet", "n"), (None, "None of this  is here yet", "m"), (8, "", "e"), (8, None, "e"), (3, " ".join(a).upper(), "x")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        got = jaccard_join.one_of_each(df, id_col=names[0], text_col=names[1]).collect()
        assert sorted(((r[0], (r[1] or "").lower().split()[:1]) for r in got), key=repr) == [(3, ["a0"]), (5, ["b0"]), (8, []), (8, []), (None, ["none"])]
        assert next(tuple(r) for r in got if r[0] == 3) == (3, " ".join(a).upper(), "x")  # capitals come first
    assert jaccard_join.one_of_each(df.limit(0), id_col=names[0], text_col=names[1]).count() == 0


# ---- queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = ordered(*sql_rows(queries.ORACLE_SQL[name], SF))
    assert columns == want_columns and rows == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_covers_its_table(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    if "query_id" not in df.columns:
        assert df.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    else:
        assert df.count() == 20 * spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 20 = 0").count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "near copies":
            left = jaccard_join.join(out)
            assert left.where("component_id <> doc_id").count() == 0
        if k < 3:
            assert out.join(before, columns, "left_anti").count() == 0 and 0 < out.count() < before.count()
        before = out
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())) == sorted(map(repr, out.select("doc_id", "ids_sha256").collect()))


def test_pipeline_of_nothing(spark, none):
    import corpus_pipeline

    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_arrow_strings_with_offsets():
    from pluvial.llm._shared import text_bytes

    data, ends = text_bytes(pa.array(["ab", None, "é", ""])[1:])
    assert bytes(data).decode() == "é" and ends.tolist() == [0, 0, 2, 2]
