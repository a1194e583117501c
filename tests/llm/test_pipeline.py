"""The pipeline's rows against plain versions of its stages; the two classifiers' scores are those of their operators,
which have tests of their own."""

import collections
import hashlib
import math

import numpy as np

from pluvial.llm import mixing, quality, toxicity
from tests.llm.test_operators import brute_components, words

SMALL = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Words for each source: weights 5, 2, 1 by name, nulls last, of 150 %, no source over twice its own."""
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight, left, open_, out = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_rows_equal_plain_stages(spark):
    import corpus_pipeline
    import public_tokenizers as vocab
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = toxicity.classify(docs, labels, held_out=None, keep=docs.columns)
    kept = scored.where("score < 0.5").drop("score")
    kept = quality.classify(kept, labels, held_out=None, keep=docs.columns).where("score >= 0.3").drop("score")
    rows = {r.doc_id: r for r in kept.collect()}
    classes = brute_components([(r.doc_id, r.text) for r in rows.values()])
    left = {i for i, n, first in classes if n == 0 or first == i}
    assert 0 < len(left) < len(rows) < docs.count()

    got = corpus_pipeline.run(spark, SMALL).collect()
    copies = collections.Counter(r.doc_id for r in got)
    size = {i: len(words(rows[i].text)) for i in left}
    sources = collections.defaultdict(int)
    for i in left:
        sources[rows[i].source] += size[i]
    targets = plain_targets(sources)
    assert set(copies) <= left
    for s, target in targets.items():
        own = [i for i in left if rows[i].source == s]
        epochs = math.floor(target / sources[s] + 1e-9) if sources[s] else 0
        taken = sum(copies[i] * size[i] for i in own)
        assert all(copies[i] in (epochs, epochs + 1) for i in own if size[i])
        assert taken <= target + 1e-6 and not [i for i in own if size[i] and copies[i] == epochs < 2 and size[i] <= target - taken]
    mixed = mixing.mix(docs.where(docs.doc_id.isin(sorted(left)))).collect()
    assert copies == collections.Counter({r.doc_id: r.copies for r in mixed if r.copies})

    plain = tiktoken.Encoding("plain", pat_str=vocab.PATTERN, mergeable_ranks=load_tiktoken_bpe(vocab.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in got:
        text = rows[r.doc_id].text or ""
        ids = np.asarray(plain.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
