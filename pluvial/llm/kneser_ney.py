"""Interpolated modified Kneser-Ney scores from n-grams counted in Spark.

Tokens are words and one end for each text; each text is preceded by begins
that are never predicted. Batches are counted where they are read. First words
are counted by 64-bit hashes and get ids, frequent ones the smaller. N-grams of
the highest order, as ids, meet in buckets of their contexts as compressed
blocks; each bucket becomes one file: sorted hashes of contexts, and behind
each the words that follow it with their counts; contexts of many words have
their totals beside them, so that these are not read again for every text that
holds one. It hands on its part of the next lower order's continuation counts, and so on down to pairs. Their buckets
become files of sorted hashes of pairs with counts, or of sorted words with the
total of the pairs they begin, the number of words they follow, and how many
pairs they begin that count one, two, or more. Scoring tasks map the files into
memory and search them for what a batch holds; pages are read as they are
needed and shared by the workers of a machine. A file that was written and
cannot be seen is an error.

    p(w | uv) = (c(uvw) - D3) / c(uv) + g(uv) p(w | v)
    p(w | v)  = (a(vw) - D2) / a(v) + g(v) p(w)
    p(w)      = (N(*w) - D1) / N(**) + g1 / (V + 1)

a(vw) is c(vw) at the highest order and where v is a begin, and elsewhere the
number of different words before vw; a(v) and c(uv) sum over all w. Each D
depends on whether the count is 1, 2 or more; each g hands on what they take. An
unseen context leaves the next lower order's; an unseen w ends in g1 / (V + 1).
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._chunks import ragged
from ._shared import cut, local_path, new_folder, publish, remove_folder, ship, text_bytes
from ._words import combine, groups, mix, word_hashes

SLICE, SCORED, CHUNK, LONG = 16 << 20, 6 << 20, 4, 8
#: LONG: of contexts that more words follow the file holds the totals. BUCKET: n-grams of a bucket, about: as many at most, and at least where there are more shuffle partitions than that needs. A bucket's contexts and pairs are known by the first bits of their hash, 8 at least, which number a cell of the file, and by HASH_BYTES (1, 2 or 4) after these; the bucket's number by others.
BUCKET, LEAST, HASH_BYTES, CLASSES, PAD = 2_000_000, 100_000, 4, 64, bytes(8)
END = np.uint64(1)
#: The ids of words that were never counted and of begins; counted words follow.
UNKNOWN, BEGIN, FIRST = 0, 1, 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every token of a range of documents, in 64 bits, and the n + 1 places where documents start."""
    words, counts = (np.concatenate(x) for x in zip(*[word_hashes(data, offsets[a : b + 1]) for a, b in groups(offsets)], strict=True))
    words = np.maximum(words, np.uint64(2))
    ends = np.concatenate([[0], np.cumsum(counts + 1)])
    token = np.full(ends[-1], END, np.uint64)
    inner = np.ones(ends[-1], bool)
    inner[ends[1:] - 1] = False
    token[inner] = words
    return token, ends


def ngrams(ids: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """The ``order`` columns of every token's n-gram, the token itself last."""
    columns = [ids.astype(np.uint64)]
    for _ in range(order - 1):
        before = np.empty_like(columns[0])
        before[1:] = columns[0][:-1]
        before[ends[:-1]] = BEGIN
        columns.insert(0, before)
    return columns


def pair_bucket(v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Pairs of one v lie in an eighth of the buckets, so that a frequent word doesn't fill one."""
    spread = np.uint64(max(8, n // 8))
    return (mix(v + END) % (np.uint64(n) // spread) * spread + mix(w + END) % spread).astype(np.int32)


def word_bucket(w: np.ndarray, n: int) -> np.ndarray:
    return (mix(w ^ np.uint64(0x9E37)) % np.uint64(n)).astype(np.int32)


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    return combine(*columns, salt=len(columns))


def context_bucket(context: np.ndarray, n: int) -> np.ndarray:
    return (mix(context) % np.uint64(n)).astype(np.int32)


def cell_bits(h: np.ndarray) -> int:
    """How many first bits number the cells of a file of ascending hashes: 4 to 8 of these in a cell, or up to 6 bits more until the file knows them all apart."""
    least = max(8, (len(h) >> 3).bit_length())
    for bits in range(least, least + 7):
        part = short(h, bits)
        if (part[1:] != part[:-1]).all():
            break
    return bits


def short(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a hash that a file with so many bits for cells knows."""
    return h >> np.uint64(64 - bits - 8 * HASH_BYTES)


def digits(bucket: np.ndarray, n: int) -> np.ndarray:
    """Numbers below ``n``, of a type that sorts by digits where these suffice."""
    return bucket.astype(np.uint16) if n <= 1 << 16 else bucket


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, and which of these each key is. By hashing, since only what differs needs sorting later."""
    which, different = pd.factorize(key)
    some = np.empty(len(different), np.int64)
    some[which] = np.arange(len(key))
    return some, which


def _cut(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _hashes(h: np.ndarray, bits: int) -> bytes:
    """Ascending hashes without the bits of their cells, and before them where each cell starts."""
    starts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return starts.astype("<u4").tobytes() + _cut(short(h, bits), HASH_BYTES)


def packed(raw: np.ndarray, at: int, n: int, size: int) -> np.ndarray:
    """``n`` numbers of ``size`` bytes as they lie in a file. Each is read with bytes of the next, so ``low`` has to cut these off."""
    return np.ndarray(n, "<u8", raw, at, (size,))


def low(x: np.ndarray, size: int) -> np.ndarray:
    return x & np.uint64((1 << 8 * size) - 1)


def squeezed(*columns: np.ndarray) -> bytes:
    """Equally long columns of unsigned 32-bit numbers, each byte's plane by itself."""
    planes = [np.ascontiguousarray(np.asarray(c, "<u4").view(np.uint8).reshape(-1, 4).T) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unsqueezed(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).reshape(-1).view("<u4").astype(np.uint64) for p in planes]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], *(np.add.reduceat(v[order], head) if len(head) else v for v in values)


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """A key of each n-gram: of one or two ids these themselves, so that they ascend with it, of more a hash."""
    return columns[0] if len(columns) == 1 else columns[0] << np.uint64(32) | columns[1] if len(columns) == 2 else combine(*columns)


def _heads(*ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.zeros(max(len(ordered[0]) - 1, 0), bool)
    for x in ordered:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([[True], new])) if len(ordered[0]) else np.zeros(0, np.int64)


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams and the sums of their counts."""
    key = _joined(columns)
    if counts is None:
        some, which = distinct(key)
        return [c[some] for c in columns], np.bincount(which, minlength=len(some))
    order = np.argsort(key)
    head = _heads(key[order])
    return [c[order[head]] for c in columns], np.add.reduceat(counts[order], head)


def _by_context(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct n-grams with the sums of their counts by known context and word, where contexts start, these ones' hashes, and the bits of cells."""
    context = context_hash(columns[:-1])
    order = np.argsort(context)
    head = _heads(context[order])
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.repeat(np.arange(len(head), dtype=np.uint64), np.diff(np.append(head, len(order))))
    key = rank << np.uint64(32) | columns[-1]
    order = np.argsort(key)
    first = _heads(key[order])
    columns, counts, context = [c[order[first]] for c in columns], np.add.reduceat(counts[order], first), context[order[first]]
    whole = _heads(context)
    bits = cell_bits(context[whole])
    part = short(context, bits)
    head = _heads(part)
    if len(head) < len(whole):  # the file takes such contexts for one
        order = np.lexsort((columns[-1], part))
        columns, counts, context = [c[order] for c in columns], counts[order], context[order]
    return columns, counts, head, context[head], bits


#: A block of n-grams: what its contexts are and how many words follow each; the words and counts; notes of the files written so far.
_BLOCK = "bucket int, contexts binary, words binary, notes binary"


def _blocks(columns: list[np.ndarray], counts: np.ndarray, n_buckets: int, notes: bytes = b"") -> list[pa.Array]:
    """A row for each bucket that distinct n-grams reach. Contexts are sorted, the first word as differences, for the codec."""
    bucket = pair_bucket(*columns, n_buckets) if len(columns) == 2 else context_bucket(context_hash(columns[:-1]), n_buckets)
    order = np.argsort(_joined(columns[:-1])) if len(columns) < 4 else np.lexsort(columns[-2::-1])
    order = order[np.argsort(digits(bucket[order], n_buckets), kind="stable")]
    columns, counts, bucket = [c[order] for c in columns], counts[order], bucket[order]
    head = _heads(bucket, *columns[:-1])
    follow = np.diff(np.append(head, len(bucket)))
    edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
    rows = []
    for i in np.flatnonzero(np.diff(edges)).tolist():
        x, y = edges[i], edges[i + 1]
        p, q = np.searchsorted(head, (x, y))
        own = head[p:q]
        rows.append((i, squeezed(np.diff(columns[0][own], prepend=np.uint64(0)), *(c[own] for c in columns[1:-1]), follow[p:q]), squeezed(columns[-1][x:y], counts[x:y]), b"" if rows else notes))
    cols = list(zip(*rows, strict=True))
    return [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])]


def _unblocked(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts, counts = [[] for _ in range(order)], []
    for c, w in zip(table.column("contexts").to_pylist(), table.column("words").to_pylist(), strict=True):
        first, *rest, follow = unsqueezed(c, order)
        for part, x in zip(parts, (np.cumsum(first), *rest), strict=False):
            part.append(np.repeat(x, follow.astype(np.int64)))
        word, n = unsqueezed(w, 2)
        parts[-1].append(word)
        counts.append(n.astype(np.int64))
    return [np.concatenate(x) for x in parts], np.concatenate(counts)


def _note(table: pa.Table, order: int, n: np.ndarray) -> bytes:
    """What the rows have noted, and a note of the order, the bucket, and how many counts are 1, 2, 3 and 4."""
    own = np.asarray([order, table.column("bucket")[0].as_py(), *((n == i).sum() for i in (1, 2, 3, 4))], "<i8").tobytes()
    return b"".join(table.column("notes").to_pylist()) + own


def _small(n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which counts are too large for a byte; their places and values, and a byte for each count."""
    many = np.flatnonzero(n > 254)
    return many, [many.astype("<u8").tobytes(), n[many].astype("<u8").tobytes(), np.minimum(n, 255).astype("u1").tobytes()]


def _grams(about: dict, order: int, n_buckets: int):
    def run(batches):
        model = Model(about)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in groups(offsets, SLICE, 1 << 16):
                token, ends = tokens(data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays(_blocks(*_distinct(ngrams(model.words(token)[0], ends, order)), n_buckets), ["bucket", "contexts", "words", "notes"])

    return run


def _merge_grams(place: str, order: int, width: int, n_below: int):
    """The file of a bucket of n-grams; hands on its part of the counts of one order less."""

    def run(table: pa.Table) -> pa.Table:
        columns, n, head, hashes, bits = _by_context(*_unblocked(table, order))
        follow = np.diff(np.append(head, len(n)))
        (far, follows), (many, counts) = _small(follow), _small(n)
        long = np.flatnonzero(follow > LONG)
        totals = [np.add.reduceat(x, head, dtype=np.int64)[long].astype(kind).tobytes() for x, kind in ((n, "<u8"), (n == 1, "<u4"), (n == 2, "<u4"))]
        header = np.asarray([len(head), len(n), len(far), len(many), len(long), bits], "<u8").tobytes()
        publish(place, f"grams-{order}-{table.column('bucket')[0].as_py():06d}", b"".join([header, *follows, *counts, head[::CHUNK].astype("<u4").tobytes(), long.astype("<u4").tobytes(), *totals, _hashes(hashes, bits), _cut(columns[-1], width), PAD]))
        below = _distinct(columns[1:], np.where(columns[1] == BEGIN, n, 1))
        return pa.table(_blocks(*below, n_below, _note(table, order, n)), names=["bucket", "contexts", "words", "notes"])

    return run


def _counts(n_buckets: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in groups(offsets, SLICE, 1 << 16):
                token = tokens(data, offsets[a : b + 1])[0]
                some, which = distinct(token)
                word, n = token[some], np.bincount(which)
                bucket = word_bucket(word, n_buckets)
                order = np.argsort(digits(bucket, n_buckets), kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array([x[order][edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary()) for x in (word, n.astype("<u4")))], ["bucket", "word", "n"])

    return run


def _classes(n: np.ndarray) -> np.ndarray:
    """0 for the largest counts; a class for each power of two."""
    return CLASSES - np.frexp(n.astype(np.float64))[1]


def _merge_counts(place: str):
    """The file of a bucket of words, by all 64 bits, with how often each occurs."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        word, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("word", "<u8"), ("n", "<u4")))
        word, n = _summed(word, n.astype(np.int64))
        publish(place, f"counts-{bucket:06d}", b"".join([np.asarray([len(word)], "<u8").tobytes(), word.tobytes(), n.astype("<u8").tobytes()]))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "tokens": pa.array([n.sum()], pa.int64()), "classes": [np.bincount(_classes(n), minlength=CLASSES + 1).tolist()]})

    return run


def _name_words(place: str, starts: dict[int, np.ndarray]):
    """The file of ids beside each file of counts: by class, then bucket, then hash."""

    def run(batches):
        for batch in batches:
            for bucket in (x for x in batch.column(0).to_pylist() if x in starts):
                raw = np.memmap(os.path.join(place, f"counts-{bucket:06d}"), np.uint8, "r")
                n = Model._take(raw, 8 + 8 * int(Model._take(raw, 0, 1, "<u8")[0]), int(Model._take(raw, 0, 1, "<u8")[0]), "<u8")
                kind = _classes(n)
                order = np.argsort(kind, kind="stable")
                sizes = np.bincount(kind, minlength=CLASSES + 1)
                ids = np.empty(len(n), "<u4")
                ids[order] = ragged(starts[bucket], sizes)
                publish(place, f"ids-{bucket:06d}", ids.tobytes())
            yield batch

    return run


def _merge_pairs(place: str, n_words: int):
    def run(table: pa.Table) -> pa.Table:
        (v, w), n = _distinct(*_unblocked(table, 2))
        key = combine(v, w)
        order = np.argsort(key)
        key, bits = key[order], cell_bits(key[order])
        many, counts = _small(n[order])
        publish(place, f"pairs-{table.column('bucket')[0].as_py():06d}", b"".join([np.asarray([len(key), len(many), bits], "<u8").tobytes(), *counts, _hashes(key, bits)]))
        one = np.ones_like(n)
        targets = _summed(w, one)
        contexts = _summed(v, n, (n == 1) * one, (n == 2) * one, (n > 2) * one)
        zero_t, zero_c = np.zeros(len(targets[0]), np.int64), np.zeros(len(contexts[0]), np.int64)
        word = np.concatenate([targets[0], contexts[0]])
        total = np.concatenate([zero_t, contexts[1]])
        rest = [np.concatenate(x) for x in ((targets[1], zero_c), (zero_t, contexts[2]), (zero_t, contexts[3]), (zero_t, contexts[4]))]
        word, total, *rest = _summed(word, total, *rest)
        bucket = word_bucket(word, n_words)
        order = np.argsort(digits(bucket, n_words), kind="stable")
        word, total, bucket, rest = word[order], total[order], bucket[order], [x[order] for x in rest]
        edges = np.searchsorted(bucket, np.arange(n_words + 1))
        rows = []
        for i in np.flatnonzero(np.diff(edges)).tolist():
            x, y = edges[i], edges[i + 1]
            rows.append((i, squeezed(np.diff(word[x:y], prepend=np.uint64(0)), *(r[x:y] for r in rest)), total[x:y].astype("<u8").tobytes(), b"" if rows else _note(table, 2, n)))
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "words", "totals", "notes"])

    return run


def _merge_words(place: str):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [unsqueezed(x, 5) for x in table.column("words").to_pylist()]
        word = np.concatenate([np.cumsum(p[0]) for p in parts])
        total = np.frombuffer(b"".join(table.column("totals").to_pylist()), "<u8").astype(np.int64)
        word, total, follows, once, twice, more = _summed(word, total, *(np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(1, 5)))
        publish(place, f"words-{bucket:06d}", b"".join([np.asarray([len(word)], "<u8").tobytes(), total.astype("<u8").tobytes(), word.astype("<u4").tobytes(), *(x.astype("<u4").tobytes() for x in (follows, once, twice, more))]))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "words": [int((word != BEGIN).sum())], "pairs": [int(follows.sum())], "follow_classes": [[int((follows == i).sum()) for i in (1, 2, 3, 4)]], "notes": pa.array([b"".join(table.column("notes").to_pylist())], pa.binary())})

    return run


def discounts(n: list[int]) -> list[float]:
    """Modified discounts for counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4; each at most its count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def train(docs: DataFrame, folder: str | None = None, text_col: str = "text", order: int = 2) -> dict:
    """Count ``docs`` (all of its rows) and write the model's files; returns where they are and the totals.

    ``order``: the longest n-grams, 2 at least. Null and empty texts are one end
    each; repeated rows count as often. Files have names by bucket and are
    replaced whole, so a task that runs twice does no harm; the totals list the
    files, so one that is lost is not taken for an empty bucket. The number of
    buckets follows the number of tokens.
    """
    if order < 2:
        raise ValueError("order: 2 at least")
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "ngrams")
    place = local_path(folder)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_words = max(4, partitions, texts.rdd.getNumPartitions())
    counted = texts.mapInArrow(_counts(n_words), "bucket int, word binary, n binary").groupBy("bucket").applyInArrow(_merge_counts(place), "bucket int, tokens bigint, classes array<bigint>").collect()  # a row for each bucket
    counted.sort(key=lambda r: r.bucket)  # so that reruns give the same ids
    sizes = np.asarray([r.classes for r in counted], np.int64).reshape(len(counted), CLASSES + 1)
    starts = FIRST + (np.cumsum(sizes.T.ravel()) - sizes.T.ravel()).reshape(CLASSES + 1, -1).T
    vocabulary, n_tokens = int(sizes.sum()), sum(r.tokens for r in counted)
    if vocabulary + FIRST >= 1 << 32:
        raise ValueError("more words than ids")
    spark.range(n_words).mapInArrow(_name_words(place, {r.bucket: s for r, s in zip(counted, starts, strict=True)}), "id bigint").count()
    n_pairs = 8 * max(1, min(2 * partitions, n_tokens // LEAST) // 8, -(-n_tokens // (8 * BUCKET)))
    about = {"place": place, "order": order, "n_pairs": n_pairs, "n_words": n_words, "n_grams": 2 * n_pairs, "vocabulary": vocabulary, "tokens": n_tokens, "width": max(1, (vocabulary + FIRST - 1).bit_length() + 7 >> 3), "files": {f"{kind}-{r.bucket:06d}" for r in counted for kind in ("counts", "ids")}}
    number = lambda k: about["n_grams"] if k > 2 else n_pairs
    blocks = texts.mapInArrow(_grams(about, order, number(order)), _BLOCK)
    for k in range(order, 2, -1):
        blocks = blocks.groupBy("bucket").applyInArrow(_merge_grams(place, k, about["width"], number(k - 1)), _BLOCK)
    words = blocks.groupBy("bucket").applyInArrow(_merge_pairs(place, n_words), "bucket int, words binary, totals binary, notes binary")
    rows = words.groupBy("bucket").applyInArrow(_merge_words(place), "bucket int, words bigint, pairs bigint, follow_classes array<bigint>, notes binary").collect()  # a row for each bucket
    notes = np.frombuffer(b"".join(bytes(r.notes) for r in rows), "<i8").reshape(-1, 6)
    follow = [sum(x) for x in zip(*(r.follow_classes for r in rows), strict=True)] or [0] * 4
    files = {f"words-{r.bucket:06d}" for r in rows} | {f"grams-{k}-{b:06d}" if k > 2 else f"pairs-{b:06d}" for k, b in notes[:, :2].tolist()}
    d = [discounts(notes[notes[:, 0] == k, 2:].sum(axis=0).tolist()) for k in range(2, order + 1)]
    return about | {"files": about["files"] | files, "words": sum(r.words for r in rows), "pairs": sum(r.pairs for r in rows), "d": d[0], "d_longer": d[1:], "d_follow": discounts(follow), "follow_classes": follow}


def places(x: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """For each bucket in ``x`` where it stands."""
    x = digits(x, n)
    order = np.argsort(x, kind="stable")
    edges = np.searchsorted(x[order], np.arange(n))
    return [(i, order[edges[i] : end]) for i, end in enumerate((*edges[1:], len(x))) if end > edges[i]]


def find(read, first: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stands among the ascending numbers that ``read`` gives of [first, first + size), and whether it does: the places of those that don't mean nothing."""
    order = np.argsort(-size)  # so that those still open are the first ones
    at, left, sought = first[order], size[order], wanted[order]
    place, there = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
    some = k = np.count_nonzero(left)
    while k := np.count_nonzero(left[:k] > 1):
        half = left[:k] >> 1
        at[:k] += half * (read(at[:k] + half) <= sought[:k])
        left[:k] -= half
    place[order], there[order[:some]] = at, read(at[:some]) == sought[:some]
    return place, there


def find_hash(raw, at: int, n: int, bits: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand among a file's ``_hashes``, and whether they do: the places of those that don't mean nothing."""
    starts = raw[at : (keys_at := at + cells_size(bits))].view("<u4")
    keys = raw[keys_at : keys_at + HASH_BYTES * n].view(f"<u{HASH_BYTES}")
    cell = (wanted >> np.uint64(64 - bits)).astype(np.int64)
    first = starts[cell].astype(np.int64)
    return find(keys.__getitem__, first, starts[cell + 1] - first, short(wanted, bits).astype(keys.dtype))


def _extended(gram: np.ndarray, n: int, word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each token's n-gram, as a number below ``n``: a place of each different one that is a word longer, which of these each token has, and what the word follows: an n-gram, or ``n`` for begins alone."""
    context = np.empty_like(gram)
    context[1:] = gram[:-1]
    context[ends[:-1]] = n
    return *distinct(context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)), context


def cells_size(bits: int) -> int:
    return 4 * ((1 << bits) + 1)


class Bytes:
    """Counts of which most are a byte each."""

    def __init__(self, raw, at: int, n: int, many: int):
        self.spots, self.sizes = (raw[at + k * 8 * many : at + (k + 1) * 8 * many].view("<u8") for k in (0, 1))
        self.small, self.end = raw[at + 16 * many : at + 16 * many + n], at + 16 * many + n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        c = np.asarray(self.small[at]).astype(np.int64)
        big = c == 255
        if big.any():
            c[big] = self.sizes[np.searchsorted(self.spots, np.asarray(at)[big])]
        return c


class Model:
    """The files of ``train``, mapped into memory as they are first used."""

    def __init__(self, about: dict):
        self.about, self.files = about, {}

    def _open(self, name: str):
        """None for a bucket without rows; an error for a file that was written and isn't there."""
        if name not in self.files:
            known = name in self.about["files"]
            self.files[name] = np.asarray(np.memmap(os.path.join(self.about["place"], name), np.uint8, "r")) if known else None
        return self.files[name]

    @staticmethod
    def _take(raw, at: int, n: int, kind: str):
        return raw[at : at + n * np.dtype(kind).itemsize].view(kind)

    def words(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each token, and how often it occurs, by its 64 bits."""
        some, back = distinct(token)
        ids, counts = self._words(token[some])
        return ids[back], counts[back]

    def _words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.zeros(len(word), np.uint64), np.zeros(len(word), np.int64)
        for i, own in places(word_bucket(word, self.about["n_words"]), self.about["n_words"]):
            if (raw := self._open(f"counts-{i:06d}")) is None:
                continue
            n = int(self._take(raw, 0, 1, "<u8")[0])
            keys = self._take(raw, 8, n, "<u8")
            own = own[np.argsort(word[own])]
            spot = np.minimum(np.searchsorted(keys, word[own]), n - 1)
            hit = keys[spot] == word[own]
            counts[own[hit]] = self._take(raw, 8 + 8 * n, n, "<u8")[spot[hit]]
            ids[own[hit]] = self._open(f"ids-{i:06d}").view("<u4")[spot[hit]]
        return ids, counts

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        key, out = combine(v, w), np.zeros(len(v), np.int64)
        for i, own in places(pair_bucket(v, w, self.about["n_pairs"]), self.about["n_pairs"]):
            if (raw := self._open(f"pairs-{i:06d}")) is None:
                continue
            n, many, bits = (int(x) for x in self._take(raw, 0, 3, "<u8"))
            counts = Bytes(raw, 24, n, many)
            own = own[np.argsort(key[own])]
            spot, hit = find_hash(raw, counts.end, n, bits, key[own])
            out[own[hit]] = counts[spot[hit]]
        return out

    def word_stats(self, w: np.ndarray) -> np.ndarray:
        """Rows (total, follows, once, twice, more)."""
        out = np.zeros((len(w), 5), np.int64)
        for i, own in places(word_bucket(w, self.about["n_words"]), self.about["n_words"]):
            if (raw := self._open(f"words-{i:06d}")) is None:
                continue
            n = int(self._take(raw, 0, 1, "<u8")[0])
            keys = self._take(raw, 8 + 8 * n, n, "<u4")
            spot = np.minimum(np.searchsorted(keys, w[own].astype("<u4")), n - 1)
            hit = keys[spot] == w[own]
            spot, own = spot[hit], own[hit]
            out[own, 0] = self._take(raw, 8, n, "<u8")[spot]
            for k in range(4):
                out[own, k + 1] = self._take(raw, 8 + 12 * n + 4 * n * k, n, "<u4")[spot]
        return out

    def gram_stats(self, contexts: list[np.ndarray], context: np.ndarray, word: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts of n-grams of three words and more, each given by the place of its context and its word; their contexts' totals, and what the discounts ``d`` take of these."""
        out, hashes, n_grams = np.zeros(len(word), np.int64), context_hash(contexts), self.about["n_grams"]
        bucket = context_bucket(hashes, n_grams)
        first, sizes, total, taken = (np.zeros(len(hashes), kind) for kind in (np.int64, np.int64, np.int64, np.float64))
        grams = dict(places(bucket[context], n_grams))
        for i, own in places(bucket, n_grams):
            raw = self._open(f"grams-{len(contexts) + 1}-{i:06d}")
            if raw is None:
                continue
            m, n, far, many, n_long, bits = (int(x) for x in self._take(raw, 0, 6, "<u8"))
            follow = Bytes(raw, 48, m, far)
            counts = Bytes(raw, follow.end, n, many)
            starts, at = self._take(raw, counts.end, -(-m // CHUNK), "<u4"), counts.end + 4 * -(-m // CHUNK)
            long, at = self._take(raw, at, n_long, "<u4"), at + 4 * n_long
            totals = [self._take(raw, at + x * n_long, n_long, kind) for x, kind in ((0, "<u8"), (8, "<u4"), (12, "<u4"))]
            at += 16 * n_long
            words = packed(raw, at + cells_size(bits) + HASH_BYTES * m, n, self.about["width"])
            own = own[np.argsort(hashes[own])]
            spot, hit = find_hash(raw, at, m, bits, hashes[own])
            spot, own = spot[hit], own[hit]
            if not len(spot):
                continue
            begin, before, size = starts[spot // CHUNK].astype(np.int64), spot % CHUNK, follow[spot]
            for k in range(1, CHUNK):
                some = np.flatnonzero(before >= k)
                begin[some] += follow[spot[some] - k]
            first[own], sizes[own] = begin, size
            some = np.flatnonzero(size > LONG)
            in_long = np.searchsorted(long, spot[some].astype(np.uint32))
            total[own[some]], once, twice = (x[in_long].astype(np.int64) for x in totals)
            taken[own[some]] = once * d[1] + twice * d[2] + (size[some] - once - twice) * d[3]
            some = np.flatnonzero(size <= LONG)
            if len(some):
                few, edge = size[some], np.cumsum(size[some]) - size[some]
                every = counts[ragged(begin[some], few)]
                once, twice = (np.add.reduceat(every == k, edge, dtype=np.int64) for k in (1, 2))
                total[own[some]] = np.add.reduceat(every, edge)
                taken[own[some]] = once * d[1] + twice * d[2] + (few - once - twice) * d[3]
            gram = grams[i]
            gram = gram[sizes[context[gram]] > 0]
            of = context[gram]
            at, there = find(lambda x: low(words[x], self.about["width"]), first[of], sizes[of], word[gram])  # noqa: B023
            out[gram[there]] = counts[at[there]]
        return out, total[context], taken[context]

    def score(self, token: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p(w | the words before), log10 of the base probability, and the word's count, of each token."""
        a = self.about
        some, word = distinct(token)
        ids, known = self._words(token[some])
        columns = ngrams(ids[word], ends, a["order"])
        ids = np.append(ids, np.uint64(BEGIN))
        stats = self.word_stats(ids)
        some, gram, context = _extended(word, len(ids) - 1, word, ends)
        vi, wi = context[some], word[some]
        count = self.pair_counts(ids[vi], ids[wi])
        d, e = np.asarray([0.0, *a["d"]]), np.asarray([0.0, *a["d_follow"]])
        follows, f = stats[:, 1], a["follow_classes"]
        more = a["words"] - f[0] - f[1]
        handed = (e[1] * f[0] + e[2] * f[1] + e[3] * more) / max(a["pairs"], 1) if a["pairs"] else 1.0
        low = (follows - e[np.minimum(follows, 3)]) / max(a["pairs"], 1) + handed / (a["words"] + 1)
        gives = stats[:, 2] * d[1] + stats[:, 3] * d[2] + stats[:, 4] * d[3]
        t = stats[vi, 0]
        p = np.where(t > 0, (count - d[np.minimum(count, 3)] + gives[vi] * low[wi]) / np.maximum(t, 1), low[wi])[gram]
        for k, own in enumerate(a["d_longer"], 3):
            contexts = [np.append(c[some], np.uint64(BEGIN)) for c in columns[1 - k :]]
            some, gram, context = _extended(gram, len(some), word, ends)
            d = np.asarray([0.0, *own])
            n, t, gives = self.gram_stats(contexts, context[some], columns[-1][some], d)
            p = p[some]
            p = np.where(t > 0, (n - d[np.minimum(n, 3)] + gives * p) / np.maximum(t, 1), p)[gram]
        known = known[word]
        return np.log10(p), np.log10((known + 0.5) / (a["tokens"] + 0.5 * (a["vocabulary"] + 1))), known


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    A null or empty text is its end alone; without training texts every token
    has the probability of an unseen word. Repeated rows come out as often;
    a null id stays null.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = Model(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in groups(offsets, SCORED, 1 << 16):
                token, ends = tokens(data, offsets[a : b + 1])
                logp, base, count = m.score(token, ends)
                add = lambda x: np.add.reduceat(x, ends[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x) for x in (np.diff(ends), add((count > 0).astype(np.int64)), np.full(b - a, model["tokens"]), add(base), add(logp)))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train_and_score(docs: DataFrame, learn_from: Column, order: int = 2, **columns) -> DataFrame:
    """Train on the rows of ``docs`` where ``learn_from`` holds (null: not) and score all of them.

    Nulls, empty texts, repeated rows and empty tables are as in ``train`` and ``score``; other columns are not read.
    The scores are written to the shared folder, and the model's files removed.
    """
    folder = new_folder(docs.sparkSession, "ngrams")
    out, _ = cut(score(docs, train(docs.where(learn_from), folder, columns.get("text_col", "text"), order), **columns), "scores")
    remove_folder(docs.sparkSession, folder)
    return out
