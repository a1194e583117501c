"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key, -ln(u) / quality, with u drawn from a
hash of its id (Efraimidis and Spirakis). A source first takes as many complete
epochs as its target holds; what is left of the target goes to documents in key
order, by a running sum of sizes. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._components import SMALL
from ._shared import cut, fresh, remove_folder

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[!|#$%&*]"
BUCKET_DOCS, BROADCAST_SOURCES, SALTS = 1024, 10_000, 64


def sizes(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less the more symbols stand among the words; 1 without words."""
    symbols = F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(SYMBOL)).cast("double")
    return F.when(size == 0, 1.0).otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbols / size.cast("double")))


def targets(sources: DataFrame, share: float, weights: Sequence[int], cap: float) -> DataFrame:
    """``target`` for each row of (source, source_size): shares by weight, held at ``cap`` times the
    size; what is cut off goes to the others by weight until none is above.

    That ends where target = min(cap * size, level * weight) for one level, which follows from
    running sums over the sources in the order in which a rising level reaches their caps. The
    table has a row for each source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("rank", F.row_number().over(place)).withColumn("w", w)
    out = out.withColumn("top", cap * F.col("source_size")).withColumn("reach", F.col("top") / F.col("w"))
    upto = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("budget", share * F.sum("source_size").over(everything))
    held = F.sum("top").over(upto) + F.col("reach") * (F.sum("w").over(everything) - F.sum("w").over(upto)) <= F.col("budget")
    out = out.withColumn("held", held)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("held"), F.col("top"))).over(everything), F.lit(0.0))
    level = left / F.sum(F.when(~F.col("held"), F.col("w"))).over(everything)
    target = F.when(F.col("held"), F.col("top")).otherwise(F.least(F.col("top"), level * F.col("w")))
    return out.withColumn("target", target).select("source", "rank", "source_size", "n", "key_sum", "target")


def _to_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its source's row. One source may hold most rows, so they are not dealt by source."""
    on = docs["source"].eqNullSafe(sources["source"])
    if sources.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), on).drop(sources["source"])
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("own_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return docs.join(salted, docs["source"].eqNullSafe(salted["source"]) & (docs["own_salt"] == salted["salt"])).drop(salted["source"]).drop("salt", "own_salt")


def _fill(rows: DataFrame, scratch: list[str]) -> tuple[DataFrame, bool]:
    """Take open documents, in key order, while the source's running sum stays within its ``gap``.

    The sum runs in two steps: over the sums of the source's key buckets, then
    within each bucket; a bucket has about BUCKET_DOCS documents whatever the
    source's size. Documents that agree in key, id and size are taken together.
    Also returns whether any was taken.
    """
    fits = ~F.col("chosen") & (F.col("size") <= F.col("gap")) & (F.col("size") > 0)
    rows = rows.withColumn("open", F.when(fits, F.col("size")).otherwise(0))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rank", "bucket").agg(F.sum("open").alias("bucket_open"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_open").over(before), F.lit(0))).drop("bucket_open")
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, ["rank", "bucket"])
    taken = (F.col("open") > 0) & (F.col("before") + F.sum("open").over(inside) <= F.col("gap"))
    rows, uri = cut(rows.withColumn("now", taken).drop("before"), "mix")
    scratch.append(uri)
    spent = rows.where("now").groupBy("rank").agg(F.sum("size").alias("spent"))
    some = spent.count()
    spent = F.broadcast(spent) if some <= BROADCAST_SOURCES else spent
    out = rows.join(spent, "rank", "left")
    return out.withColumn("gap", F.col("gap") - F.coalesce("spent", F.lit(0))).withColumn("chosen", F.col("chosen") | F.col("now")).drop("spent", "now", "open"), some > 0


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (5, 2, 1), cap: float = 2.0, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rounds: int | None = None) -> DataFrame:
    """How often each document goes into the mix.

    Returns ``doc_id, source, size, source_size, target, copies, taken,
    text_hash`` per row of ``docs``. ``size``: words of the whole text (null: 0). Sources by
    code point, null last, have the weights in turn and share ``share`` times
    all sizes; a target ends at ``cap`` times its source's size and the excess
    goes to the others. ``copies`` counts complete epochs, plus 1 for documents
    in the fractional epoch; ``taken`` is copies times size, so an empty text
    takes nothing. The fractional epoch runs over documents that still fit the
    gap until a run takes none, or ``rounds`` times at most, so long documents
    at the edge don't leave it open.
    ``quality``: a positive Column of ``docs``; by default ``quality_weight``.
    Keys depend on ids and quality alone: reruns agree. Rows that agree in id,
    source and text share one fate; null ids are one id. An empty table gives
    no rows.
    """
    text = F.col(text_col)
    size = sizes(text)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text.cast("string")).alias("text_hash"), (quality_weight(text, size) if quality is None else quality.cast("double")).alias("quality"))
    digest = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    scratch: list[str] = []
    rows, uri = cut(picked.withColumn("key", -F.log(u) / F.col("quality")).drop("quality"), "mix")
    scratch.append(uri)
    whole = F.sum((F.least("key", F.lit(1e6)) * 1e6).cast("bigint"))  # whole numbers: the same sum in any order
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), whole.alias("key_sum"))
    sources, uri = cut(targets(per_source, share, weights, cap), "mix")
    scratch.append(uri)
    rows = _to_sources(rows, sources)
    buckets = F.ceil(F.col("n") / BUCKET_DOCS)
    mean = F.greatest(F.col("key_sum") / 1e6 / F.col("n"), F.lit(1e-9))
    rows = rows.withColumn("bucket", F.least(F.floor(buckets * (1 - F.exp(-F.col("key") / mean))), buckets - 1))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    rows = rows.withColumn("epochs", epochs).withColumn("gap", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn("chosen", F.lit(False)).drop("n", "key_sum")
    done, some = 0, True
    while some and done != rounds:
        rows, some = _fill(rows, scratch)
        done += 1
    copies = (F.col("epochs") + F.col("chosen").cast("bigint")).cast("bigint")
    out, _ = cut(rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash"), "mix")
    for uri in scratch:
        remove_folder(docs.sparkSession, uri)
    return out


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns.

    Rows with equal id, source and text are told from others by a 64-bit hash of
    the text. Texts without words take nothing and come out once for each epoch
    of their source. An empty table gives no rows.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    names = fresh(docs, "mix_id", "mix_source", "mix_text", "mix_copies")
    own, source, text, copies = names
    fate = mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("text_hash").alias(text)).agg(F.max("copies").alias(copies))
    fate, uri = cut(fate, "mix")
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(source)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(text))
    out = docs.join(F.broadcast(fate) if fate.count() <= SMALL else fate.hint("merge"), on)
    copy = fresh(docs, "mix_copy")[0]
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The fractional epoch is a recursion: a step takes what fits, the next one goes on from its rows, and the last is one that took none.
SQL = """
WITH RECURSIVE s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[!|#$%&*]')) AS DOUBLE) AS symbols,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
d AS (SELECT doc_id, source, size, -ln(u) / (CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * symbols / size::DOUBLE) END) AS k FROM s),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM a),
c AS (SELECT *, CAST([5, 2, 1][CAST((rk - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS top FROM b),
e AS (SELECT *, top / w AS reach, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w FROM c),
h AS (SELECT *, sum(top) OVER (ORDER BY reach, rk ROWS UNBOUNDED PRECEDING) + reach * (all_w - sum(w) OVER (ORDER BY reach, rk ROWS UNBOUNDED PRECEDING)) <= budget AS held FROM e),
i AS (SELECT *, (budget - coalesce(sum(CASE WHEN held THEN top END) OVER (), 0.0)) / sum(CASE WHEN NOT held THEN w END) OVER () AS lvl FROM h),
j AS (SELECT source, rk, source_size, CASE WHEN held THEN top ELSE least(top, lvl * w) END AS target FROM i),
g0 AS (SELECT d.doc_id, d.size, d.k, j.rk, j.source_size, j.target,
    CASE WHEN j.source_size > 0 THEN CAST(floor(j.target / j.source_size) AS BIGINT) ELSE 1 END AS epochs,
    CAST(floor(j.target - (CASE WHEN j.source_size > 0 THEN floor(j.target / j.source_size) ELSE 1 END) * j.source_size) AS BIGINT) AS gap, false AS chosen
    FROM d JOIN j ON d.source IS NOT DISTINCT FROM j.source),
r AS (SELECT *, 0 AS step, true AS went_on FROM g0
    UNION ALL
    SELECT doc_id, size, k, rk, source_size, target, epochs, gap - spent AS gap, chosen OR now AS chosen, step + 1 AS step, bool_or(now) OVER () AS went_on FROM (
        SELECT *, CAST(coalesce(sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY rk), 0) AS BIGINT) AS spent FROM (
            SELECT *, op > 0 AND CAST(sum(op) OVER (PARTITION BY rk ORDER BY k, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) <= gap AS now FROM (
                SELECT *, CASE WHEN NOT chosen AND size <= gap AND size > 0 THEN size ELSE 0 END AS op FROM r WHERE went_on))))
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST((epochs + CAST(chosen AS BIGINT)) * size AS BIGINT) AS taken FROM r WHERE step = (SELECT max(step) FROM r)
"""
