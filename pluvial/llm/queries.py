"""The queries of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _labels, anchor_dedup, byte_bpe, cover_tree, jaccard_join, kneser_ney, mixing, periodic_runs, quality, rabitq, token_blocks, token_counts, toxicity, uniform_topk
from ._shared import cut, remove_folder, ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=0)
    return scored.select("doc_id", (_labels.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _labels.fold(F.col("doc_id"))
    scored = kneser_ney.train_and_score(_table(spark, sf_dir, "documents"), place != 1, order=3)
    return scored.select("doc_id", (place == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_uniform_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_topk.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    manifest = token_blocks.write(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"), end_id=0)
    out, _ = cut(token_blocks.read(spark, manifest), "tokens")
    for r in manifest.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect():  # one folder
        remove_folder(spark, "file://" + r.folder)
    return out


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=0)
    return scored.select("doc_id", (_labels.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return byte_bpe.digests(byte_bpe.encode_decode(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return token_counts.count(_table(spark, sf_dir, "documents"), vocab.path("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.mine(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, label)


def op12_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_dedup.dedup(_table(spark, sf_dir, "documents"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in about a tenth of the documents, by crc32 of the id, the words from some place on
    repeat what stands there; these texts become their words joined by one space. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("bigint"))
    held = held.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    tail = F.col("n") - F.col("a")
    held = held.withColumn("p", 1 + F.floor(tail / (3 + F.col("g") % 8)))
    piece = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.flatten(F.array_repeat(piece, F.ceil(tail / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), tail.cast("int"))), " ")
    return held.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(_with_repeats(_table(spark, sf_dir, "documents")))
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  of two exponents, exactly
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)), lambda kept, x: F.when(longer(x, kept), x).otherwise(kept))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_rabitq": op2_rabitq,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_uniform_topk": op4_uniform_topk,
    "op5_token_blocks": op5_token_blocks,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_cover_tree": op11_cover_tree,
    "op12_simhash_anchors": op12_simhash_anchors,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op2_rabitq": rabitq.SQL, "op4_uniform_topk": uniform_topk.SQL, "op9_mixing": mixing.SQL, "op10_jaccard_join": jaccard_join.SQL, "op11_cover_tree": cover_tree.SQL}
