"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns the columns of ``documents``; the last returns token ids.
``run`` writes every stage's rows as Parquet to the shared folder and reads
them again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvial.llm import byte_bpe, jaccard_join, mixing, quality, toxicity
from pluvial.llm._shared import new_folder, remove_folder, ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Null and empty texts score the bias and stay or go by it; rows repeat as they came."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.classify(docs, labels, held_out=None, keep=docs.columns)
    return scored.where(F.col("score") < 0.5).drop("score")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under 0.3 go. Null and empty texts are scored as texts without terms; rows repeat as they came."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs, labels, held_out=None, keep=docs.columns)
    return scored.where(F.col("score") >= 0.3).drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of 0.75 on shingles of five words connect, the one with the smallest id stays; texts without words all stay."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A null source is one source; texts without words follow its epochs."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of what they decode to. A null text has no ids, a null id stays null."""
    import public_tokenizers as vocab

    encoded = byte_bpe.encode_decode(docs, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: No SQL expresses the classifiers. Tests hold the classifiers, the join and the mix against brute-force versions each, and the stages to them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. A stage's rows are removed when the next stage has written its own."""
    ship(spark)
    before = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        uri = new_folder(spark, f"stage-{k + 1}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(uri)
        docs = spark.read.schema(out.schema).parquet(uri)
        if before:
            remove_folder(spark, before)
        before = uri
    return docs
