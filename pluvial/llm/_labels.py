"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_label: dict[int, int], held_out: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, label, place, text`` of at most ``per_label[label]`` labelled documents for each label.

    Those with the smallest hash of their id are taken, so the choice doesn't
    hang on the order of rows. Null labels, and ids in fold ``held_out``, take
    no part; of several labels of one id the largest counts, and of several
    texts of one id the smallest that is not null, so that the bound holds for
    rows too. The ids are few by that bound and go to the documents by
    broadcast: no text is shuffled for rows outside of the sample.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null")
    if held_out is not None:
        known = known.where(fold(F.col("doc_id")) != held_out)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    parts = [known.where(F.col("label") == value).orderBy("place", "doc_id").limit(most) for value, most in per_label.items()]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
