"""Files in and out."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def first_existing(spark: SparkSession, uris: Sequence[str]) -> str:
    for uri in uris:
        if exists(spark, uri):
            return uri
    raise FileNotFoundError(", ".join(uris))


def read_csv(spark: SparkSession, uri: str | Sequence[str], schema: str) -> DataFrame:
    """Rows of CSV files with a header line, by a declared schema: nothing is read to guess types."""
    return spark.read.schema(schema).option("header", True).csv(uri if isinstance(uri, str) else list(uri))


def read_table(spark: SparkSession, uri: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV if the name ends so."""
    if uri.endswith(".csv"):
        return spark.read.option("header", True).csv(uri) if schema is None else read_csv(spark, uri, schema)
    return spark.read.parquet(uri) if schema is None else spark.read.schema(schema).parquet(uri)


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; absent columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_origin(df: DataFrame, station_name, year, url=None) -> DataFrame:
    """Where rows came from; by default the file that they were read from."""
    return df.withColumns({"station_name": station_name, "source_year": year, "source_url": F.col("_metadata.file_path") if url is None else url})


def write_csv(df: DataFrame, uri: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(uri)


def write_yearly(df: DataFrame, uri: str, time: str, order: Sequence[str]) -> None:
    """Parquet by year, in order within files; later reads of a year skip the other folders.

    Rows are dealt by year and day, so a year isn't one task.
    """
    out = df.withColumn("year", F.year(time))
    out.repartition("year", F.dayofyear(time)).sortWithinPartitions("year", *order).write.mode("overwrite").partitionBy("year").parquet(uri)


def write_ordered(df: DataFrame, uri: str, order: Sequence[str], kind: str = "parquet") -> None:
    """All rows in one total order over the files' names: ranges of ``order`` are dealt to tasks, which sort their own."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).format(kind).save(uri)


def read_numbered(spark: SparkSession, uri: str, out: str = "row") -> DataFrame:
    """Rows of an ordered Parquet table with their numbers, from 1: place in the file after the rows of the files before.

    No row is sorted or shuffled; only the files' counts, a row for each, are added up.
    """
    rows = spark.read.parquet(uri).withColumns({"_file": F.col("_metadata.file_name"), "_place": F.col("_metadata.row_index")})
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_file").withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_file", "_place", "_before")


def preview(spark: SparkSession, uri: str, n: int = 20) -> DataFrame:
    """The first ``n`` rows of an ordered Parquet table, in order: a limit over numbered rows, of the files that hold them."""
    return read_numbered(spark, uri, "_row").where(F.col("_row") <= n).orderBy("_row").drop("_row")


def write_report(df: DataFrame, path: str) -> None:
    """A short table as one CSV file with a byte-order mark."""
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")


def write_text(lines: Sequence[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def write_metadata(about: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(about, f, ensure_ascii=False, indent=2, default=str)
