"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, unless they find it as this process does."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _SHIPPED or root in {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="pluvial-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/pluvial", "zip", root, "pluvial"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where none is named and the master is local, a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="pluvial-tables-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def fresh_uri(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/pluvial-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read again, without its lineage; and where it lies, for ``removed``. ``options``: of the writer."""
    uri = fresh_uri(df.sparkSession, kind)
    df.write.options(**(options or {})).parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri), uri


def removed(spark: SparkSession, *uris: str) -> None:
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
