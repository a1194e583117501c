"""Places and tables that all executors can see, and Arrow helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only where the session names none (tests, a single machine) a temporary
    folder of this process serves, and is removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="pluvial-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh URI below the shared folder."""
    return f"{shared_root(spark)}/pluvial-{kind}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it as this process does."""
    root = Path(__file__).resolve().parents[2]
    if root in {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}:
        return
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        folder = tempfile.mkdtemp(prefix="pluvial-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/pluvial", "zip", root, "pluvial"))


def remove_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, kind: str = "cut") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again.

    The result has no lineage before the files, so a lost executor costs one
    read and not the stages before. Returns the table and its URI; whoever
    consumed the table may hand the URI to ``remove_folder``.
    """
    spark = df.sparkSession
    uri = new_folder(spark, kind)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def local_path(uri: str) -> str:
    """The path of a shared URI that is mounted on every machine."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: the shared folder has to be mounted on the executors")
    return uri


def publish(uri: str, name: str, data: bytes) -> None:
    """Write one file so that readers see all of it or nothing."""
    folder = local_path(uri)
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, os.path.join(folder, name))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def appended(docs: DataFrame, keep: list[str], text_col: str, name: str, kind: str, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The columns ``keep`` and one more, which ``make`` computes from a batch's text bytes and their offsets. No row is shuffled."""
    kinds = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    at = keep.index(text_col) if text_col in keep and kinds[keep.index(text_col)].dataType.simpleString() == "string" else len(keep)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(make(*text_bytes(batch.column(at))))], [*[f"c{i}" for i in range(len(keep))], "made"])

    picked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *([F.col(f"`{text_col}`").cast("string").alias("text")] if at == len(keep) else []))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds)) + f", made {kind}"
    return picked.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("made").alias(name))
