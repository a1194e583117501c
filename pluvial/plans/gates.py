"""Steps that hand tables on only when they passed their checks: write, audit, publish.

A step writes its rows to a folder that nothing names, and counts its checks in
the same job. If none failed, a manifest (where the rows lie, how many, what was
counted) takes the place of the one before by one rename. Readers go by the
manifest, so they see the old table or the new one, whole, and never a table
that failed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from pluvial.operators import store, validate
from pluvial.sources.files import exists


class _Store:
    """Small files and renames of one folder, through Hadoop, so that any store serves."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, root.rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def put(self, name: str, text: str) -> None:
        """Writes beside it, then one rename over what was there."""
        part = self.path(f".{name}.{uuid.uuid4().hex}")
        conf = self.spark._jsc.hadoopConfiguration()
        out = part.getFileSystem(conf).create(part, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), conf).rename(part, self.path(name), options)

    def get(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect())  # one small file


def manifest(spark: SparkSession, root: str, name: str) -> dict:
    """What was published last under ``name``: ``uri, rows, checks, at``, and ``before``, the table that it replaced."""
    if not exists(spark, f"{root}/{name}.manifest.json"):
        raise FileNotFoundError(f"{name}: nothing is published")
    return json.loads(_Store(spark, root).get(f"{name}.manifest.json"))


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(manifest(spark, root, name)["uri"])


def publish(df: DataFrame, root: str, name: str, rules: dict | None = None, tolerated: dict[str, float] | None = None, audit: validate.Audit | None = None, least_rows: int = 1) -> dict:
    """Writes ``df`` once and publishes it if no check failed; else removes it and raises what failed.

    ``audit`` may hold checks on tables that ``df`` is made from. Fewer than
    ``least_rows`` rows fail. The table that was published before the last one
    is removed, so a reader of the last one is not disturbed.
    """
    spark, audit = df.sparkSession, audit or validate.Audit()
    uri = f"{root.rstrip('/')}/.tables/{name}-{uuid.uuid4().hex}"
    watched = audit.watch(df, name, rules, tolerated)
    try:
        watched.write.parquet(uri)
        rows = audit.watched[-1][1].get.get("rows", 0) or 0
        checks = audit.settle()
        if rows < least_rows:
            raise validate.Violation(f"{name}: {rows} rows")
    except Exception:
        store.removed(spark, uri)
        raise
    try:
        before = manifest(spark, root, name)
    except FileNotFoundError:
        before = {}
    about = {"uri": uri, "rows": rows, "checks": checks, "at": datetime.now(UTC).isoformat(), "before": before.get("uri")}
    _Store(spark, root).put(f"{name}.manifest.json", json.dumps(about, indent=1))
    if before.get("before"):
        store.removed(spark, before["before"])
    return about


def report(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``check, status, violations, rows`` of the last publication."""
    return spark.createDataFrame([tuple(c) for c in manifest(spark, root, name)["checks"]], validate.REPORT)


def steps(spark: SparkSession, root: str, plan: list[tuple[str, Callable[..., DataFrame], list[str], dict]]) -> list[dict]:
    """Runs (name, function of its inputs, names of inputs, rules) in turn; inputs come from manifests, so a step after a
    failed one doesn't run, and what is published stays as it was."""
    return [publish(make(*[published(spark, root, n) for n in inputs]), root, name, rules) for name, make, inputs, rules in plan]
