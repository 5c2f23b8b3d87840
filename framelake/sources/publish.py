"""Immutable numbered publishing: equal bytes are reused, different bytes under one path are refused."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.ordered import hot_join

MANIFEST = "revision int, path string, sha256 string, reused boolean, content string"


class PublishConflict(RuntimeError):
    """The revision would change bytes that were already published, or gives one path two contents."""


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(revision, path, sha256, reused, content) of everything published below ``root``."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def conflicts(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths that were published with other bytes, or that the batch itself lists with two contents."""
    known = manifest.select("path", F.col("sha256").alias("published")).distinct()
    changed = artifacts.join(known, "path").filter(F.col("sha256") != F.col("published")).select("path")
    twice = artifacts.groupBy("path").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high")).filter("low <> high")
    return changed.unionAll(twice.select("path")).distinct()


def publish_revision(artifacts: DataFrame, root: str) -> int:
    """Publish artifacts(path, sha256, payload) as the next revision; all or nothing.

    New payloads go to a content folder of this attempt alone. The manifest rows, which name it, are
    the only commit: they refuse to overwrite, so two writers cannot publish the same number, and an
    attempt that dies before them leaves nothing that anyone reads or that stands in a later one's way.
    """
    spark = artifacts.sparkSession
    manifest = read_manifest(spark, root)
    if not conflicts(artifacts, manifest).isEmpty():
        raise PublishConflict("a path may only ever have one content")
    revision = (manifest.agg(F.max("revision")).first()[0] or 0) + 1
    attempt = f"attempt-{uuid.uuid4().hex}"
    known = manifest.groupBy("sha256").agg(F.min("content").alias("_held"))
    rows = artifacts.dropDuplicates(["path"])
    marked = hot_join(rows, known, ["sha256"], ["path"], "left").withColumn("reused", F.col("_held").isNotNull())
    marked = marked.withColumn("content", F.coalesce("_held", F.lit(attempt)))
    fresh = marked.filter(~F.col("reused")).dropDuplicates(["sha256"]).select("sha256", "payload")
    fresh.write.mode("errorifexists").parquet(f"{root}/content/{attempt}")
    marked.select("path", "sha256", "reused", "content").write.mode("errorifexists").parquet(f"{root}/manifest/revision={revision}")
    return revision
