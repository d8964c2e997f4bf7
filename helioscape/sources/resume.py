"""Long computations over points in batches that go on where a lost run stopped.

A batch is known by the hash of its points. Rows are appended under the number of their commit, and only then are the commit's
batches listed; rows of commits that are not listed are never read. A run that dies loses at most the commit it worked on.
"""
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.shaping import batch_keys
from ..operators.spark_support import stored

LISTED = "batch_key string, _commit string"


def finished_batches(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_key, _commit) of every batch that is done; a folder without any gives no rows."""
    spark.createDataFrame([], LISTED).write.mode("append").parquet(f"{folder}/listed")
    return spark.read.schema(LISTED).parquet(f"{folder}/listed")


def resume(points: DataFrame, id_col: str, compute: Callable[[DataFrame], DataFrame], folder: str, size: int = 400,
           commits: int = 8, at_most: int | None = None) -> DataFrame:
    """Rows of `compute` for all batches of `points` (`id_col`, lat, lon and more), computing those that `folder` lacks.

    `compute` gets rows with their batch_key and keeps that column. Missing batches are dealt to `commits` commits by hash; a call that
    may write `at_most` so many returns what is done by then.
    Ids are unique; batches whose points changed are new ones, and only those of these points are returned. No points give no rows.
    """
    spark = points.sparkSession
    numbered, keys = batch_keys(points, id_col, size)
    keyed = stored(numbered.join(keys.select("batch", "batch_key"), "batch").drop("batch"), "batches")
    share, written = F.pmod(F.xxhash64("batch_key"), F.lit(commits)), 0
    for number in range(commits):
        if written == at_most:
            break
        missing = keyed.where(share == number).join(finished_batches(spark, folder), "batch_key", "left_anti")
        if missing.isEmpty():
            continue
        name = uuid.uuid4().hex
        compute(missing).withColumn("_commit", F.lit(name)).write.mode("append").parquet(f"{folder}/rows")
        missing.select("batch_key").distinct().withColumn("_commit", F.lit(name)).write.mode("append").parquet(f"{folder}/listed")
        written += 1
    schema = compute(keyed).withColumn("_commit", F.lit("")).schema
    listed = finished_batches(spark, folder).join(keyed.select("batch_key").distinct(), "batch_key", "left_semi")
    if listed.isEmpty():
        return spark.createDataFrame([], schema).drop("_commit", "batch_key")
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    return rows.join(listed, ["batch_key", "_commit"], "left_semi").drop("_commit", "batch_key")
