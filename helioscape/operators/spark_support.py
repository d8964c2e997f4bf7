"""Session-level helpers: the shared folder, lineage cuts and deterministic uniforms."""
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir. Only a local master may go without: driver and tasks then share a private one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor share")
    global _fallback
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="helioscape-")
    return _fallback


_fallback: str | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/helioscape/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a written table: computed once, and later stages survive executor loss."""
    return stored(df, "cut")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: columnar, prunable, reusable by several plans."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """Side of a join that grows with the input: it is shuffled, never sent whole through the driver.

    Spark's size check sees packed files, and rows before they are exploded, so it takes such a table for a small one.
    """
    return df.hint("merge")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a null equals a null; the keys stay as they are on the left."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = reduce(Column.__and__, [left[k].eqNullSafe(other[f"_same_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"_same_{k}" for k in keys])


def uniform(key: Column, salt: str = "42") -> Column:
    """Reproducible uniform in (0,1) derived from a key; equal across engines and task retries."""
    digest = F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def hash_fold(key: Column, folds: int = 5, salt: str = "42") -> Column:
    digest = F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(folds)).cast("int")
