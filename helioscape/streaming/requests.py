"""Location requests as an unbounded stream."""
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import first_per_key

DAY_S = 24 * 3600


def read_requests(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """File stream; `ts` becomes a zoned timestamp because a watermark needs one."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def answer_stream(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Append answers as they arrive; `answer` is a row-wise plan with joins to static tables."""
    return answer(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()


def answer_batches(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """For answers that aggregate (nearest cell): the batch operator runs on each micro-batch.

    A batch overwrites its own folder, so a replayed batch leaves one copy.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_requests(stream: DataFrame, key: str, request_id: str, out: str, checkpoint: str):
    """Log of (request_id, key, ts); a batch overwrites its own folder. No row is late: the log has no watermark."""
    slim = stream.select(F.col(request_id).alias("request_id"), F.col(key).cast("string").alias("key"), "ts")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return slim.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_day(requests: DataFrame, ttl_s: int = DAY_S) -> DataFrame:
    """(request_id, key, ts, cache_hit): a repeat within `ttl_s` of the request that was answered is a cache hit.

    By event time (then request_id), so the order and the batches in which requests arrived do not matter. Rows are
    sorted by key within partitions and folded as a stream with one timestamp of state: a hot key costs time in
    its task, not memory. Requests without a time are answered and are never hits.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor = object(), None
        for rows in batches:
            hits = []
            missing = rows["ts"].isna()
            for k, t, none in zip(rows["key"], rows["ts"].astype("int64") // 1_000, missing, strict=True):
                if k != key:
                    key, anchor = k, None
                fresh = bool(none) or anchor is None or t >= anchor + ttl_s * 1_000_000
                if fresh and not none:
                    anchor = t
                hits.append(not fresh)
            yield rows.assign(cache_hit=hits)

    in_time = requests.select("request_id", "key", F.col("ts").cast("timestamp").alias("ts")) \
        .repartition("key").sortWithinPartitions("key", "ts", "request_id")
    return in_time.mapInPandas(fold, "request_id long, key string, ts timestamp, cache_hit boolean")


def keep_best(stream: DataFrame, keys: list[str], order: list[str], out: str, checkpoint: str):
    """Log of the best row per key of each batch; late live results outrank estimates when the log is read."""
    def run(batch: DataFrame, batch_id: int) -> None:
        first_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_results(spark: SparkSession, out: str, schema, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(spark.read.schema(schema).parquet(out), keys, order)
