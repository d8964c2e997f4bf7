"""Order statistics that stay exact when one key holds most of the rows.

A window over such a key would sort it in one task.  Here every key is cut into value ranges whose
boundaries are global quantiles, so no (key, range) group exceeds its share of the whole table; running
totals inside a range are added to the totals of the ranges before it.  Boundaries only balance the
work: any boundaries give the same result.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .spark_support import join_same, stored

RANGE_COLUMN = "_range"


def split_points(df: DataFrame, column: str, parts: int | None = None) -> list[float]:
    """At most `parts` - 1 boundaries of roughly equal row counts (a bounded driver read)."""
    if parts is None:
        parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fractions = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), fractions, max(2000, 4 * parts)).alias("q")).first()
    return sorted(set(row["q"] or []))


def with_range(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    if not points:
        return df.withColumn(RANGE_COLUMN, F.lit(0))
    splits = [-float("inf"), *points, float("inf")]
    cast = df.withColumn("_value", F.col(column).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_value", outputCol=RANGE_COLUMN).transform(cast)
    return out.drop("_value").withColumn(RANGE_COLUMN, F.col(RANGE_COLUMN).cast("int"))


def running_totals(df: DataFrame, keys: list[str], order: str, sums: list[str],
                   points: list[float] | None = None) -> DataFrame:
    """Adds `<s>_before` (total over smaller `order` within the key) and `<s>_total`.

    `order` is numeric, not null and unique within a key (pre-aggregate equal values first).
    """
    if points is None:
        points = split_points(df, order)
    ranged = with_range(df, order, points)
    group = [*keys, RANGE_COLUMN]
    per_range = ranged.groupBy(*group).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    earlier = W.partitionBy(*keys).orderBy(RANGE_COLUMN).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_range.select(
        *group,
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums])
    local = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inside = ranged.withColumns(
        {f"_{s}_inside": F.coalesce(F.sum(s).over(local), F.lit(0)) for s in sums})
    joined = join_same(inside, offsets, group)
    return joined.select(
        *df.columns,
        *[(F.col(f"_{s}_offset") + F.col(f"_{s}_inside")).alias(f"{s}_before") for s in sums],
        *[F.col(f"{s}_total") for s in sums])


def ordinal(df: DataFrame, keys: list[str], order: str, name: str = "ordinal") -> DataFrame:
    """1-based position of each row within its key, by a unique numeric column."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), keys, order, ["_one"])
    return counted.withColumn(name, (F.col("_one_before") + 1).cast("bigint")) \
        .drop("_one", "_one_before", "_one_total")


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: list[float],
                names: list[str]) -> DataFrame:
    """Exact linearly interpolated percentiles per key, one column per fraction."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, keys, value, ["n"])
    out, wanted = [], F.lit(False)
    for p, name in zip(fractions, names):
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        holds_lo = (F.col("n_before") <= lo) & (lo < F.col("n_before") + F.col("n"))
        holds_hi = (F.col("n_before") <= hi) & (hi < F.col("n_before") + F.col("n"))
        wanted = wanted | holds_lo | holds_hi
        low, high = F.max(F.when(holds_lo, F.col(value))), F.max(F.when(holds_hi, F.col(value)))
        out.append((low + (high - low) * F.max(pos - lo)).alias(name))
    return ranked.where(wanted).groupBy(*keys).agg(*out)


def grouped_median(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact median of several columns per key, null keys included; NaN counts as missing.

    One pass: rows are range-partitioned by key and a salt, so every partition holds its share of the table whatever
    the keys.  A key that lies inside a partition is finished there, all columns at once.  Only keys at the rim
    of a partition (at most two each, a hot key among them) can go on elsewhere; their rows are cut into value ranges.
    A key without any value has null medians; an empty table has no rows.
    """
    number = lambda v: F.col(v).cast("double")
    rows = df.select(*keys, *[F.when(~F.isnan(number(v)), number(v)).alias(v) for v in values])
    salted = rows.withColumn("_salt", F.xxhash64(F.spark_partition_id(), *values))
    ordered = salted.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys).select(*keys, *values)
    schema = T.StructType([*rows.schema.fields, T.StructField("_whole", T.BooleanType())])
    done = stored(ordered.mapInArrow(_median_runs(len(keys)), schema), "medians")
    split = _split_median(done.where("not _whole").select(*keys, *values), keys, values)
    return done.where("_whole").select(*keys, *values).unionByName(split)


def _median_runs(n_keys: int, most: int = 1_000_000):
    """Over sorted rows: one row of medians per run of equal keys (`_whole`), and the rows as they are of the first run,
    the last run and any of more than `most` rows, so that memory is bounded by one batch and `most` rows."""

    def changes(table: pa.Table) -> np.ndarray:
        differs = np.zeros(max(len(table) - 1, 0), bool)
        for column in table.columns[:n_keys]:
            codes = pa.concat_arrays(column.chunks).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            differs |= codes[1:] != codes[:-1]
        return np.flatnonzero(differs) + 1

    def marked(table: pa.Table, whole: bool):
        return table.append_column("_whole", pa.array(np.full(len(table), whole))).to_batches()

    def medians(table: pa.Table, starts: np.ndarray) -> pa.Table:
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        out = table.take(pa.array(starts))
        for i in range(n_keys, table.num_columns):
            x = table.column(i).to_numpy()
            has = ~np.isnan(x)
            x, owner = x[has], run[has]
            x = x[np.lexsort((x, owner))]
            n = np.bincount(owner, minlength=len(starts))
            first, some = np.cumsum(n) - n, n > 0
            median = np.full(len(starts), np.nan)
            low, high = x[(first + (n - 1) // 2)[some]], x[(first + n // 2)[some]]
            median[some] = low + (high - low) * 0.5
            out = out.set_column(i, table.field(i), pa.array(median, mask=~some))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw = None, True  # the run still open, and whether its rows pass as they are
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            starts = np.append(0, changes(held))
            if raw:
                if len(starts) == 1:  # one row stays, to be compared with what follows
                    yield from marked(held.slice(0, len(held) - 1), False)
                    held = held.slice(len(held) - 1)
                    continue
                yield from marked(held.slice(0, starts[1]), False)
                held, starts, raw = held.slice(starts[1]), starts[1:] - starts[1], False
            if starts[-1]:
                yield from marked(medians(held.slice(0, starts[-1]), starts[:-1]), True)
                held = held.slice(starts[-1])
            if len(held) > most:
                yield from marked(held.slice(0, len(held) - 1), False)
                held, raw = held.slice(len(held) - 1), True
        if held is not None:
            yield from marked(held, False)

    return run


def _split_median(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The same medians where a key may hold any share of the rows: values are range-partitioned (equal ones by a salt), so
    that a position in the stored order is a rank; counts per key and partition tell which positions hold the middle."""
    long = df.withColumn("_salt", F.xxhash64(F.spark_partition_id(), *values)).select(*keys, "_salt", F.explode(F.array(*[
        F.struct(F.lit(i).alias("_band"), F.col(v).alias("_x")) for i, v in enumerate(values)])).alias("_e")) \
        .select(*keys, "_e._band", "_e._x", "_salt")
    order = [*keys, "_band", "_x"]
    ranked = stored(long.repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
                    .select(*order, F.monotonically_increasing_id().alias("_at")), "ranked")
    part = ranked.groupBy(*keys, "_band", F.shiftright("_at", 33).alias("_part")).agg(
        F.count("_x").alias("_n"), F.min("_at").alias("_first"), F.min(F.when(F.col("_x").isNotNull(), F.col("_at"))).alias("_start"))
    key = W.partitionBy(*keys, "_band")
    earlier = key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    placed = part.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_total": F.sum("_n").over(key)})
    middle = [F.floor((F.col("_total") + off) / 2) - F.col("_before") for off in (-1, 0)]
    # a band without values points to a null row, so that its key stays
    wanted = placed.select(F.explode(F.when(F.col("_total") == 0, F.array("_first")).otherwise(F.array(*[
        F.when((m >= 0) & (m < F.col("_n")), F.col("_start") + m) for m in middle]))).alias("_at")).where("_at is not null").distinct()
    found = ranked.join(wanted, "_at")
    of = lambda i: F.when(F.col("_band") == i, F.col("_x"))
    return found.groupBy(*keys).agg(*[
        (F.min(of(i)) + (F.max(of(i)) - F.min(of(i))) * 0.5).alias(v) for i, v in enumerate(values)])


def top_n(df: DataFrame, keys: list[str], order: list, n: int, spread: str, salts: int = 32,
          rank: str | None = None) -> DataFrame:
    """First n rows per key.  A hot key is cut to n rows per salt before its final ranking.

    `order` must be a total order; `spread` is the column whose hash salts the key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    cut = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    final = W.partitionBy(*keys).orderBy(*order)
    name = rank or "_rn"
    out = cut.withColumn(name, F.row_number().over(final)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by `order`; combined map-side, so hot keys cost nothing extra."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
