"""Descriptive statistics of feature tables.  Columns are unpivoted once, so one pass serves all features."""
from pyspark.sql import DataFrame, functions as F

from .ordered import percentiles, running_totals


def unpivot(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep.., feature, x)."""
    e = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    return df.select(*(keep or []), e.alias("_e")).select(*(keep or []), "_e.feature", "_e.x")


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """count, mean, std (sample), min, exact quartiles and max per feature."""
    long = unpivot(df, features)
    plain = long.groupBy("feature").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev("x").alias("std"),
                                        F.min("x").alias("min"), F.max("x").alias("max"))
    q = percentiles(long, ["feature"], "x", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return plain.join(q, "feature")


def missing_pct(df: DataFrame, features: list[str]) -> DataFrame:
    long = unpivot(df, features)
    out = long.groupBy("feature").agg((F.avg(F.col("x").isNull().cast("double")) * 100).alias("pct"),
                                      F.sum(F.col("x").isNull().cast("bigint")).alias("n_missing"))
    return out.where(F.col("pct") > 0)


def label_medians(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, negative, positive): exact medians by class."""
    med = percentiles(unpivot(df, features, [label]), [label, "feature"], "x", [0.5], ["m"])
    pick = lambda v: F.max(F.when(F.col(label) == v, F.col("m")))
    return med.groupBy("feature").agg(pick(0).alias("negative"), pick(1).alias("positive"))


def epoch_change(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Median before, now, and the change, per feature and class."""
    long = unpivot(df, [f"{f}_pre" for f in features] + features, [label])
    med = percentiles(long, [label, "feature"], "x", [0.5], ["m"])
    base = F.regexp_replace("feature", "_pre$", "")
    before = F.max(F.when(F.col("feature").endswith("_pre"), F.col("m")))
    now = F.max(F.when(~F.col("feature").endswith("_pre"), F.col("m")))
    return med.groupBy(base.alias("index"), label).agg(before.alias("before"), now.alias("now"), (now - before).alias("change"))


def quantile_limits(df: DataFrame, features: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    return percentiles(unpivot(df, features), ["feature"], "x", [low, high], ["lo", "hi"])


def class_histogram(df: DataFrame, features: list[str], label: str, bins: int = 40) -> DataFrame:
    """Density per bin and class; values are clipped to the feature's 1 % and 99 % limits."""
    long = unpivot(df, features, [label]).where("x is not null")
    limits = quantile_limits(df, features)
    met = long.join(F.broadcast(limits), "feature")  # one row per feature
    width = (F.col("hi") - F.col("lo")) / (bins - 1)
    clipped = F.least(F.greatest("x", "lo"), F.col("hi"))
    b = F.least(F.floor((clipped - F.col("lo")) / width), F.lit(bins - 2)).cast("int")
    counts = met.groupBy("feature", label, b.alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("width"))
    totals = counts.groupBy("feature", label).agg(F.sum("n").alias("total"))
    return counts.join(totals, ["feature", label]).select(
        "feature", label, "bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def class_shares(df: DataFrame, name: str, top: int = 8) -> DataFrame:
    """Most frequent names with their share of the named rows in percent."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).withColumn("_k", F.lit(1))
    shares = counts.withColumn("_k", F.lit(1)).join(total, "_k").select(name, "n", (F.col("n") / F.col("t") * 100).alias("share"))
    return shares.orderBy(F.desc("n"), name).limit(top)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with margins; the total row is labelled All."""
    # counts first, so that the roll-up sees a handful of rows
    counts = df.groupBy(row, column).agg(F.count("*").alias("_c"))
    wide = counts.groupBy(row).agg(*[F.sum(F.when(F.col(column) == v, F.col("_c")).otherwise(0)).alias(str(v)) for v in values],
                                 F.sum("_c").alias("total"))
    margins = wide.rollup(row).agg(*[F.sum(str(v)).alias(str(v)) for v in values], F.sum("total").alias("total"))
    return margins.withColumn(row, F.coalesce(row, F.lit("All")))


def spearman(df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(a, b, rho) for all feature pairs, over rows where every feature is present.

    Average ranks come from counts of distinct values, so a feature with few values is ranked on few rows.
    """
    complete = df.select(row_id, *features).na.drop(subset=features)
    long = unpivot(complete, features, [row_id])
    counts = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    ranked = running_totals(counts, ["feature"], "x", ["n"]).select(
        "feature", "x", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))
    ranks = long.join(ranked, ["feature", "x"])
    wide = ranks.groupBy(row_id).agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    e = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs]))
    return row.select(e.alias("e")).select("e.*")


def importance_share(df: DataFrame, name: str, value: str) -> DataFrame:
    """Shares of the total, ranked (a short table of features)."""
    total = df.agg(F.sum(value).alias("_t")).withColumn("_k", F.lit(1))
    shares = df.withColumn("_k", F.lit(1)).join(total, "_k").select(name, (F.col(value) / F.col("_t")).alias("share"))
    return shares.orderBy(F.desc("share"), name)


def mean_abs_contribution(contributions: DataFrame, features: list[str]) -> DataFrame:
    long = unpivot(contributions, features)
    return long.groupBy("feature").agg(F.avg(F.abs("x")).alias("mean_abs"))
