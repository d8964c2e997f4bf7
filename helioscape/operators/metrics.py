"""Evaluation of scores against labels."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K
from ..functions.nulls import num
from .ordered import running_totals
from .spark_support import join_same


def _score_counts(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score: ties collapse before anything is ordered."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum((y == 1).cast("bigint")).alias("pos"), F.sum((y == 0).cast("bigint")).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Exact area under the curve with ties, per key; null when a key has one class only."""
    keys = keys or []
    ranked = running_totals(_score_counts(df, label, score, keys), keys, "_s", ["neg"])
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(won).alias("_won"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    product = (F.col("_p") * F.col("_n")).cast("double")
    return sums.select(*keys, F.when(product > 0, F.col("_won") / product).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """One row per distinct score: false and true positive rate at threshold >= score."""
    keys = keys or []
    ranked = running_totals(_score_counts(df, label, score, keys), keys, "_s", ["pos", "neg"])
    return ranked.select(*keys, F.col("_s").alias("threshold"),
                         ((F.col("neg_total") - F.col("neg_before")) / F.col("neg_total")).alias("fpr"),
                         ((F.col("pos_total") - F.col("pos_before")) / F.col("pos_total")).alias("tpr"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(num(0))


def classification(df: DataFrame, label: str, score: str, keys: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and the confusion counts, in one aggregate."""
    yes, y = F.col(score) >= num(threshold), F.col(label) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    counts = df.groupBy(*(keys or [])).agg(count(yes & y).alias("tp"), count(yes & ~y).alias("fp"),
                                           count(~yes & y).alias("fn"), count(~yes & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(*(keys or []), "tp", "fp", "fn", "tn", (tp + fp + fn + tn).alias("n"), (tp + fn).alias("n_pos"),
                         _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
                         _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def evaluate(df: DataFrame, label: str, score: str, keys: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """classification plus AUC."""
    keys = keys or []
    c = classification(df, label, score, keys, threshold)
    a = roc_auc(df, label, score, keys)
    if keys:
        return c.join(a, keys, "left")
    return c.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def by_region(df: DataFrame, label: str, score: str, region: str = "region", is_test: str = "is_test") -> DataFrame:
    """evaluate per region with test size, low-sample flag and note."""
    sizes = df.groupBy(region).agg(F.sum(F.col(is_test).cast("bigint")).alias("n_test"))
    low = F.col("n_pos") < K.LOW_SAMPLE_POSITIVES
    note = F.when(low, F.format_string("%d plants only: the figures of this region vary widely", "n_pos")).otherwise("")
    return join_same(evaluate(df, label, score, [region]), sizes, [region]).withColumns({"low_sample": low, "note": note})


def region_mean_auc(df: DataFrame, label: str, score: str, region: str = "region") -> DataFrame:
    """Mean AUC over the regions that have both classes."""
    return roc_auc(df, label, score, [region]).agg(F.avg("auc").alias("auc"))


def fold_summary(fold_auc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return fold_auc.groupBy(*(keys or [])).agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.count("auc").alias("folds"))


def best_variant(scores: DataFrame, name: str, score: str, position: str) -> DataFrame:
    """Highest score; ties keep the variant listed first."""
    return scores.agg(F.max_by(name, F.struct(F.col(score), -F.col(position))).alias("best"))


def balanced_weights(df: DataFrame, region: str, label: str) -> DataFrame:
    """Adds `weight`: every (region, class) cell gets the same total, capped at 10 x median, mean one.

    Weights depend on the cell only, so everything is computed on the small table of cells.  The median over
    rows is the weight of the cell in which the middle row falls.
    """
    r = F.coalesce(F.col(region), F.lit("Other"))
    marked = df.withColumn("_r", r)
    cells = marked.groupBy("_r", label).agg(F.count("*").alias("_c"))
    everything = W.partitionBy()
    upto = W.orderBy("_w", "_r", label).rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumns({"_n": F.sum("_c").over(everything), "_k": F.count("*").over(everything)})
    cells = cells.withColumn("_w", F.col("_n") / F.col("_k") / F.col("_c"))
    cells = cells.withColumn("_upto", F.sum("_c").over(upto))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = lambda rank: (F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto"))
    mid = (F.max(F.when(holds(low), F.col("_w"))).over(everything) + F.max(F.when(holds(high), F.col("_w"))).over(everything)) / 2
    cells = cells.withColumn("_capped", F.least("_w", mid * num(K.MAX_WEIGHT_RATIO)))
    total = F.sum(F.col("_capped") * F.col("_c")).over(everything)
    cells = cells.select("_r", label, (F.col("_capped") * F.col("_n") / total).alias("weight"))
    return join_same(marked, cells, ["_r", label]).drop("_r")
