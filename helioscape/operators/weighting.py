"""Pairwise judgements to criterion weights, for many experts at once."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from .spark_support import join_same


def pair_list(criteria: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(criteria) for b in criteria[i + 1:]]


def principal_weights(upper: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, lambda) of a stack of reciprocal matrices given by their upper triangles (rows)."""
    stack = np.ones((len(upper), n, n))
    i, j = np.triu_indices(n, 1)
    stack[:, i, j] = upper
    stack[:, j, i] = 1.0 / upper
    values, vectors = np.linalg.eig(stack)
    top = np.argmax(values.real, axis=1)
    rows = np.arange(len(upper))
    w = np.abs(vectors[rows, :, top].real)
    return w / w.sum(axis=1, keepdims=True), values.real[rows, top]


def expert_weights(judgements: DataFrame, expert: str, criteria: list[str]) -> DataFrame:
    """judgements (expert, a, b, ratio) -> expert, weights, lambda_max, ci, cr.

    Judgements are pivoted into one fixed-length array per expert (the geometric mean of repeats), then
    eigenvectors are taken for a whole Arrow batch at a time.  An expert without a full set has null figures.
    """
    pairs = pair_list(criteria)
    n = len(criteria)
    picked = []
    for a, b in pairs:
        same, flipped = (F.col("a") == a) & (F.col("b") == b), (F.col("a") == b) & (F.col("b") == a)
        picked.append(F.exp(F.avg(F.when(same, F.log("ratio")).when(flipped, -F.log("ratio")))))
    wide = judgements.groupBy(expert).agg(F.array(*picked).alias("upper"))
    whole = wide.where(~F.exists("upper", lambda x: x.isNull()))
    index = K.RANDOM_INDEX[n]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            w, lam = principal_weights(np.stack(pdf["upper"].to_numpy()), n)
            ci = (lam - n) / (n - 1)
            yield pd.DataFrame({expert: pdf[expert].to_numpy(), "weights": list(w), "lambda_max": lam, "ci": ci,
                                "cr": ci / index if index > 0 else np.zeros_like(ci)})

    kind = judgements.schema[expert].dataType.simpleString()
    solved = whole.mapInPandas(solve, f"{expert} {kind}, weights array<double>, lambda_max double, ci double, cr double")
    return join_same(wide.select(expert), solved, [expert], "left")


def group_judgement(judgements: DataFrame) -> DataFrame:
    """Geometric mean of all experts per ordered pair (a, b)."""
    flip = F.col("a") > F.col("b")
    ordered = judgements.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                                F.when(flip, -F.log("ratio")).otherwise(F.log("ratio")).alias("l"))
    return ordered.groupBy("a", "b").agg(F.exp(F.avg("l")).alias("ratio"), F.count("*").alias("n"))


def judged_weights(criteria: list[str], upper: dict[tuple[str, str], float]) -> dict:
    """Weights of one fixed set of judgements (a 6 x 6 or 7 x 7 matrix)."""
    n = len(criteria)
    w, lam = principal_weights(np.array([[float(upper[p]) for p in pair_list(criteria)]]), n)
    ci = (lam[0] - n) / (n - 1)
    return {"weights": dict(zip(criteria, w[0].tolist())), "lambda_max": float(lam[0]), "CI": float(ci), "CR": float(ci / K.RANDOM_INDEX[n])}
