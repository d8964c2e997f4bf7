"""Suitability models on MLlib, evaluated on spatial folds.

Fitting, scoring and evaluation are distributed; the driver holds parameters only (medians, knots,
coefficients), whose number depends on the features and not on the rows.
"""
import hashlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.features import exclusion_reason, temper
from ..functions.nulls import num
from . import metrics as M
from .ordered import percentiles
from .profile import unpivot
from .spark_support import scratch_path, shared_dir, stored

KNOT_FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
#: Bytes of unpacked numbers that one task of a fit holds.
FIT_BYTES = 32 << 20


def fit_medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact median per feature of the training rows (one value per feature on the driver)."""
    rows = percentiles(unpivot(train, features), ["feature"], "x", [0.5], ["m"]).collect()
    found = {r["feature"]: r["m"] for r in rows}
    return {f: found.get(f, 0.0) for f in features}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f), num(m)) for f, m in medians.items()})


def spread(train: DataFrame, numbers: int, size: int = FIT_BYTES) -> DataFrame:
    """Training rows in as many parts as their unpacked numbers need; few rows stay as they lie.

    A fit keeps its rows unpacked and reads them in every iteration, while their file is packed and split by its own size.
    """
    parts = -(-train.count() * numbers * 8 // size)
    return train.repartition(parts) if parts > 1 else train


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """weight = rows / (2 x rows of the class)."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    w = None
    for value, count in n.items():
        weight = num(total / (len(n) * count))
        w = F.when(F.col(label) == value, weight) if w is None else w.when(F.col(label) == value, weight)
    return df.withColumn("weight", w)


def _sql(value: float) -> str:
    return f"({float(value)!r}D)"


@dataclass
class TreeModel:
    """Imputation plus an MLlib tree ensemble."""

    kind: str = "forest"
    trees: int = 400
    depth: int = 12
    seed: int = K.SEED

    def fit(self, train: DataFrame, features: list[str], label: str, weight: str | None = None) -> "TreeModel":
        self.features = features
        self.medians = fit_medians(train, features)
        ready = impute(spread(train, len(features) + 2), self.medians)
        if self.kind == "forest":
            if weight is None:
                ready, weight = class_balance(ready, label), "weight"
            estimator = RandomForestClassifier(
                featuresCol="features", labelCol=label, numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=2,
                featureSubsetStrategy="sqrt", seed=self.seed, weightCol=weight)
        else:
            context = train.sparkSession.sparkContext
            if context.getCheckpointDir() is None:  # every round adds to one lineage, which is cut every ten
                context.setCheckpointDir(shared_dir(train.sparkSession))
            estimator = GBTClassifier(featuresCol="features", labelCol=label, maxIter=self.trees, maxDepth=min(self.depth, 6),
                                      stepSize=0.05, subsamplingRate=0.8, seed=self.seed, featureSubsetStrategy="0.8",
                                      minInstancesPerNode=2)
            if weight:
                estimator = estimator.setWeightCol(weight)
        stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), estimator]
        self.pipeline = Pipeline(stages=stages).fit(ready.withColumn(label, F.col(label).cast("double")))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `p`; rows keep their own (unimputed) feature values."""
        holders = {f"_raw_{f}": F.col(f) for f in self.features}
        ready = impute(df.withColumns(holders), self.medians)
        out = self.pipeline.transform(ready).withColumn("p", vector_to_array("probability")[1])
        back = out.withColumns({f: F.col(f"_raw_{f}") for f in self.features})
        return back.drop("features", "rawPrediction", "probability", "prediction", *holders)

    def importances(self, spark) -> DataFrame:
        values = self.pipeline.stages[-1].featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, values)), "feature string, importance double")


@dataclass
class MonotoneModel:
    """Additive logistic model over ramps between quantile knots.

    Every ramp of a constrained feature has a coefficient of one sign, so the score cannot move the wrong way
    in that feature.  Being additive, it explains itself exactly.
    """

    directions: dict | None = None
    ridge: float = 1e-3
    max_iter: int = 60
    tolerance: float = 1e-3

    def fit(self, train: DataFrame, features: list[str], label: str, weight: str | None = None) -> "MonotoneModel":
        signs = K.MONOTONE if self.directions is None else self.directions
        self.features = features
        names = [f"q{i}" for i in range(len(KNOT_FRACTIONS))]
        rows = percentiles(unpivot(train, features), ["feature"], "x", KNOT_FRACTIONS, names).collect()
        quantiles = {r["feature"]: [r[n] for n in names] for r in rows}
        middle = KNOT_FRACTIONS.index(0.5)
        self.medians = {f: quantiles[f][middle] if f in quantiles else 0.0 for f in features}
        ready = impute(train, self.medians)
        self.ramps = []
        for f in features:
            knots = sorted(set(quantiles.get(f, [0.0, 1.0])))
            if len(knots) == 1:
                knots = [knots[0], knots[0] + 1.0]
            self.ramps += [(f, a, b) for a, b in zip(knots, knots[1:])]
        lo = [0.0 if signs.get(f, 0) > 0 else float("-inf") for f, _, _ in self.ramps]
        hi = [0.0 if signs.get(f, 0) < 0 else float("inf") for f, _, _ in self.ramps]
        assembled = self._assemble(spread(ready, len(self.ramps) + 2)).withColumn(label, F.col(label).cast("double"))
        p = len(self.ramps)
        lr = LogisticRegression(featuresCol="ramps", labelCol=label, regParam=self.ridge, elasticNetParam=0.0, maxIter=self.max_iter, tol=self.tolerance,
                                lowerBoundsOnCoefficients=DenseMatrix(1, p, lo), upperBoundsOnCoefficients=DenseMatrix(1, p, hi))
        if weight:
            lr = lr.setWeightCol(weight)
        fitted = lr.fit(assembled)
        self.coefficients = [float(c) for c in fitted.coefficients.toArray()]
        self.intercept = float(fitted.intercept)
        mean = assembled.select(Summarizer.mean(F.col("ramps")).alias("m")).first()["m"]
        self.means = [float(v) for v in mean]
        return self

    @staticmethod
    def _ramp(x: str, a: float, b: float) -> str:
        """0 up to a, 1 from b on, linear between; SQL text, because a model has many of them."""
        return f"least(greatest(({x} - {_sql(a)}) / {_sql(b - a)}, 0D), 1D)"

    def _assemble(self, ready: DataFrame) -> DataFrame:
        names = [f"_r{i}" for i in range(len(self.ramps))]
        wide = ready.withColumns({n: F.expr(self._ramp(f"`{f}`", a, b)) for n, (f, a, b) in zip(names, self.ramps)})
        return VectorAssembler(inputCols=names, outputCol="ramps").transform(wide).drop(*names)

    def contribution(self, feature: str) -> Column:
        """Log-odds the feature adds relative to an average training row; missing values take the median."""
        x = f"coalesce(`{feature}`, {_sql(self.medians[feature])})"
        terms = [f"{_sql(w)} * ({self._ramp(x, a, b)} - {_sql(m)})"
                 for (f, a, b), w, m in zip(self.ramps, self.coefficients, self.means) if f == feature and w != 0.0]
        return F.expr(" + ".join(terms) or "0D")

    @property
    def base(self) -> float:
        return self.intercept + sum(w * m for w, m in zip(self.coefficients, self.means))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `log_odds` (contribution of each feature, in order) and `p`; plain column arithmetic."""
        parts = df.withColumn("log_odds", F.array(*[self.contribution(f) for f in self.features]))
        z = F.aggregate("log_odds", num(self.base), lambda a, x: a + x)
        return parts.withColumn("p", num(1) / (num(1) + F.exp(-z)))

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "medians": self.medians, "ramps": self.ramps, "coefficients": self.coefficients,
                           "intercept": self.intercept, "means": self.means})

    @classmethod
    def from_json(cls, text: str) -> "MonotoneModel":
        d = json.loads(text)
        model = cls()
        for k, v in d.items():
            setattr(model, k, v)
        model.ramps = [tuple(r) for r in model.ramps]
        return model


# ---------------------------------------------------------------- evaluation loops

def fold_predictions(make, df: DataFrame, features: list[str], label: str, fold: str, folds: int = 5,
                     weight: str | None = None, train_mask: str | None = None) -> DataFrame:
    """Out-of-fold `p` for every row: one distributed fit per fold over a table written once."""
    data = stored(df, "folds")

    def held_out(k: int) -> DataFrame:
        train = data.where(F.col(fold) != k)
        model = make().fit(train.where(train_mask) if train_mask else train, features, label, weight)
        return model.predict(data.where(F.col(fold) == k))

    # fits are independent: their jobs are submitted together and share the cluster
    with ThreadPoolExecutor(max_workers=folds) as pool:
        parts = list(pool.map(held_out, range(folds)))
    return reduce(DataFrame.unionByName, parts)


def spatial_cv(make, df: DataFrame, features: list[str], label: str, fold: str, weight: str | None = None,
               train_mask: str | None = None, reliable: str | None = None) -> DataFrame:
    """AUC per fold, over all held-out rows and over plants versus reliable negatives."""
    oof = stored(fold_predictions(make, df, features, label, fold, weight=weight, train_mask=train_mask), "oof")
    out = M.roc_auc(oof, label, "p", [fold])
    if reliable:
        trusted = M.roc_auc(oof.where(F.col(reliable) | (F.col(label) == 1)), label, "p", [fold])
        out = out.join(trusted.withColumnRenamed("auc", "auc_reliable"), fold, "left")
    return out


def leakage_experiment(make, frames: dict[str, DataFrame], label: str, id_col: str, is_test: str) -> DataFrame:
    """Each variant fitted once, scored on its own test rows and on pre-construction land."""
    spark = next(iter(frames.values())).sparkSession
    held = {c: None for c in (id_col, label, is_test)}
    out = None
    clean = frames["clean"].where(is_test)
    for name, frame in frames.items():
        features = [c for c in frame.columns if c not in held]
        model = make().fit(frame.where(f"not {is_test}"), features, label)
        runs = [("own", frame.where(is_test))]
        if set(features) <= set(clean.columns):
            runs.append(("pre_construction", clean))
        for land, test in runs:
            m = M.evaluate(model.predict(test), label, "p").withColumns({"variant": F.lit(name), "land": F.lit(land), "n_features": F.lit(len(features))})
            out = m if out is None else out.unionByName(m)
    return out


def transfer_eval(scores: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """Several score columns on the same rows, one pass: the columns are unpivoted and evaluated by name."""
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in columns.items()]))
    return M.evaluate(scores.select(label, e.alias("e")).select(label, "e.*"), label, "p", ["model"])


def batch_score(df: DataFrame, p: str = "p", landcover: str = "landcover") -> DataFrame:
    """Tempered 0-100 score; excluded land scores 0."""
    reason = exclusion_reason(F.col(landcover), F.col("slope"))
    return df.withColumns({"model_score": temper(F.col(p)), "excluded": reason}) \
        .withColumn("score", F.when(F.col("excluded").isNull(), F.col("model_score")).otherwise(num(0)))


# ---------------------------------------------------------------- explanations

def explain(df: DataFrame, model: MonotoneModel, top: int | None = None) -> DataFrame:
    """Adds base_score and, from `log_odds` of the model, `contributions`: array of structs sorted by impact, rescaled to score points.

    Points add up to score - base_score; a sum below 1e-9 gives 0 points each.
    """
    label = lambda f: K.FEATURE_LABELS.get(f, ("Land cover: " + f[3:].title() if f.startswith("lc_") else f, "", ""))
    base_score = num(100) / (num(1) + F.exp(-num(model.base) / num(K.SCORE_TEMPERATURE)))
    staged = df.withColumns({"base_score": base_score, "_total": F.aggregate("log_odds", num(0), lambda a, x: a + x)})
    scale = F.when(F.abs("_total") > 1e-9, (F.col("model_score") - F.col("base_score")) / F.col("_total")).otherwise(num(0))
    staged = staged.withColumn("_scale", scale)
    # sorted as structs that begin with impact and place: a comparison of two costs no expression
    each = [F.struct((-F.abs(x)).alias("order"), F.lit(i).alias("i"), F.lit(f).alias("feature"),
                     *[F.lit(v).alias(n) for n, v in zip(("label", "unit", "source"), label(f))],
                     F.col(f).alias("value"), x.alias("log_odds"), (x * F.col("_scale")).alias("points"))
            for i, f in enumerate(model.features) for x in (F.col("log_odds")[i],)]
    ordered = F.sort_array(F.array(*each))
    if top:
        ordered = F.slice(ordered, 1, top)
    tidy = F.transform(ordered, lambda o: F.struct(*[o[n].alias(n) for n in ("feature", "label", "unit", "source", "value", "log_odds", "points")]))
    return staged.withColumn("contributions", tidy).drop("_total", "_scale")


# ---------------------------------------------------------------- bundles

def save_bundle(spark, path: str, model: TreeModel | MonotoneModel, facts: dict) -> None:
    """Model parameters plus one metadata row (thresholds, provenance, trained rows)."""
    meta = {**facts, "features": model.features, "medians": model.medians, "class_thresholds": {"High": K.HIGH_SCORE, "Medium": K.MEDIUM_SCORE}}
    if isinstance(model, TreeModel):
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta["kind"] = model.kind
    else:
        meta["kind"], meta["model"] = "monotone", model.to_json()
    spark.createDataFrame([(json.dumps(meta),)], "metadata string").write.mode("overwrite").text(f"{path}/metadata")


def load_bundle(spark, path: str):
    """(model, metadata)."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta["kind"] == "monotone":
        return MonotoneModel.from_json(meta["model"]), meta
    model = TreeModel(kind=meta["kind"])
    model.pipeline = PipelineModel.load(f"{path}/pipeline")
    model.features, model.medians = meta["features"], meta["medians"]
    return model, meta


# ---------------------------------------------------------------- registry

REGISTRY = "name string, key string, path string"


def table_key(df: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order: one aggregate, nothing sorted."""
    cells = [c for name in df.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{row['n']}|{row['h']}".encode()).hexdigest()


def _registry(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/helioscape/models"


def _bundles(spark, name: str, key: str) -> list:
    """Finished bundles of a model in a fixed order; none where nothing was registered yet."""
    try:
        index = spark.read.schema(REGISTRY).option("recursiveFileLookup", True).parquet(_registry(spark))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return index.where((F.col("name") == name) & (F.col("key") == key)).orderBy("path").collect()


def registered(spark, name: str, source: DataFrame, recipe: str, fit: Callable[[], TreeModel | MonotoneModel]) -> TreeModel | MonotoneModel:
    """The model of that name for these source rows and this recipe: loaded if it was ever saved, else fitted, saved and loaded.

    The registry is a table in the shared folder with one row a bundle. A row is written once its bundle is complete, so a
    fit that died leaves none, and in a folder of its own, as two appends to one folder at once remove each other's
    unfinished files; two fits at once leave two rows, and every reader takes the same one. `recipe` names the rules and parameters that turn source rows into a model: it changes when they do.
    """
    key = hashlib.sha256(f"{table_key(source)}|{recipe}".encode()).hexdigest()[:32]
    found = _bundles(spark, name, key)
    if not found:
        path = scratch_path(spark, f"bundles/{name}")
        save_bundle(spark, path, fit(), {"name": name, "key": key, "recipe": recipe})
        row = spark.createDataFrame([(name, key, path)], REGISTRY)
        row.coalesce(1).write.parquet(f"{_registry(spark)}/row-{uuid.uuid4().hex[:12]}")
        found = _bundles(spark, name, key)
    return load_bundle(spark, found[0]["path"])[0]
