"""Design matrices, models, cross-validation and explanations."""
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.features import score_class
from ..operators import design as DS
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import overlay as O
from ..operators import profile as PR
from ..operators import sampling as SM
from ..operators.spark_support import scratch_path, stored
from .registry import query
from .shape_queries import R
from .views import view

# The registered forests are small so that a check finishes quickly; the operator defaults to the full size. Boosting runs all its rounds.
TREES, ROUNDS, DEPTH = 20, 500, 6


def forest():
    return ML.TreeModel("forest", TREES, DEPTH)


def boosted():
    return ML.TreeModel("boosted", ROUNDS, DEPTH)


def labelled(spark, sf):
    """Sites with blocks, folds and a held-out fifth."""
    s = SM.with_blocks(view(spark, sf, "sites"))
    s = SM.group_folds(s, "group_id")
    return s.withColumn("is_test", F.col("fold") == 0)


KEEP = ["site_id", "label", "fold", "is_test", "region"]

_DUMMIES = lambda col: ", ".join(f"cast(cast(coalesce({col} in ({','.join(map(str, v))}), false) as int) as double) as {k}" for k, v in K.IGBP_GROUPS.items())
_STATIC = "ghi, temperature, cloud_cover, elevation, slope"
_ASPECT = """round(coalesce(-cos(radians(aspect))*(case when lat >= 0 then 1 else -1 end)*least(slope/10, 1), 0), 9) + 0e0 as aspect_equator,
 round(coalesce(sin(radians(aspect))*least(slope/10, 1), 0), 9) + 0e0 as aspect_east"""


def design_sql(sfx: str) -> str:
    return f"""select site_id, {_STATIC}, {_ASPECT}, round(ln(1+greatest(accessibility, 0)), 9) as log_access, ndvi{sfx} as ndvi, ndbi{sfx} as ndbi, lst{sfx} as lst,
 round(ln(1+greatest(nightlights{sfx}, 0)), 9) as log_lights, round(ln(1+greatest(population{sfx}, 0)), 9) as log_pop, {_DUMMIES('landcover' + sfx)} from sites"""


def tidy(df, skip=("site_id",)):
    return df.select(*[c if c in skip else ((R(c) + 0.0).alias(c) if c.startswith(("aspect", "log")) else F.col(c)) for c in df.columns])


@query("design_matrix", views="sites", oracle=design_sql("_pre"))
def design_matrix(spark, sf):
    return tidy(DS.global_design(view(spark, sf, "sites"), ["site_id"], "pre"))


@query("design_matrix_current", views="sites", oracle=design_sql(""))
def design_matrix_current(spark, sf):
    return tidy(DS.global_design(view(spark, sf, "sites"), ["site_id"], "current"))


def regional_frame(spark, sf, keep=("site_id",)):
    return view(spark, sf, "sites").withColumns({"dist_road_km": F.col("cloud_cover") / 10, "dist_powerline_km": F.col("nightlights") + 1, "dist_substation_km": F.col("accessibility") / 20})


@query("design_matrix_regional", views="sites", oracle=f"""
select site_id, {_STATIC}, round(coalesce(-cos(radians(aspect))*least(slope/10, 1), 0), 9) + 0e0 as aspect_south, round(coalesce(sin(radians(aspect))*least(slope/10, 1), 0), 9) + 0e0 as aspect_east,
 ndvi_pre as ndvi, ndbi_pre as ndbi, lst_pre as lst, {', '.join(f'cast(cast(worldcover = {k} as int) as double) as {v}' for k, v in K.WORLDCOVER_DUMMIES.items())},
 cloud_cover/10 as dist_road_km, nightlights + 1 as dist_powerline_km, accessibility/20 as dist_substation_km from sites""")
def design_matrix_regional(spark, sf):
    return tidy(DS.regional_design(regional_frame(spark, sf), ["site_id"], baseline=True))


@query("drop_human_features", views="sites", oracle="select site_id, " + ", ".join(f for f in DS.physical_features()) + f" from ({design_sql('_pre')}) d")
def drop_human_features(spark, sf):
    return tidy(DS.drop_human(DS.global_design(view(spark, sf, "sites"), ["site_id"], "pre")))


@query("variants", views="sites", oracle="""
select 'clean' as variant, cast(23 as bigint) as n_features, round(sum(ndvi_pre), 6) as ndvi, count(ndvi_pre) as n from sites union all select 'leaky', 23, round(sum(ndvi), 6), count(ndvi) from sites
union all select 'as_specified', 22, round(sum(ndvi), 6), count(ndvi) from sites union all select 'physical_only', 20, round(sum(ndvi_pre), 6), count(ndvi_pre) from sites""")
def variants(spark, sf):
    out = None
    for name, frame in DS.variants(view(spark, sf, "sites"), ["site_id"]).items():
        row = frame.agg(F.lit(name).alias("variant"), F.lit(len(frame.columns) - 1).cast("bigint").alias("n_features"), R(F.sum("ndvi"), 6).alias("ndvi"), F.count("ndvi").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("impute_median", views="sites", oracle="""
with m as (select median(slope) as slope, median(ndvi_pre) as ndvi from sites where site_id % 5 <> 0) select site_id, coalesce(sites.slope, m.slope) as slope, coalesce(ndvi_pre, m.ndvi) as ndvi_pre from sites, m""")
def impute_median(spark, sf):
    s = view(spark, sf, "sites").select("site_id", "slope", "ndvi_pre")
    return ML.impute(s, ML.fit_medians(s.where("site_id % 5 <> 0"), ["slope", "ndvi_pre"]))


def _clean(spark, sf):
    return stored(DS.global_design(labelled(spark, sf), KEEP, "pre"), "clean")


@query("forest_model")
def forest_model(spark, sf):
    data = _clean(spark, sf)
    model = forest().fit(data.where("not is_test"), DS.global_features(), "label")
    return M.evaluate(model.predict(data.where("is_test")), "label", "p")


@query("boosted_model")
def boosted_model(spark, sf):
    data = _clean(spark, sf)
    model = boosted().fit(data.where("not is_test"), DS.global_features(), "label")
    return M.evaluate(model.predict(data.where("is_test")), "label", "p")


def physical_training(spark, sf):
    """Physical design with plausibility, reliable negatives and balanced weights."""
    s = labelled(spark, sf).withColumn("plaus", O.plausibility("pre"))
    marked = O.reliable_negatives(s, "label", "plaus")
    balanced = M.balanced_weights(marked.where("in_training"), "region", "label") \
        .unionByName(marked.where("not coalesce(in_training, false)").withColumn("weight", F.lit(0.0)))
    return stored(DS.drop_human(DS.global_design(balanced, [*KEEP, "weight", "reliable", "in_training"], "pre")), "physical")


# Named in the registry's keys; raise a number when the rules that make training rows change.
PHYSICAL_RECIPE, DEVELOPMENT_RECIPE = "physical 1", "development 1"


def physical_model(spark, sf):
    """Fitted once for given sites; scoring loads it."""
    def fit():
        return ML.MonotoneModel().fit(physical_training(spark, sf).where("in_training"), DS.physical_features(), "label", "weight")

    return ML.registered(spark, "physical", view(spark, sf, "sites"), f"{PHYSICAL_RECIPE} {ML.MonotoneModel()} {K.MONOTONE} {DS.physical_features()}", fit)


def development_model(spark, sf):
    def fit():
        clean = stored(DS.global_design(labelled(spark, sf), ["label"], "pre"), "clean")
        return ML.MonotoneModel(directions={}).fit(clean, DS.global_features(), "label")

    return ML.registered(spark, "development", view(spark, sf, "sites"), f"{DEVELOPMENT_RECIPE} {ML.MonotoneModel(directions={})} {DS.global_features()}", fit)


def fitted_monotone(spark, sf):
    return physical_model(spark, sf), physical_training(spark, sf)


@query("monotone_model")
def monotone_model(spark, sf):
    """Sweep of each constrained feature: the number of steps in which the score moves the wrong way is 0."""
    model, data = fitted_monotone(spark, sf)
    swept = [f for f in K.MONOTONE if f in model.features]
    steps = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(t).alias("t"),
                 F.lit(min(a for g, a, _ in model.ramps if g == f) * (1 - t) + max(b for g, _, b in model.ramps if g == f) * t).alias("at"))
        for f in swept for t in (0.0, 0.5, 1.0)]))
    rows = data.select("site_id", *model.features, steps.alias("step")).select("site_id", "step.*", *[
        F.when(F.col("step.feature") == f, F.col("step.at")).otherwise(F.col(f)).alias(f) if f in swept else F.col(f) for f in model.features])
    p_at = lambda t: F.max(F.when(F.col("t") == t, F.col("p")))
    runs = model.predict(rows).groupBy("site_id", "feature").agg(p_at(0.0).alias("p0"), p_at(0.5).alias("p1"), p_at(1.0).alias("p2"))
    sign = F.element_at(F.create_map(*[F.lit(v) for f in swept for v in (f, float(K.MONOTONE[f]))]), F.col("feature"))
    wrong = lambda a, b: (F.col(b) - F.col(a)) * sign < -1e-12
    return runs.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(wrong("p0", "p1") | wrong("p1", "p2")).alias("violations"))


@query("spatial_cv")
def spatial_cv(spark, sf):
    data = physical_training(spark, sf)
    return ML.spatial_cv(ML.MonotoneModel, data, DS.physical_features(), "label", "fold", "weight", "in_training", "reliable")


@query("oof_predictions")
def oof_predictions(spark, sf):
    data = physical_training(spark, sf)
    return ML.fold_predictions(ML.MonotoneModel, data, DS.physical_features(), "label", "fold").select("site_id", "fold", "label", "p")


@query("leakage_experiment")
def leakage_experiment(spark, sf):
    base = stored(labelled(spark, sf), "labelled")
    return ML.leakage_experiment(forest, DS.variants(base, ["site_id", "label", "is_test"]), "label", "site_id", "is_test")


@query("transfer_eval")
def transfer_eval(spark, sf):
    """A global model, a regional model and the overlay on the same regional test rows."""
    base = stored(labelled(spark, sf).withColumns({"dist_road_km": F.col("cloud_cover") / 10, "dist_powerline_km": F.col("nightlights") + 1,
                                                   "dist_substation_km": F.col("accessibility") / 20}), "labelled")
    glob = DS.global_design(base, KEEP, "pre")
    model_g = forest().fit(glob.where("region <> 'ASIA' and not is_test"), DS.global_features(), "label")
    reg = DS.regional_design(base.where("region = 'ASIA'"), KEEP, baseline=True, landcover=False)
    model_r = forest().fit(reg.where("not is_test"), [c for c in reg.columns if c not in KEEP], "label")
    test = "region = 'ASIA' and is_test"
    g = model_g.predict(glob.where(test)).select("site_id", "label", F.col("p").alias("p_global"))
    r = model_r.predict(reg.where("is_test")).select("site_id", F.col("p").alias("p_local"))
    o = base.where(test).select("site_id", (O.regional_overlay("igbp", "landcover_pre", "ndvi_pre") / 100).alias("p_overlay"))
    return ML.transfer_eval(g.join(r, "site_id").join(o, "site_id"), "label", {"global": "p_global", "local": "p_local", "overlay": "p_overlay"})


def scored_sites(spark, sf):
    model = physical_model(spark, sf)
    sites = view(spark, sf, "sites")
    design = DS.drop_human(DS.global_design(sites, ["site_id", "region", "landcover"], "current"))
    return model, ML.batch_score(model.predict(design))


@query("batch_score")
def batch_score(spark, sf):
    _, s = scored_sites(spark, sf)
    return s.select("site_id", R("score", 6).alias("score"), "excluded", score_class(F.col("score")).alias("class"))


@query("explain_scores")
def explain_scores(spark, sf):
    model, s = scored_sites(spark, sf)
    e = ML.explain(s, model)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["points"])
    return e.select("site_id", R("model_score", 6).alias("model_score"), R("base_score", 6).alias("base_score"), R(total, 6).alias("points_sum"),
                    F.col("contributions")[0]["feature"].alias("main_feature"), F.size("contributions").alias("n"))


@query("explain_given_weights", views="sites", oracle=f"""
with m as (select avg({'least(greatest((ghi-2.5e0)/4e0, 0), 1)'}) as g, avg(least(greatest(cloud_cover/100e0, 0), 1)) as c from sites),
k as (select site_id, 2e0*(least(greatest((ghi-2.5e0)/4e0, 0), 1) - m.g) as ghi, -1.5e0*(least(greatest(cloud_cover/100e0, 0), 1) - m.c) as cloud, 0.3e0 + 2e0*m.g - 1.5e0*m.c as base from sites, m),
s as (select *, 100/(1+exp(-(base+ghi+cloud)/2)) as score, 100/(1+exp(-base/2)) as b from k)
select site_id, round(score, 6) as score, round(b, 6) as base_score, round(ghi*(case when abs(ghi+cloud) > 1e-9 then (score-b)/(ghi+cloud) else 0 end), 5) + 0e0 as ghi_points,
 round(cloud*(case when abs(ghi+cloud) > 1e-9 then (score-b)/(ghi+cloud) else 0 end), 5) + 0e0 as cloud_points from s""")
def explain_given_weights(spark, sf):
    """Explanation of a model with known coefficients, so that it has a SQL equivalent."""
    s = view(spark, sf, "sites").select("site_id", "ghi", "cloud_cover")
    model = ML.MonotoneModel()
    model.features, model.medians = ["ghi", "cloud_cover"], {"ghi": 0.0, "cloud_cover": 0.0}
    model.ramps, model.coefficients, model.intercept = [("ghi", 2.5, 6.5), ("cloud_cover", 0.0, 100.0)], [2.0, -1.5], 0.3
    row = s.agg(*[F.avg(F.expr(model._ramp(*r))).alias(f"m{i}") for i, r in enumerate(model.ramps)]).first()
    model.means = [row["m0"], row["m1"]]
    e = ML.explain(model.predict(s).withColumn("model_score", ML.temper(F.col("p"))), model)
    points = F.map_from_entries(F.transform("contributions", lambda c: F.struct(c["feature"], c["points"])))
    return e.select("site_id", R("model_score", 6).alias("score"), R("base_score", 6).alias("base_score"),
                    (R(points["ghi"], 5) + 0.0).alias("ghi_points"), (R(points["cloud_cover"], 5) + 0.0).alias("cloud_points"))


@query("top_contributions")
def top_contributions(spark, sf):
    model, s = scored_sites(spark, sf)
    e = ML.explain(s, model, top=3)
    return e.select("site_id", F.posexplode_outer("contributions").alias("pos", "c")).select(
        "site_id", (F.col("pos") + 1).alias("rank"), "c.feature", "c.label", R("c.points", 6).alias("points"))


@query("mean_abs_contribution")
def mean_abs_contribution(spark, sf):
    model, s = scored_sites(spark, sf)
    parts = s.select(*[F.col("log_odds")[i].alias(f) for i, f in enumerate(model.features)])
    return PR.mean_abs_contribution(parts, model.features).orderBy(F.desc("mean_abs"), "feature").select("feature", R("mean_abs").alias("mean_abs"))


@query("importance_share")
def importance_share(spark, sf):
    data = _clean(spark, sf)
    model = forest().fit(data, DS.global_features(), "label")
    return PR.importance_share(model.importances(spark), "feature", "importance")


@query("top_features")
def top_features(spark, sf):
    data = _clean(spark, sf)
    model = forest().fit(data, DS.global_features(), "label")
    return PR.importance_share(model.importances(spark), "feature", "importance").limit(15)


@query("model_bundle")
def model_bundle(spark, sf):
    """Predictions of a saved and reloaded model equal those of the fitted one."""
    data = _clean(spark, sf)
    model = forest().fit(data.where("not is_test"), DS.global_features(), "label")
    path = scratch_path(spark, "bundle")
    ML.save_bundle(spark, path, model, {"name": "forest", "variant": "clean", "trained_rows": data.where("not is_test").count()})
    loaded, meta = ML.load_bundle(spark, path)
    test = data.where("is_test")
    both = model.predict(test).select("site_id", "p").join(loaded.predict(test).select("site_id", F.col("p").alias("p2")), "site_id")
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("p") - F.col("p2"))).alias("max_difference")).withColumn("kind", F.lit(meta["kind"]))
