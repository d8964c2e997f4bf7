"""Answers for tables of requested places, comparisons of sites, and report rows."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K
from ..functions import features as FT
from ..functions.nulls import num
from . import models as ML
from .design import drop_human, global_design
from .nearest import nearest_on_sphere
from .ordered import first_per_key
from .overlay import global_overlay
from .raster import pixel_lookup
from .shaping import validate_requests
from .spark_support import stored

RAW = ["elevation", "slope", "aspect", "ghi", "temperature", "cloud_cover", "accessibility", "ndvi", "ndbi", "lst",
       "landcover", "nightlights", "population", "worldcover"]

# Places with a known verdict.
SANITY_SITES = [
    ("Bhadla Solar Park, India", 27.5397, 71.9157, "High"),
    ("Atacama Desert, Chile", -23.50, -69.20, "High"),
    ("Kamuthi Solar Park, India", 9.35, 78.38, "High"),
    ("Central Sahara, Algeria", 23.00, 10.00, "High"),
    ("Nevada desert (Tonopah), USA", 38.23, -117.36, "High"),
    ("Benban Solar Park, Egypt", 24.45, 32.73, "High"),
    ("Tengger Desert Solar Park, China", 37.55, 105.05, "High"),
    ("Noor Ouarzazate, Morocco", 31.05, -6.87, "High"),
    ("Berlin city centre, Germany", 52.52, 13.40, "Low"),
    ("Amazon rainforest, Brazil", -3.50, -62.00, "Low"),
    ("Siberian taiga, Russia", 60.00, 100.00, "Low"),
    ("Greenland ice sheet", 71.00, -40.00, "Low"),
]


def resolve_sources(points: DataFrame, cached: DataFrame, live: DataFrame, cells: DataFrame, point_id: str, cell_id: str,
                    values: list[str], reject_km: float = K.GRID_REJECT_KM) -> DataFrame:
    """Best available values per point: cached, then live, then the nearest cell within `reject_km`.

    Only points without an exact answer enter the nearest-cell search.
    """
    def tagged(df, source, rank):
        prov = F.struct(F.lit(source).alias("source"), F.lit(None).cast("double").alias("cell_km"))
        return df.select(point_id, *values, F.lit(rank).alias("_rank"), prov.alias("provenance"))
    known = first_per_key(tagged(cached, "cached", 0).unionByName(tagged(live, "live", 1)), [point_id], ["_rank"])
    known = known.join(points.select(point_id), point_id, "left_semi").drop("_rank")
    rest = points.join(known.select(point_id), point_id, "left_anti")
    hit = nearest_on_sphere(rest, cells, point_id, [cell_id]).where(F.col("km") <= reject_km)
    est = hit.join(cells.select(cell_id, *values), cell_id)
    return known.unionByName(est.select(point_id, *values, F.struct(F.lit("grid_estimate").alias("source"), F.col("km").alias("cell_km")).alias("provenance")))


def exact_or_nearest(points: DataFrame, exact: DataFrame, cells: DataFrame, point_id: str, cell_id: str) -> DataFrame:
    """Values known at the exact place, else those of the nearest cell with its distance."""
    known = points.join(exact, point_id).withColumn("feature_km", num(0))
    open_points = points.join(exact.select(point_id), point_id, "left_anti")
    values = [c for c in exact.columns if c != point_id]
    hit = nearest_on_sphere(open_points, cells, point_id, [cell_id]).withColumnRenamed("km", "feature_km")
    est = open_points.join(hit, point_id).join(cells.select(cell_id, *values), cell_id)
    return known.unionByName(est.select(*known.columns))


def _named(score: Column, label: str) -> Column:
    return F.struct(F.bround(score, 1).alias("score"), FT.score_class(score).alias("class"), F.lit(label).alias("label"))


def predict_batch(requests: DataFrame, features: DataFrame, physical: ML.MonotoneModel, development: ML.MonotoneModel,
                  request_id: str = "request_id", top: int | None = None) -> DataFrame:
    """Nested answer per request.

    requests: request_id, lat, lon, area_m2, efficiency, performance_ratio; features: request_id, raw measures,
    provenance (see resolve_sources).  Requests without features (no land nearby) have no answer row.
    """
    base = requests.join(features, request_id)
    keep = [request_id, "lat", "lon", "area_m2", "efficiency", "performance_ratio", "provenance"]
    raw = F.struct(*RAW).alias("raw")
    design = global_design(base.withColumn("raw", raw).withColumn("ahp", global_overlay()), [*keep, "raw", "ahp", "landcover"], "current")
    scored = ML.batch_score(physical.predict(design))
    explained = ML.explain(scored, physical, top).withColumnsRenamed({"contributions": "why", "base_score": "why_base"})
    dev = development.predict(explained.withColumnRenamed("model_score", "physical_score").drop("log_odds", "p")).withColumn("model_score", F.col("p") * 100)
    dev = ML.explain(dev, development, 6).withColumnsRenamed({"contributions": "development_why", "model_score": "development"})
    energy = FT.energy(F.col("raw.ghi"), F.col("area_m2"), F.col("efficiency"), F.col("performance_ratio"))
    display = F.struct(*[F.col(f"raw.{c}").alias(c) for c in RAW if c not in ("landcover", "worldcover")],
                       FT.landcover_name(F.col("raw.landcover"), K.IGBP_NAMES).alias("landcover"),
                       FT.landcover_name(F.col("raw.worldcover"), K.WORLDCOVER_NAMES).alias("worldcover"))
    return dev.select(
        request_id, "lat", "lon", F.bround("score", 1).alias("score"), FT.score_class(F.col("score")).alias("class"), "excluded",
        FT.exclusion_message(F.col("excluded")).alias("exclusion_message"), F.bround("physical_score", 1).alias("model_score"),
        display.alias("features"), F.col("why").alias("contributions"), F.col("why_base").alias("base_score"), "development_why",
        F.when(F.col("raw.ghi").isNotNull(), F.struct(*[c.alias(n) for n, c in energy.items()])).alias("energy"), "provenance",
        F.struct(_named(F.col("score"), "Suitability").alias("suitability"), _named(F.col("development"), "Development likelihood").alias("development"),
                 _named(F.col("ahp"), "AHP score").alias("ahp")).alias("scores"))


def regional_score(points: DataFrame, cells: DataFrame, value: str, **axis) -> DataFrame:
    """Adds the high-resolution score and class where the point lies in the regional raster."""
    out = pixel_lookup(points, cells, values=[value], **axis)
    return out.withColumn("regional_class", F.when(F.col(value).isNotNull(), FT.score_class(F.col(value))))


def rank_comparison(results: DataFrame, compare_id: str) -> DataFrame:
    """Adds name and rank; results: compare_id, index, name, score (null when the site failed).

    A comparison has at most five sites once validated, so its window is small.
    """
    name = F.coalesce("name", F.concat(F.lit("Site "), F.expr("char(65 + index)")))
    named = results.withColumn("name", name)
    order = W.partitionBy(compare_id).orderBy(F.col("score").desc_nulls_last(), "index")
    return named.withColumn("rank", F.when(F.col("score").isNotNull(), F.row_number().over(order)))


def compare_summary(ranked: DataFrame, compare_id: str) -> DataFrame:
    """Best by score, best by energy and the number of answered sites; ties keep the first site."""
    ok = F.col("score").isNotNull()
    best = lambda value: F.max_by("name", F.when(ok, F.struct(F.coalesce(value, num(0)), -F.col("index"))))
    return ranked.groupBy(compare_id).agg(best(F.col("score")).alias("best_score"), best(F.col("annual_kwh")).alias("best_energy"),
                                          F.count_if(ok).alias("n_ok"))


def compare_sites(requests: DataFrame, answers, compare_id: str = "compare_id") -> tuple[DataFrame, DataFrame]:
    """(sites, summary) of many comparisons; `answers` maps valid requests to predict_batch rows.

    requests: compare_id, index, name, lat, lon, area_m2, efficiency, performance_ratio.
    """
    keyed = requests.withColumn("request_id", F.concat_ws("-", compare_id, "index"))
    checked = validate_requests(keyed, compare_id)
    good = answers(checked.where("error is null").drop("error")).select("request_id", "score", "class", F.col("energy.annual_kwh").alias("annual_kwh"))
    joined = checked.join(good, "request_id", "left").withColumn(
        "error", F.coalesce("error", F.when(F.col("score").isNull(), "no data at this location")))
    # the answers are read by the ranking, the rows that failed and the summary, and made once
    joined = stored(joined, "compared")
    # only valid comparisons are ranked, so an oversized one never reaches the window
    valid = joined.where(F.col("error").isNull() | (F.col("error") == "no data at this location"))
    ranked = rank_comparison(valid, compare_id)
    failed = joined.join(valid.select("request_id"), "request_id", "left_anti").withColumn("rank", F.lit(None).cast("int"))
    sites = ranked.unionByName(failed)
    return sites, compare_summary(ranked, compare_id)


def report_rows(answers: DataFrame, key: str) -> DataFrame:
    """Report tables as rows (key, section, item, value, unit) from predict_batch answers."""
    row = lambda section, item, value, unit="": F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))
    energy = [("area_acres", "acre"), ("annual_mwh", "MWh/yr"), ("peak_kwp", "kWp"), ("specific_yield", "kWh/kWp/yr"), ("co2_tonnes", "t/yr"), ("households", "")]
    fixed = [row("scores", n, F.col(f"scores.{n}.score"), "0-100") for n in ("suitability", "development", "ahp")]
    fixed += [row("energy", n, F.col(f"energy.{n}"), u) for n, u in energy]
    fixed += [row("features", f, F.col(f"features.{f}"), K.FEATURE_LABELS[f][1]) for f in RAW if f not in ("landcover", "worldcover")]
    why = F.transform("contributions", lambda c: F.struct(F.lit("contributions").alias("section"), c["feature"].alias("item"), c["points"].alias("value"), F.lit("points").alias("unit")))
    return answers.select(key, F.explode(F.concat(F.array(*fixed), why)).alias("r")).select(key, "r.*")


def sanity_table(sites: DataFrame, models: dict[str, ML.MonotoneModel]) -> DataFrame:
    """Score of each known place per model; the model named 'final' is tempered and excluded places get 0.

    sites: site, expected, feature_km and the raw measures.
    """
    design = drop_human(global_design(sites, ["site", "expected", "feature_km", "landcover"], "current"))
    out = design.withColumn("excluded", FT.exclusion_reason(F.col("landcover"), F.col("slope")))
    for name, model in models.items():
        p = F.col("p")
        out = model.predict(out).withColumn(name, F.bround(FT.temper(p) if name == "final" else p * 100, 1)).drop("p", "log_odds")
    final = F.when(F.col("excluded").isNull(), F.col("final")).otherwise(num(0))
    out = out.withColumn("final_excluded", final)
    return out.select("site", "expected", F.bround("feature_km", 1).alias("feature_km"), F.bround("ghi", 2).alias("ghi"),
                      FT.code_of(F.col("landcover")).alias("igbp"), *models, "final_excluded", F.coalesce("excluded", F.lit("")).alias("excluded"),
                      (FT.score_class(F.col("final_excluded")) == F.col("expected")).alias("verdict"))
