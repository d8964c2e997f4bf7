"""Expert overlays: standardised criteria, weights, constraint, plausibility."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.features import benefit, code_in, code_lookup, cost, trapezoid
from ..functions.nulls import num


def global_criteria(landcover: Column, ndvi: Column) -> dict[str, Column]:
    return {
        "GHI": benefit(F.col("ghi"), 2.5, 6.5),
        "Slope": cost(F.col("slope"), 0, 10),
        "Land cover": code_lookup(landcover, K.IGBP_SCORE),
        "Accessibility": cost(F.col("accessibility"), 30, 360),
        "NDVI": cost(ndvi, 0.1, 0.7),
        "Air temperature": trapezoid(F.col("temperature"), -10, 10, 25, 40),
    }


def regional_criteria(landcover: Column, table: dict, ndvi: Column) -> dict[str, Column]:
    return {
        "GHI": benefit(F.col("ghi"), 4.5, 5.8),
        "Slope": cost(F.col("slope"), 0, 10),
        "Land cover": code_lookup(landcover, table),
        "Dist. substation": cost(F.col("dist_substation_km"), 0, 20),
        "Dist. road": cost(F.col("dist_road_km"), 0, 5),
        "NDVI": cost(ndvi, 0.1, 0.6),
        "Air temperature": cost(F.col("temperature"), 25, 35),
    }


def usable(landcover: Column, excluded) -> Column:
    """1 where neither land cover nor slope rules the place out; a missing measure rules nothing out."""
    steep = F.coalesce(F.col("slope") > num(K.MAX_SLOPE_DEG), F.lit(False))
    return F.when(code_in(landcover, excluded) | steep, num(0)).otherwise(num(1))


def weighted_overlay(criteria: dict[str, Column], weights: dict[str, float], constraint: Column) -> Column:
    """0-100; a missing criterion counts as neutral 0.5."""
    total = num(0)
    for name, w in weights.items():
        total = total + num(w) * F.coalesce(criteria[name], num(0.5))
    return num(100) * total * constraint


def global_overlay(epoch: str = "current", weights: dict[str, float] | None = None) -> Column:
    sfx = "_pre" if epoch == "pre" else ""
    lc = F.col(f"landcover{sfx}")
    return weighted_overlay(global_criteria(lc, F.col(f"ndvi{sfx}")), weights or K.GLOBAL_WEIGHTS, usable(lc, K.IGBP_EXCLUDED))


def regional_overlay(landcover: str = "worldcover", column: str = "worldcover", ndvi: str = "ndvi",
                     weights: dict[str, float] | None = None) -> Column:
    """Two land-cover systems: 'worldcover' codes or 'igbp' codes (for pre-construction land)."""
    table, excluded = (K.IGBP_SCORE, K.IGBP_EXCLUDED) if landcover == "igbp" else (K.WORLDCOVER_SCORE, K.WORLDCOVER_EXCLUDED)
    lc = F.col(column)
    return weighted_overlay(regional_criteria(lc, table, F.col(ndvi)), weights or K.REGIONAL_WEIGHTS, usable(lc, excluded))


def plausibility(epoch: str = "pre", weights: dict[str, float] | None = None) -> Column:
    """Overlay without access; the remaining weights are rescaled to one."""
    kept = {k: w for k, w in (weights or K.GLOBAL_WEIGHTS).items() if k != "Accessibility"}
    total = sum(kept.values())
    return global_overlay(epoch, {k: w / total for k, w in kept.items()})


def map_summary(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    share = lambda cond: F.avg(F.when(F.col(score).isNotNull(), cond.cast("double"))) * 100
    s = F.col(score)
    return df.groupBy(*(keys or [])).agg(
        F.avg(s).alias("mean"), share(s == 0).alias("excluded_pct"), share(s >= K.HIGH_SCORE).alias("high_pct"),
        share((s >= K.MEDIUM_SCORE) & (s < K.HIGH_SCORE)).alias("medium_pct"), F.count("*").alias("n"))


def reliable_negatives(df: DataFrame, label: str, plaus: str) -> DataFrame:
    """Adds `reliable` (negative and implausible) and `in_training` (plant or reliable negative)."""
    negative = F.col(label) == 0
    reliable = negative & F.coalesce(F.col(plaus) < num(K.PU_THRESHOLD), F.lit(False))
    return df.withColumns({"reliable": reliable, "in_training": ~negative | reliable})
