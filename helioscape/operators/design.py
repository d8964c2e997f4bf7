"""Design matrices: which columns a model sees, and in which epoch."""
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions import features as FT
from .shaping import epoch_columns

STATIC = ["ghi", "temperature", "cloud_cover", "elevation", "slope"]
BASE_FEATURES = [*STATIC, "aspect_equator", "aspect_east", "log_access", "ndvi", "ndbi", "lst", "log_lights", "log_pop"]
INFRASTRUCTURE = ["dist_road_km", "dist_powerline_km", "dist_substation_km"]


def global_features(landcover: str = "modis") -> list[str]:
    return BASE_FEATURES + (list(K.WORLDCOVER_DUMMIES.values()) if landcover == "worldcover" else list(K.IGBP_GROUPS))


def physical_features() -> list[str]:
    return [f for f in global_features() if f not in K.HUMAN_FEATURES]


def global_design(df: DataFrame, keep: list[str], epoch: str = "pre", landcover: str = "modis") -> DataFrame:
    """keep + the global model's features; epoch 'pre' trains, 'current' predicts."""
    src = epoch_columns(epoch)
    aspect, slope = F.col("aspect"), F.col("slope")
    columns = {c: F.col(c) for c in STATIC}
    columns.update(
        aspect_equator=FT.aspect_equator(aspect, slope, F.col("lat")), aspect_east=FT.aspect_east(aspect, slope),
        log_access=FT.log_floor(F.col("accessibility")), ndvi=F.col(src["ndvi"]), ndbi=F.col(src["ndbi"]), lst=F.col(src["lst"]),
        log_lights=FT.log_floor(F.col(src["nightlights"])), log_pop=FT.log_floor(F.col(src["population"])))
    if landcover == "worldcover":
        columns.update({n: FT.one_hot(F.col("worldcover"), [code]) for code, n in K.WORLDCOVER_DUMMIES.items()})
    else:
        columns.update({n: FT.one_hot(F.col(src["landcover"]), codes) for n, codes in K.IGBP_GROUPS.items()})
    return df.select(*keep, *[c.cast("double").alias(n) for n, c in columns.items()])


def regional_design(df: DataFrame, keep: list[str], spectral: bool = True, baseline: bool = False,
                    landcover: bool = True) -> DataFrame:
    """keep + the regional model's features; `baseline` swaps spectral columns for their pre-construction values."""
    columns = {c: F.col(c) for c in STATIC}
    columns.update(aspect_south=FT.aspect_south(F.col("aspect"), F.col("slope")), aspect_east=FT.aspect_east(F.col("aspect"), F.col("slope")))
    if spectral:
        columns.update({c: F.col(c + "_pre" if baseline else c) for c in ("ndvi", "ndbi", "lst")})
        if landcover:
            columns.update({n: FT.one_hot(F.col("worldcover"), [code]) for code, n in K.WORLDCOVER_DUMMIES.items()})
    columns.update({c: F.col(c) for c in INFRASTRUCTURE})
    return df.select(*keep, *[c.cast("double").alias(n) for n, c in columns.items()])


def variants(df: DataFrame, keep: list[str]) -> dict[str, DataFrame]:
    """The leakage experiment's matrices: lazy projections of one frame."""
    clean = global_design(df, keep, "pre")
    return {
        "clean": clean,
        "leaky": global_design(df, keep, "current"),
        "as_specified": global_design(df, keep, "current", "worldcover"),
        "physical_only": drop_human(clean),
    }


def drop_human(df: DataFrame) -> DataFrame:
    return df.drop(*K.HUMAN_FEATURES)
