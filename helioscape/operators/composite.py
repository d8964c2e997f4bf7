"""Cloud-masked composites and climatologies over pixel observations.

Input is long: one row per pixel and scene.  All bands of a sensor are reduced in one pass.
"""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spectral as S
from ..functions.nulls import num, positive_only, unmask
from .ordered import first_per_key, grouped_median, last_per_key


def link_quality(obs: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the clear-sky score of the same scene and pixel; unscored pixels are dropped."""
    return obs.join(scores, keys)


def union_sensors(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)


def masked(values: dict[str, Column], mask: Column | None = None) -> list[Column]:
    return [(F.when(mask, v) if mask is not None else v).alias(n) for n, v in values.items()]


def optical_indices(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Median red/NIR/SWIR of clear pixels, then vegetation and built-up index."""
    clear = obs.where(S.score_clear(F.col("clear_score")))
    bands = clear.select(*keys, *[S.sentinel_reflectance(F.col(f"{b}_dn")).alias(b) for b in ("red", "nir", "swir")])
    med = grouped_median(bands, keys, ["red", "nir", "swir"])
    return med.select(*keys, S.normalized_difference(F.col("nir"), F.col("red")).alias("ndvi"),
                      S.normalized_difference(F.col("swir"), F.col("nir")).alias("ndbi"))


def true_color(obs: DataFrame, keys: list[str]) -> DataFrame:
    clear = obs.where(S.score_clear(F.col("clear_score")))
    bands = clear.select(*keys, F.col("red_dn").alias("red"), F.col("nir_dn").alias("green"), F.col("swir_dn").alias("blue"))
    med = grouped_median(bands, keys, ["red", "green", "blue"])
    return med.select(*keys, *[S.sentinel_reflectance(F.col(b)).alias(b) for b in ("red", "green", "blue")])


def thermal_baseline(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Masked and scaled reflectance and temperature medians, then indices."""
    clear = obs.where(S.landsat_clear(F.col("qa")))
    bands = clear.select(*keys, *[S.landsat_reflectance(F.col(f"{b}_dn")).alias(b) for b in ("red", "nir", "swir")],
                         S.landsat_celsius(F.col("thermal_dn")).alias("lst"))
    med = grouped_median(bands, keys, ["red", "nir", "swir", "lst"])
    return med.select(*keys, S.normalized_difference(F.col("nir"), F.col("red")).alias("ndvi_pre"),
                      S.normalized_difference(F.col("swir"), F.col("nir")).alias("ndbi_pre"), F.col("lst").alias("lst_pre"))


def coarse_composite(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Vegetation, built-up index and temperature, each under its own quality mask, in one pass."""
    qa = F.col("qa")
    bands = obs.select(*keys, *masked({"ndvi": F.col("red_dn")}, S.summary_clear(qa)),
                       *masked({"nir": F.col("nir_dn"), "swir": F.col("swir_dn")}, S.state_clear(qa)),
                       *masked({"lst": F.col("thermal_dn")}, S.thermal_clear(qa)))
    med = grouped_median(bands, keys, ["ndvi", "nir", "swir", "lst"])
    return med.select(*keys, (F.col("ndvi") * num(0.0001)).alias("ndvi"),
                      S.normalized_difference(F.col("swir"), F.col("nir")).alias("ndbi"), S.modis_celsius(F.col("lst")).alias("lst"))


def climatology(obs: DataFrame, keys: list[str], radiation: str, kelvin: str, cloud: str) -> DataFrame:
    """Long-term means; sentinels (radiation at or below 0, temperature at or below 150 K) are masked per scene."""
    return obs.groupBy(*keys).agg(
        S.daily_ghi(F.avg(positive_only(F.col(radiation)))).alias("ghi"),
        (F.avg(positive_only(F.col(kelvin), 150)) - num(273.15)).alias("temperature"),
        (F.avg(cloud) * num(0.01)).alias("cloud_cover"))


def lights_median(obs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median radiance, never below 0 and 0 where nothing was observed."""
    med = grouped_median(obs.select(*keys, F.col(value).alias("lights")), keys, ["lights"])
    return med.withColumn("lights", unmask(F.col("lights")))


def first_scene(obs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(obs, keys, order)


def mosaic(obs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last scene on top."""
    return last_per_key(obs, keys, order)


def sample_bands(points: DataFrame, stack: DataFrame, pixel: str) -> DataFrame:
    """Band values at each point; points on masked pixels are kept with nulls."""
    return points.join(stack, pixel, "left")


def long_composite(samples: DataFrame, key: str, bands: list[str]) -> DataFrame:
    """Median per band of a long (pixel, band, value) table, one output column per band."""
    wide = samples.select(key, *[F.when(F.col("band") == b, F.col("value")).alias(b) for b in bands])
    return grouped_median(wide, [key], bands)
