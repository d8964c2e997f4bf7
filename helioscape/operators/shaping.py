"""Projections, filters, checks and identifiers of point tables."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.geo import valid_coordinates
from ..functions.nulls import num
from .ordered import ordinal


def eligible_plants(plants: DataFrame) -> DataFrame:
    return plants.where((F.col("area_m2") >= K.MIN_PLANT_AREA_M2) & F.col("confidence").isin(*K.GOOD_CONFIDENCE))


def scene_filter(obs: DataFrame, start: str, end: str, max_cloud: float) -> DataFrame:
    """Half-open date range and scene cloud limit, as pushable predicates."""
    return obs.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
                     & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
                     & (F.col("scene_cloud_pct") < num(max_cloud)))


def admin_filter(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows whose administrative names equal the given ones."""
    for column, name in names.items():
        df = df.where(F.col(column) == name)
    return df


def in_list(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of wanted ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def assign_ids(df: DataFrame, order: str, prefix: str, width: int = 6, name: str = "pid") -> DataFrame:
    """Zero-padded sequential ids in the order of a unique numeric column, without a global sort in one task."""
    numbered = ordinal(df, [], order, "_n")
    return numbered.withColumn(name, F.format_string(f"{prefix}%0{width}d", F.col("_n") - 1)).drop("_n")


def tag_matches(tags: Column, key: str, pattern: str) -> Column:
    return F.coalesce(F.element_at(tags, key).rlike(pattern), F.lit(False))


def epoch_columns(epoch: str) -> dict[str, str]:
    """Source column of each time-varying feature in an epoch."""
    suffix = "_pre" if epoch == "pre" else ""
    return {c: c + suffix for c in ("ndvi", "ndbi", "lst", "landcover", "nightlights", "population")}


def validate_requests(requests: DataFrame, compare_id: str | None = None) -> DataFrame:
    """Adds `error` (null when valid).  Columns: lat, lon, area_m2, efficiency, performance_ratio.

    With `compare_id`, a comparison must list two to five distinct places; counting is a map-side
    combined aggregate, so a very long comparison costs one row per task.
    """
    error = (F.when(~F.coalesce(valid_coordinates(F.col("lat"), F.col("lon")), F.lit(False)), "coordinates out of range")
             .when(~F.coalesce((F.col("area_m2") > 0) & (F.col("area_m2") <= 1e9), F.lit(False)), "area out of range")
             .when(~F.coalesce((F.col("efficiency") > 0) & (F.col("efficiency") <= 0.5), F.lit(False)), "efficiency out of range")
             .when(~F.coalesce((F.col("performance_ratio") > 0) & (F.col("performance_ratio") <= 1), F.lit(False)),
                   "performance ratio out of range"))
    checked = requests.withColumn("error", error)
    if compare_id is None:
        return checked
    place = F.concat_ws("_", F.bround("lat", 4).cast("string"), F.bround("lon", 4).cast("string"))
    per_place = checked.withColumn("_place", place).groupBy(compare_id, "_place").agg(F.count("*").alias("_c"))
    per_compare = per_place.groupBy(compare_id).agg(F.sum("_c").alias("_n"), F.max("_c").alias("_most"))
    both = checked.join(per_compare, compare_id, "left")
    whole = (F.when((F.col("_n") < 2) | (F.col("_n") > 5), "two to five sites are needed")
             .when(F.col("_most") > 1, "sites must be distinct locations"))
    return both.withColumn("error", F.coalesce("error", whole)).drop("_n", "_most")


def batch_keys(points, id_col: str, size: int = 400):
    """Content key of each batch of `size` points; a batch is bounded, so is the list it hashes."""
    numbered = ordinal(points, [], id_col, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("bigint"))
    line = F.concat_ws(",", F.col(id_col), F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"))
    keyed = numbered.withColumn("_line", F.struct(F.col(id_col), line.alias("t")))
    keys = keyed.groupBy("batch").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(
        ";", F.transform(F.array_sort(F.collect_list("_line")), lambda s: s["t"])), 256).alias("batch_key"))
    return numbered.drop("_n"), keys
