"""Point tables: schemas, readers and writers."""
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.nulls import nan_to_null

STATIC_BANDS = ["elevation", "slope", "aspect", "ghi", "temperature", "cloud_cover", "accessibility"]
EPOCH_BANDS = ["ndvi", "ndbi", "lst", "landcover", "nightlights", "population"]
META_BANDS = ["biome", "worldcover"]
TRAINING_BANDS = STATIC_BANDS + [f"{b}_pre" for b in EPOCH_BANDS] + EPOCH_BANDS + META_BANDS
PREDICTION_BANDS = STATIC_BANDS + EPOCH_BANDS + META_BANDS


def _doubles(names):
    return [T.StructField(n, T.DoubleType()) for n in names]


LABELLED_POINTS = T.StructType(
    [T.StructField("pid", T.StringType()), *_doubles(["lat", "lon"]), T.StructField("label", T.IntegerType()),
     *[T.StructField(n, T.StringType()) for n in ("neg_type", "region", "country_na", "group_id")],
     T.StructField("unique_id", T.LongType()), *_doubles(["area_m2", "capacity_mw"]),
     *[T.StructField(n, T.StringType()) for n in ("install_date", "lc_before")], *_doubles(TRAINING_BANDS)])

GRID_FEATURES = T.StructType(
    [*_doubles(["lat", "lon"]), T.StructField("country_na", T.StringType()), T.StructField("region", T.StringType()),
     T.StructField("pid", T.StringType()), *_doubles(PREDICTION_BANDS)])


def read_points(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                columns: list[str] | None = None) -> DataFrame:
    """Typed read; `columns` prunes the scan; NaN becomes null here and nowhere else."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.format(fmt).load(path)
    return nan_to_null(df.select(*columns) if columns else df)


def write_points(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """Parquet partitioned by a low-cardinality column, or gzip CSV with a header."""
    writer = df.write.mode("overwrite")
    if partition_by:
        # spread every partition value over all tasks, so one large region is not one writer's work
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("compression", "gzip").option("emptyValue", "")
    writer.format(fmt).save(path)
