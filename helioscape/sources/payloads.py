"""Nested payloads: polygon files, map elements, climate nodes and array columns kept as JSON text."""
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

LATLON = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

# One feature per line (newline-delimited), so a large file is split over tasks.
FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
        T.StructField("geometries", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))),
    ])),
])

ELEMENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("center", LATLON), T.StructField("geometry", T.ArrayType(LATLON)),
    T.StructField("members", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("geometry", T.ArrayType(LATLON))]))),
])

# Climate parameter names and months of the payload.
CLIMATE_PARAMETERS = {"ALLSKY_SFC_SW_DWN": "ghi", "T2M": "temperature", "CLOUD_AMT": "cloud_cover"}
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def read_polygons(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """(poly, ring, role, coords array<struct<x,y>>, properties); only polygonal parts are kept."""
    feature = spark.read.schema(FEATURE).json(path)
    parts = feature.select(
        F.col("properties"),
        F.explode(F.coalesce("geometry.geometries", F.array(F.struct("geometry.type", "geometry.coordinates")))).alias("g"))
    multi = F.when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", "array<array<array<array<double>>>>")) \
        .when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", "array<array<array<double>>>")))
    polys = parts.select("properties", F.posexplode(multi).alias("part", "rings"))
    rings = polys.select("properties", "part", F.posexplode("rings").alias("ring", "points"))
    coords = F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rings.select(
        F.element_at("properties", id_property).alias("poly"),
        (F.col("part").cast("long") * (1 << 32) + F.col("ring")).alias("ring"),
        F.when(F.col("ring") == 0, "outer").otherwise("inner").alias("role"), coords.alias("coords"), "properties")


def feature_text(geometry: Column, properties: Column) -> Column:
    """One GeoJSON feature as a line of text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def write_features(df: DataFrame, path: str, geometry: Column, properties: Column) -> None:
    df.select(feature_text(geometry, properties).alias("value")).write.mode("overwrite").text(path)


def parse_elements(df: DataFrame, text: str) -> DataFrame:
    """Element JSON -> columns; lat/lon fall back to the element's centre."""
    e = df.select(F.from_json(F.col(text), ELEMENT).alias("e")).select("e.*")
    return e.withColumns({"lat": F.coalesce("lat", "center.lat"), "lon": F.coalesce("lon", "center.lon")})


def element_rings(elements: DataFrame) -> DataFrame:
    """(poly, ring, role, coords): the closed rings of each element.

    A way is one outer ring if it closes and has four points or more. A relation's rings are chained from its member
    ways by their end points, outer and inner ones apart, in whatever order and direction they are listed; chains
    that do not close are left out. Elements without a geometry have no rings.
    """
    own = F.when(F.col("type") == "way", F.array(F.struct(F.lit("outer").alias("role"), F.col("geometry").alias("g"))))
    member = F.transform(
        F.filter("members", lambda m: (m["type"] == "way") & m["geometry"].isNotNull()),
        lambda m: F.struct(F.when(m["role"] == "inner", "inner").otherwise("outer").alias("role"), m["geometry"].alias("g")))
    lines = elements.select(F.concat_ws("/", "type", "id").alias("poly"), F.posexplode(F.coalesce(own, member)).alias("at", "r")) \
        .select("poly", "at", F.col("r.role").alias("role"), F.transform("r.g", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("coords"))
    ends = lambda df: df.withColumns({"first": F.element_at("coords", 1), "last": F.element_at("coords", -1)})
    sized = ends(lines.where(F.size("coords") >= 2))
    closed = sized.where((F.col("first") == F.col("last")) & (F.size("coords") >= 4))
    loose = sized.where((F.col("first") != F.col("last")) & F.col("poly").startswith("relation"))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        """The open ways of one relation and role, joined end to end."""
        ways = {at: [(p["x"], p["y"]) for p in coords] for at, coords in zip(group["at"], group["coords"], strict=True)}
        rings = []
        while ways:
            start = min(ways)
            line = ways.pop(start)
            while line[0] != line[-1]:
                after = next((at for at in sorted(ways) if line[-1] in (ways[at][0], ways[at][-1])), None)
                if after is None:
                    break
                way = ways.pop(after)
                line = line + (way[1:] if way[0] == line[-1] else way[-2::-1])
            if line[0] == line[-1] and len(line) >= 4:
                rings.append((group["poly"].iloc[0], start, group["role"].iloc[0], [{"x": x, "y": y} for x, y in line]))
        return pd.DataFrame(rings, columns=["poly", "at", "role", "coords"])

    joined = loose.select("poly", "at", "role", "coords").groupBy("poly", "role") \
        .applyInPandas(chain, "poly string, at int, role string, coords array<struct<x:double,y:double>>")
    return closed.select("poly", "at", "role", "coords").unionByName(joined).withColumnRenamed("at", "ring")


def parse_climate(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Climate payload -> annual mean and twelve ordered months per parameter."""
    body = F.from_json(F.col(text), "properties struct<parameter: map<string, map<string, double>>>")
    parsed = df.withColumn("_p", body["properties"]["parameter"])
    out = []
    for source, name in CLIMATE_PARAMETERS.items():
        values = F.element_at("_p", source)
        out.append(F.element_at(values, "ANN").alias(name))
        out.append(F.array(*[F.element_at(values, m) for m in MONTHS]).alias(f"{name}_monthly"))
    return parsed.select(*keep, *out)


def arrays_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def text_to_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.from_json(c, "array<double>") for c in columns})
