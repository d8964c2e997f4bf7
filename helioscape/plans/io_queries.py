"""Sources and sinks: every query writes to the shared folder and reads its own files back."""
from pyspark.sql import Window as W, functions as F
from pyspark.sql import types as T

from ..functions.nulls import nan_to_null
from ..operators.shaping import batch_keys
from ..operators.polygons import ring_edges
from ..operators.spark_support import scratch_path
from ..sources import payloads, tables
from ..sources.resume import resume
from .registry import query
from .views import table, view


@query("scan_points", views="sites", oracle="""
select site_id, region, lat, lon, label, slope, ndvi, landcover from sites""")
def scan_points(spark, sf):
    sites = view(spark, sf, "sites")
    path = scratch_path(spark, "points")
    # a missing measure arrives as NaN in exchanged files; the reader turns it back into null
    nan = sites.withColumn("slope", F.coalesce("slope", F.lit(float("nan"))))
    tables.write_points(nan, path, fmt="csv")
    back = tables.read_points(spark, path, sites.schema, fmt="csv")
    return back.select("site_id", "region", "lat", "lon", "label", "slope", "ndvi", "landcover")


@query("scan_pruned", views="sites", oracle="select site_id, ghi from sites")
def scan_pruned(spark, sf):
    path = scratch_path(spark, "pruned")
    sites = view(spark, sf, "sites")
    tables.write_points(sites, path)
    return tables.read_points(spark, path, sites.schema, columns=["site_id", "ghi"])


@query("sink_points", views="sites", oracle="""
select region, count(*) as n, round(sum(ghi), 6) as sum_ghi, count(slope) as n_slope from sites group by region""")
def sink_points(spark, sf):
    path = scratch_path(spark, "by_region")
    sites = view(spark, sf, "sites")
    tables.write_points(sites, path, partition_by="region")
    back = tables.read_points(spark, path, sites.schema)
    return back.groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("ghi"), 6).alias("sum_ghi"),
                                      F.count("slope").alias("n_slope"))


def border_rings(spark, sf):
    """Rings of the border polygons as ordered coordinate arrays (same corners as the `borders` view)."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    x0, y0 = "605e-1 + 8e0*(n_nationkey % 5)", "-1963e-2 + 8e0*floor(n_nationkey/5e0)"
    ring = lambda pts: "array(" + ",".join(f"array({x0} + {a}, {y0} + {b})" for a, b in pts) + ")"
    outer = ring([("0e0", "0e0"), ("7.1e0", "4e-1"), ("6.6e0", "7.2e0"), ("3e-1", "6.9e0"), ("0e0", "0e0")])
    inner = ring([("2e0", "2e0"), ("4.1e0", "2.3e0"), ("3e0", "4.4e0"), ("2e0", "2e0")])
    return nation.selectExpr("n_nationkey", "r_name as region",
                             f"case when n_nationkey % 4 = 0 then array({outer}, {inner}) else array({outer}) end as rings")


def _write_borders(spark, sf):
    path = scratch_path(spark, "borders")
    rings = border_rings(spark, sf)
    payloads.write_features(
        rings, path, F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")),
        F.create_map(F.lit("id"), F.col("n_nationkey").cast("string"), F.lit("region"), F.col("region")))
    return path


@query("scan_polygons", views="borders", oracle="""
select cast(poly as varchar) as poly, role, count(*) as edges, round(sum(x1*y2 - x2*y1), 6) as cross_sum
from borders group by poly, role""")
def scan_polygons(spark, sf):
    edges = ring_edges(payloads.read_polygons(spark, _write_borders(spark, sf), "id"))
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy("poly", "role").agg(F.count("*").alias("edges"), F.round(F.sum(cross), 6).alias("cross_sum"))


@query("sink_geojson", oracle="""
select cast(n_nationkey as varchar) as id, r_name as region, cast(case when n_nationkey % 4 = 0 then 2 else 1 end as bigint) as rings
from nation join region on n_regionkey = r_regionkey""")
def sink_geojson(spark, sf):
    lines = spark.read.text(_write_borders(spark, sf))
    f = F.from_json("value", "type string, properties map<string,string>, geometry struct<type string, coordinates array<array<array<double>>>>")
    return lines.select(f.alias("f")).select(
        F.element_at("f.properties", "id").alias("id"), F.element_at("f.properties", "region").alias("region"),
        F.size("f.geometry.coordinates").cast("bigint").alias("rings"))


@query("scan_map_elements", oracle="""
select concat(case when o_orderkey % 3 = 0 then 'node' when o_orderkey % 3 = 1 then 'way' else 'relation' end, '/', o_orderkey) as osm_id,
  case when o_orderkey % 2 = 0 then 'substation' else 'line' end as power,
  round(-20 + (o_orderkey % 4000)/1e2, 6) as lat, round(60 + (o_orderkey % 3989)/1e2, 6) as lon
from orders""")
def scan_map_elements(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey as id", "-20e0 + (o_orderkey % 4000)/1e2 as la", "60e0 + (o_orderkey % 3989)/1e2 as lo")
    node = F.col("id") % 3 == 0
    text = F.to_json(F.struct(
        F.when(node, "node").when(F.col("id") % 3 == 1, "way").otherwise("relation").alias("type"), "id",
        F.create_map(F.lit("power"), F.when(F.col("id") % 2 == 0, "substation").otherwise("line")).alias("tags"),
        F.when(node, F.col("la")).alias("lat"), F.when(node, F.col("lo")).alias("lon"),
        F.when(~node, F.struct(F.col("la").alias("lat"), F.col("lo").alias("lon"))).alias("center")))
    path = scratch_path(spark, "elements")
    orders.select(text.alias("value")).write.text(path)
    e = payloads.parse_elements(spark.read.text(path), "value")
    return e.select(F.concat_ws("/", "type", "id").alias("osm_id"), F.element_at("tags", "power").alias("power"),
                    F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def climate_payload(spark, sf):
    """One climate document per cell: annual mean and months derived from the cell's value."""
    cells = view(spark, sf, "cells").where("z is not null")
    def values(scale):
        entries = [F.lit("ANN"), F.col("z") / scale]
        for i, m in enumerate(payloads.MONTHS):
            entries += [F.lit(m), (F.col("z") + i) / scale]
        return F.create_map(*entries)
    params = F.create_map(*[v for name, scale in zip(payloads.CLIMATE_PARAMETERS, (200.0, 50.0, 20.0))
                            for v in (F.lit(name), values(scale))])
    body = F.to_json(F.struct(F.struct(params.alias("parameter")).alias("properties")))
    return cells.select("r", "c", body.alias("body"))


@query("scan_climate_json", views="cells", oracle="""
select r, c, round(z/200e0, 9) as ghi, round(z/50e0, 9) as temperature, round(z/20e0, 9) as cloud_cover,
  round((z+1)/200e0, 9) as ghi_feb, round((z+11)/20e0, 9) as cloud_dec
from cells where z is not null""")
def scan_climate_json(spark, sf):
    parsed = payloads.parse_climate(climate_payload(spark, sf), "body", ["r", "c"])
    return parsed.select("r", "c", *[F.round(n, 9).alias(n) for n in ("ghi", "temperature", "cloud_cover")],
                         F.round(F.col("ghi_monthly")[1], 9).alias("ghi_feb"),
                         F.round(F.col("cloud_cover_monthly")[11], 9).alias("cloud_dec"))


@query("array_json_column", views="cells", oracle="""
select r, c, cast(12 as bigint) as months, round((z+5)/200e0, 9) as ghi_jun,
  round((12*z + 66)/200e0, 6) as ghi_sum from cells where z is not null""")
def array_json_column(spark, sf):
    parsed = payloads.parse_climate(climate_payload(spark, sf), "body", ["r", "c"]).select("r", "c", "ghi_monthly")
    path = scratch_path(spark, "lattice")
    flat = payloads.arrays_to_text(parsed, ["ghi_monthly"])
    flat.write.option("header", True).csv(path)
    back = payloads.text_to_arrays(spark.read.schema(flat.schema).option("header", True).csv(path), ["ghi_monthly"])
    total = F.aggregate("ghi_monthly", F.lit(0.0), lambda a, x: a + x)
    return back.select("r", "c", F.size("ghi_monthly").cast("bigint").alias("months"),
                       F.round(F.col("ghi_monthly")[5], 9).alias("ghi_jun"), F.round(total, 6).alias("ghi_sum"))


@query("resume_batches", views="sites", oracle="""
with numbered as (select site_id, lat, lon, cast(floor((row_number() over (order by site_id) - 1)/400) as bigint) as batch from sites),
keys as (select batch, count(*) as n,
  sha256(string_agg(concat(site_id, ',', printf('%.6f', lat), ',', printf('%.6f', lon)), ';' order by site_id)) as batch_key
  from numbered group by batch)
select batch, n, batch_key from keys where batch_key >= '8'""")
def resume_batches(spark, sf):
    _, keys = batch_keys(view(spark, sf, "sites").select("site_id", "lat", "lon"), "site_id")
    done_path = scratch_path(spark, "finished")
    keys.where("batch_key < '8'").select("batch_key").write.mode("append").parquet(done_path)
    finished = spark.read.schema("batch_key string").parquet(done_path)
    return keys.join(finished, "batch_key", "left_anti").select("batch", "n", "batch_key")


@query("resumed_table", views="sites", oracle="""
select site_id, round(ghi*365e0/2, 6) as yearly from sites where ghi is not null""")
def resumed_table(spark, sf):
    """A run that stops after its first commit, and the one that does the rest: the whole table."""
    folder, sites = scratch_path(spark, "resumed"), view(spark, sf, "sites").where("ghi is not null").select("site_id", "lat", "lon", "ghi")
    yearly = lambda rows: rows.select("site_id", "batch_key", F.round(F.col("ghi") * 365 / 2, 6).alias("yearly"))
    resume(sites, "site_id", yearly, folder, commits=2, at_most=1)
    return resume(sites, "site_id", yearly, folder, commits=2)
