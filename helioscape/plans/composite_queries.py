"""Composites over pixel observations."""
from pyspark.sql import functions as F

from ..operators import composite as C
from .registry import query
from .shape_queries import R
from .views import table, view


@query("link_quality", views="obs", oracle="""
select obs_id, pixel_id, clear_score, round(red_dn, 4) as red from obs where scene_cloud_pct < 80""")
def link_quality(spark, sf):
    obs = view(spark, sf, "obs")
    scores = obs.where("scene_cloud_pct < 80").select("obs_id", "pixel_id", "clear_score")
    return C.link_quality(obs.drop("clear_score"), scores, ["obs_id", "pixel_id"]).select(
        "obs_id", "pixel_id", "clear_score", R("red_dn", 4).alias("red"))


@query("union_sensors", views="obs", oracle="""
select sensor, count(*) as n, count(gain) as n_gain from (
 select sensor, cast(null as double) as gain from obs where sensor = 'click' union all select sensor, 1e0 as gain from obs where sensor = 'view') t group by sensor""")
def union_sensors(spark, sf):
    obs = view(spark, sf, "obs").select("obs_id", "sensor", "red_dn")
    both = C.union_sensors(obs.where("sensor = 'click'"), obs.where("sensor = 'view'").withColumn("gain", F.lit(1.0)))
    return both.groupBy("sensor").agg(F.count("*").alias("n"), F.count("gain").alias("n_gain"))


@query("median_composite", views="obs", oracle="""
with m as (select pixel_id, sensor, median(red_dn*0.0000275e0-0.2e0) as red, median(nir_dn*0.0000275e0-0.2e0) as nir, median(swir_dn*0.0000275e0-0.2e0) as swir,
 median(thermal_dn*0.00341802e0+149-273.15e0) as lst from obs where (qa & 31) = 0 and scene_cloud_pct < 70 group by pixel_id, sensor)
select pixel_id, sensor, round((nir-red)/(nir+red), 7) as ndvi_pre, round((swir-nir)/(swir+nir), 7) as ndbi_pre, round(lst, 7) as lst_pre from m""")
def median_composite(spark, sf):
    obs = view(spark, sf, "obs").where("scene_cloud_pct < 70")
    out = C.thermal_baseline(obs, ["pixel_id", "sensor"])
    return out.select("pixel_id", "sensor", *[R(c, 7).alias(c) for c in ("ndvi_pre", "ndbi_pre", "lst_pre")])


@query("optical_composite", views="obs", oracle="""
with m as (select pixel_id, median(red_dn/1e4) as red, median(nir_dn/1e4) as nir, median(swir_dn/1e4) as swir from obs
 where clear_score >= 0.6e0 and scene_cloud_pct < 60 group by pixel_id)
select pixel_id, round((nir-red)/(nir+red), 8) as ndvi, round((swir-nir)/(swir+nir), 8) as ndbi from m""")
def optical_composite(spark, sf):
    out = C.optical_indices(view(spark, sf, "obs").where("scene_cloud_pct < 60"), ["pixel_id"])
    return out.select("pixel_id", R("ndvi", 8).alias("ndvi"), R("ndbi", 8).alias("ndbi"))


@query("skewed_composite", views="obs", oracle="""
with o as (select case when obs_id % 3 = 0 then 1 else pixel_id end as pixel_id, red_dn, nir_dn, swir_dn, clear_score from obs),
m as (select pixel_id, median(red_dn/1e4) as red, median(nir_dn/1e4) as nir, median(swir_dn/1e4) as swir from o where clear_score >= 0.6e0 group by pixel_id)
select pixel_id, round((nir-red)/(nir+red), 8) as ndvi, round((swir-nir)/(swir+nir), 8) as ndbi from m""")
def skewed_composite(spark, sf):
    """A third of all observations fall on one pixel: that pixel takes the range-split path."""
    obs = view(spark, sf, "obs").withColumn("pixel_id", F.expr("case when obs_id % 3 = 0 then 1 else pixel_id end"))
    out = C.optical_indices(obs, ["pixel_id"])
    return out.select("pixel_id", R("ndvi", 8).alias("ndvi"), R("ndbi", 8).alias("ndbi"))


@query("band_composite", views="band_samples", oracle="""
select pixel_id, round(median(case when band='A' then value end), 6) as a, round(median(case when band='N' then value end), 6) as n,
 round(median(case when band='R' then value end), 6) as r from band_samples where (qa & 3) <= 1 group by pixel_id""")
def band_composite(spark, sf):
    clear = view(spark, sf, "band_samples").where("(qa & 3) <= 1").select("pixel_id", "band", "value")
    out = C.long_composite(clear, "pixel_id", ["A", "N", "R"])
    return out.select("pixel_id", *[R(c, 6).alias(c.lower()) for c in ("A", "N", "R")])


@query("modis_composite", views="obs", oracle="""
with m as (select pixel_id, median(case when qa <= 1 then red_dn end) as v, median(case when (qa & 3) = 0 and (qa & 4) = 0 then nir_dn end) as nir,
 median(case when (qa & 3) = 0 and (qa & 4) = 0 then swir_dn end) as swir, median(case when (qa & 3) <= 1 then thermal_dn end) as lst from obs group by pixel_id)
select pixel_id, round(v*0.0001e0, 8) as ndvi, round((swir-nir)/(swir+nir), 8) as ndbi, round(lst*0.02e0-273.15e0, 8) as lst from m""")
def modis_composite(spark, sf):
    out = C.coarse_composite(view(spark, sf, "obs"), ["pixel_id"])
    return out.select("pixel_id", *[R(c, 8).alias(c) for c in ("ndvi", "ndbi", "lst")])


@query("climatology_mean", views="band_samples", oracle="""
select pixel_id, round(avg(case when value > 20000 then value end)*1e4/3.6e6/30.4375e0, 6) as ghi,
 round(avg(case when weight*10 > 150 then weight*10 end) - 273.15e0, 6) as temperature, round(avg(qa*1e2)*0.01e0, 6) as cloud_cover from band_samples group by pixel_id""")
def climatology_mean(spark, sf):
    samples = view(spark, sf, "band_samples").selectExpr(
        "pixel_id", "case when value > 2e4 then value*1e4 else -1e0 end as ssrd", "weight*1e1 as kelvin", "qa*1e2 as cloud")
    out = C.climatology(samples, ["pixel_id"], "ssrd", "kelvin", "cloud")
    return out.select("pixel_id", *[R(c, 6).alias(c) for c in ("ghi", "temperature", "cloud_cover")])


@query("lights_median", views="obs", oracle="""
select pixel_id, round(coalesce(greatest(median(case when qa < 16 then clear_score - 0.5e0 end), 0), 0), 9) + 0e0 as lights from obs group by pixel_id""")
def lights_median(spark, sf):
    obs = view(spark, sf, "obs").selectExpr("pixel_id", "case when qa < 16 then clear_score - 5e-1 end as rad")
    return C.lights_median(obs, ["pixel_id"], "rad").select("pixel_id", (R("lights") + 0.0).alias("lights"))


@query("first_scene", views="obs", oracle="""
select pixel_id, arg_min(obs_id, (ts, obs_id)) as first_obs, arg_max(obs_id, (ts, obs_id)) as top_obs from obs group by pixel_id""")
def first_scene(spark, sf):
    obs = view(spark, sf, "obs").select("pixel_id", "obs_id", "ts")
    first = C.first_scene(obs, ["pixel_id"], ["ts", "obs_id"]).select("pixel_id", F.col("obs_id").alias("first_obs"))
    top = C.mosaic(obs, ["pixel_id"], ["ts", "obs_id"]).select("pixel_id", F.col("obs_id").alias("top_obs"))
    return first.join(top, "pixel_id")


@query("true_color", views="obs", oracle="""
select pixel_id, round(median(red_dn)/1e4, 8) as red, round(median(nir_dn)/1e4, 8) as green, round(median(swir_dn)/1e4, 8) as blue
from obs where clear_score >= 0.6e0 and scene_cloud_pct < 60 group by pixel_id""")
def true_color(spark, sf):
    out = C.true_color(view(spark, sf, "obs").where("scene_cloud_pct < 60"), ["pixel_id"])
    return out.select("pixel_id", *[R(c, 8).alias(c) for c in ("red", "green", "blue")])


@query("zonal_first", views="obs sites", oracle="""
with m as (select pixel_id, median(red_dn) as red from obs where (qa & 31) = 0 group by pixel_id)
select site_id, round(red, 6) as red from sites left join m on pixel_id = site_id % 400""")
def zonal_first(spark, sf):
    obs = view(spark, sf, "obs").where("(qa & 31) = 0").select("pixel_id", F.col("red_dn").alias("red"))
    stack = C.grouped_median(obs, ["pixel_id"], ["red"])
    points = view(spark, sf, "sites").select("site_id", (F.col("site_id") % 400).alias("pixel_id"))
    return C.sample_bands(points, stack, "pixel_id").select("site_id", R("red", 6).alias("red"))
