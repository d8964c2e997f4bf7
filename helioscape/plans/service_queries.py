"""Point predictions, comparisons, reports and their streaming forms."""
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import features as FT
from ..functions.nulls import num
from ..operators import design as DS
from ..operators import models as ML
from ..operators import overlay as O
from ..operators import service as SV
from ..operators.raster import extent
from ..operators.spark_support import scratch_path
from ..streaming import requests as ST
from .model_queries import development_model, fitted_monotone, physical_model
from .registry import query
from .score_queries import overlay_sql
from .shape_queries import R
from .views import view


def point_requests(spark, sf):
    """Requests at the place of their site, every third one moved a little so that it needs the grid."""
    sites = view(spark, sf, "sites").select("site_id", "lat", "lon")
    moved = F.col("request_id") % 3 == 0
    r = view(spark, sf, "requests").join(sites, "site_id")
    return r.select("request_id", "site_id", F.round(F.when(moved, F.col("lat") + 0.11).otherwise(F.col("lat")), 4).alias("lat"),
                    F.round("lon", 4).alias("lon"), "area_m2", num(K.PANEL_EFFICIENCY).alias("efficiency"), num(K.PERFORMANCE_RATIO).alias("performance_ratio"))


def grid(spark, sf):
    return view(spark, sf, "sites").select(F.col("site_id").alias("cell_id"), "lat", "lon", *SV.RAW)


def features_of(requests, spark, sf):
    """Distinct places are resolved once, however often they are requested."""
    place = F.concat_ws("_", F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"))
    keyed = requests.withColumn("place", place)
    places = keyed.groupBy("place").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    cells = grid(spark, sf)
    exact = cells.withColumn("place", place)
    none = exact.where("false").select("place", *SV.RAW)
    found = SV.resolve_sources(places, exact.where("landcover is not null").select("place", *SV.RAW), none, cells, "place", "cell_id", SV.RAW)
    return keyed.select("request_id", "place").join(found, "place").drop("place")


def models(spark, sf):
    with ThreadPoolExecutor(max_workers=2) as pool:  # two independent models
        dev = pool.submit(development_model, spark, sf)
        return physical_model(spark, sf), dev.result()


def answered(requests, spark, sf, fitted):
    return SV.predict_batch(requests, features_of(requests, spark, sf), *fitted)


@query("predict_batch")
def predict_batch(spark, sf):
    out = answered(point_requests(spark, sf), spark, sf, models(spark, sf))
    return out.select("request_id", "score", "class", "excluded", "model_score", "provenance.source", R("provenance.cell_km", 3).alias("cell_km"),
                      "scores.ahp.score", R("energy.annual_mwh", 6).alias("annual_mwh"), F.size("contributions").alias("n_contributions")) \
        .toDF("request_id", "score", "class", "excluded", "model_score", "source", "cell_km", "ahp", "annual_mwh", "n_contributions")


@query("regional_score", views="cells sites", oracle="""
with e as (select max(r) as nr from cells), p as (select site_id, ceil((lat-8)/0.5e0) as r, ceil((lon-70)/0.5e0) as c from sites, e where lat between 8 and 8 + nr*0.5e0 and lon between 70 and 94.5e0)
select s.site_id, round(z/25, 8) as score, case when z/25 >= 70 then 'High' when z/25 >= 40 then 'Medium' when z is not null then 'Low' end as class from sites s left join p using (site_id) left join cells k on k.r = p.r and k.c = p.c""")
def regional_score(spark, sf):
    cells = view(spark, sf, "cells").withColumn("local", F.col("z") / 25)
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    out = SV.regional_score(points, cells, "local", lat0=8.0, dlat=0.5, nrows=extent(cells)[1] + 1, lon0=70.0, dlon=0.5, ncols=50)
    return out.select("site_id", R("local", 8).alias("score"), F.col("regional_class").alias("class"))


RESULTS = f"""r as (select cast(floor(site_id/4e0) as bigint) as compare_id, cast(site_id % 4 as int) as index, case when site_id % 3 = 0 then region end as name,
 case when site_id % 11 <> 0 then round_even(round({overlay_sql()}, 9) + 0e0, 1) end as score, ghi*1e3 as annual_kwh from sites),
k as (select *, coalesce(name, concat('Site ', chr(65 + index))) as nm, row_number() over (partition by compare_id order by score desc nulls last, index) as rn from r)"""


def comparison_results(spark, sf):
    return view(spark, sf, "sites").select(
        F.floor(F.col("site_id") / 4).cast("bigint").alias("compare_id"), (F.col("site_id") % 4).cast("int").alias("index"),
        F.when(F.col("site_id") % 3 == 0, F.col("region")).alias("name"),
        F.when(F.col("site_id") % 11 != 0, F.bround(F.round(O.global_overlay(), 9) + 0.0, 1)).alias("score"), (F.col("ghi") * 1e3).alias("annual_kwh"))


@query("rank_sites", views="sites", oracle=f"with {RESULTS} select compare_id, index, nm as name, score, cast(case when score is not null then rn end as int) as rank from k")
def rank_sites(spark, sf):
    return SV.rank_comparison(comparison_results(spark, sf), "compare_id").select("compare_id", "index", "name", "score", "rank")


@query("compare_summary", views="sites", oracle=f"""
with {RESULTS} select compare_id, arg_max(nm, (score, -index)) filter (score is not null) as best_score, arg_max(nm, (annual_kwh, -index)) filter (score is not null) as best_energy, count(score) as n_ok from k group by compare_id""")
def compare_summary(spark, sf):
    return SV.compare_summary(SV.rank_comparison(comparison_results(spark, sf), "compare_id"), "compare_id")


@query("compare_sites")
def compare_sites(spark, sf):
    r = point_requests(spark, sf).select(
        F.floor(F.col("request_id") / 4).cast("bigint").alias("compare_id"), (F.col("request_id") % 4).cast("int").alias("index"),
        F.lit(None).cast("string").alias("name"), "lat", "lon", "area_m2", "efficiency", "performance_ratio")
    fitted = models(spark, sf)
    sites, summary = SV.compare_sites(r, lambda good: answered(good, spark, sf, fitted))
    return sites.select("compare_id", "index", "name", "score", "rank", "error").join(summary, "compare_id", "left")


REPORT_ITEMS = ["ghi", "slope", "temperature"]


@query("region_report")
def region_report(spark, sf):
    requests = point_requests(spark, sf)
    return SV.report_rows(answered(requests, spark, sf, models(spark, sf)), "request_id")


@query("report_features", views="sites", oracle="""
with e as (select *, 4046.8564224e0*ghi*365*0.2e0*0.75e0 as kwh from sites)
select site_id, 'features' as section, 'ghi' as item, round(ghi, 6) as value, 'kWh/m²/day' as unit from e union all select site_id, 'features', 'slope', round(slope, 6), '°' from e
union all select site_id, 'energy', 'annual_mwh', round(kwh/1000, 6), 'MWh/yr' from e union all select site_id, 'energy', 'households', round(kwh/3500, 6), '' from e
union all select site_id, 'contributions', 'ghi', round(ghi*2, 6), 'points' from e""")
def report_features(spark, sf):
    """Report rows of hand-made answers, so that every cell has a SQL equivalent."""
    named = lambda s: F.struct(s.alias("score"))
    sites = view(spark, sf, "sites")
    answers = sites.select(
        "site_id", F.struct(*[named(F.col("ghi")).alias(n) for n in ("suitability", "development", "ahp")]).alias("scores"),
        F.struct(*[c.alias(n) for n, c in FT.energy(F.col("ghi"), num(K.ACRE_M2)).items()]).alias("energy"),
        F.struct(*SV.RAW).alias("features"), F.array(F.struct(F.lit("ghi").alias("feature"), (F.col("ghi") * 2).alias("points"))).alias("contributions"))
    wanted = "(section = 'features' and item in ('ghi', 'slope')) or (section = 'energy' and item in ('annual_mwh', 'households')) or section = 'contributions'"
    return SV.report_rows(answers, "site_id").where(wanted).select("site_id", "section", "item", R("value", 6).alias("value"), "unit")


@query("sanity_table")
def sanity_table(spark, sf):
    """Known places scored by models trained on the sites, with features of the nearest site."""
    physical, data = fitted_monotone(spark, sf)
    step1 = ML.MonotoneModel().fit(data, DS.physical_features(), "label", "weight")
    places = spark.createDataFrame([(n, la, lo, e) for n, la, lo, e in SV.SANITY_SITES], "site string, lat double, lon double, expected string")
    cells = grid(spark, sf)
    exact = cells.where("false").select(F.lit("").alias("site"), *SV.RAW)
    return SV.sanity_table(SV.exact_or_nearest(places, exact, cells.select("cell_id", "lat", "lon", *SV.RAW), "site", "cell_id"), {"step1": step1, "final": physical})


# ---------------------------------------------------------------- streams

def request_files(spark, sf):
    """The requests as a folder of files, the form in which a file stream receives them."""
    path = scratch_path(spark, "requests")
    r = view(spark, sf, "requests")
    r.repartition(4, "request_id").write.parquet(path)
    return path, r.schema


@query("stream_requests", views="requests sites", oracle=f"""
select request_id, site_id, round(score, 6) + 0e0 as score, round(area_m2*ghi*365*0.2e0*0.75e0, 7) as annual_kwh from requests join (select site_id, ghi, {overlay_sql()} as score from sites) s using (site_id)""")
def stream_requests(spark, sf):
    path, schema = request_files(spark, sf)
    cells = view(spark, sf, "sites").select("site_id", "ghi", O.global_overlay().alias("score"))

    def answer(stream):
        energy = FT.energy(F.col("ghi"), F.col("area_m2"))
        return stream.join(cells, "site_id", "left").select("request_id", "site_id", "score", energy["annual_kwh"].alias("annual_kwh"))

    out = scratch_path(spark, "answers")
    run = ST.answer_stream(ST.read_requests(spark, path, schema, 2), answer, out, scratch_path(spark, "progress"))
    run.awaitTermination()
    back = spark.read.parquet(out)
    return back.select("request_id", "site_id", (R("score", 6) + 0.0).alias("score"), R("annual_kwh", 7).alias("annual_kwh"))


@query("stream_nearest", views="requests sites plants", oracle="""
with r as (select request_id, lat, lon from requests join sites using (site_id)), pts as (select distinct lat, lon from r),
d as (select p.lat, p.lon, plant_id, sqrt(pow(cos(radians(p.lat))*cos(radians(p.lon))-cos(radians(plat))*cos(radians(plon)),2) + pow(cos(radians(p.lat))*sin(radians(p.lon))-cos(radians(plat))*sin(radians(plon)),2)
 + pow(sin(radians(p.lat))-sin(radians(plat)),2)) as d from pts p join plants on true), n as (select lat, lon, arg_min(plant_id, (round(d, 12), plant_id)) as plant_id, min(d) as d from d group by lat, lon)
select request_id, plant_id, round(2*6371.0088e0*asin(d/2), 4) as km from r join n using (lat, lon)""")
def stream_nearest(spark, sf):
    """Nearest plant per request: an aggregating answer, so it runs on each micro-batch."""
    from ..operators.nearest import nearest_on_sphere
    path, schema = request_files(spark, sf)
    sites, plants = view(spark, sf, "sites").select("site_id", "lat", "lon"), view(spark, sf, "plants")
    out = scratch_path(spark, "nearest")
    answer = lambda batch: nearest_on_sphere(batch.join(sites, "site_id"), plants, "request_id", ["plant_id"], tlat="plat", tlon="plon")
    ST.answer_batches(ST.read_requests(spark, path, schema, 2), answer, out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("request_id", "plant_id", R("km", 4).alias("km"))


@query("stream_dedupe", views="requests", oracle="""
with recursive r as (select request_id, cast(site_id as varchar) as key, ts from requests),
anchors(key, start) as (
 select key, min(ts) from r group by key
 union all
 select a.key, min(r.ts) from anchors a join r on r.key = a.key and r.ts >= a.start + interval 1 day group by a.key),
answered as (select r.key, a.start, min(request_id) as request_id from anchors a join r on r.key = a.key and r.ts = a.start group by r.key, a.start)
select r.request_id, r.key, r.ts, w.request_id is null as cache_hit from r left join answered w on w.key = r.key and w.start = r.ts and w.request_id = r.request_id""")
def stream_dedupe(spark, sf, files_per_trigger: int = 1):
    path, schema = request_files(spark, sf)
    out = scratch_path(spark, "logged")
    stream = ST.read_requests(spark, path, schema, files_per_trigger)
    ST.log_requests(stream, "site_id", "request_id", out, scratch_path(spark, "progress")).awaitTermination()
    log = spark.read.schema("request_id long, key string, ts timestamp").parquet(out)
    return ST.once_per_day(log).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("late_results", views="requests", oracle="""
with t as (select site_id as place, case when request_id % 4 = 1 then 0 else 1 end as rank, ts, request_id from requests)
select place, case when arg_min(rank, (rank, -epoch_us(ts), request_id)) = 0 then 'live' else 'estimate' end as source, arg_min(request_id, (rank, -epoch_us(ts), request_id)) as request_id from t group by place""")
def late_results(spark, sf):
    path, schema = request_files(spark, sf)
    out = scratch_path(spark, "results")
    live = F.col("request_id") % 4 == 1
    stream = ST.read_requests(spark, path, schema, 1).select(
        F.col("site_id").alias("place"), F.when(live, "live").otherwise("estimate").alias("source"), F.when(live, 0).otherwise(1).alias("rank"),
        (-F.unix_micros("ts")).alias("age"), "request_id")
    order = ["rank", "age", "request_id"]
    ST.keep_best(stream, ["place"], order, out, scratch_path(spark, "progress")).awaitTermination()
    return ST.best_results(spark, out, stream.schema, ["place"], order).select("place", "source", "request_id")
