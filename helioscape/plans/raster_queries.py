"""Rasters, lattices and map products."""
import math

from pyspark.sql import functions as F

from ..functions import colour
from ..functions import constants as K
from ..operators import lattice as L
from ..operators import raster as RS
from ..operators.ordered import ordinal, percentiles
from .registry import query
from .shape_queries import R
from .views import table, view


def raster(spark, sf):
    return view(spark, sf, "cells")


@query("gradient", views="cells", oracle="""
with b as (select min(r) r0, max(r) r1, min(c) c0, max(c) c1 from cells),
g as (select a.r, a.c, a.z, n.z as zn, s.z as zs, e.z as ze, w.z as zw, b.* from cells a cross join b
 left join cells n on n.r = a.r+1 and n.c = a.c left join cells s on s.r = a.r-1 and s.c = a.c
 left join cells e on e.r = a.r and e.c = a.c+1 left join cells w on w.r = a.r and w.c = a.c-1)
select r, c, round(case when r = r0 then zn - z when r = r1 then z - zs else (zn - zs)/2 end, 8) + 0e0 as d_row,
 round(case when c = c0 then ze - z when c = c1 then z - zw else (ze - zw)/2 end, 8) + 0e0 as d_col from g""")
def gradient(spark, sf):
    out = RS.gradient(raster(spark, sf), "z", tile=32)
    return out.select("r", "c", (R("d_row", 8) + 0.0).alias("d_row"), (R("d_col", 8) + 0.0).alias("d_col"))


@query("terrain_3x3", views="cells", oracle="""
with g as (select a.r, a.c,
 sum(case when b.c-a.c = 1 then b.z*(2-abs(b.r-a.r)) when b.c-a.c = -1 then -b.z*(2-abs(b.r-a.r)) else 0 end)/8e2 as de,
 sum(case when b.r-a.r = 1 then b.z*(2-abs(b.c-a.c)) when b.r-a.r = -1 then -b.z*(2-abs(b.c-a.c)) else 0 end)/8e2 as dn,
 count(case when b.r <> a.r or b.c <> a.c then b.z end) as n
 from cells a join cells b on b.r between a.r-1 and a.r+1 and b.c between a.c-1 and a.c+1 group by a.r, a.c)
select r, c, round(case when n = 8 then degrees(atan(sqrt(de*de+dn*dn))) end, 7) as slope,
 case when n = 8 then round((round(degrees(atan2(-round(de, 9), -round(dn, 9))), 6) + 360) % 360, 5) end as aspect from g""")
def terrain_3x3(spark, sf):
    out = RS.terrain(raster(spark, sf), "z", 100.0, tile=32)
    return out.select("r", "c", R("slope", 7).alias("slope"), (R(F.col("aspect"), 6) % 360).alias("a")).select(
        "r", "c", "slope", R("a", 5).alias("aspect"))


@query("focal_fill", views="cells", oracle="""
with g as (select a.r, a.c, any_value(a.z) as z, avg(b.z) as m from cells a left join cells b
 on b.r between a.r-3 and a.r+3 and b.c between a.c-3 and a.c+3 group by a.r, a.c)
select r, c, round(coalesce(z, m), 6) as z from g""")
def focal_fill(spark, sf):
    return RS.focal_fill(raster(spark, sf), "z", tile=32).select("r", "c", R("z", 6).alias("z"))


@query("aspect_from_elevation")
def aspect_from_elevation(spark, sf):
    return RS.smoothed_aspect(raster(spark, sf), "z", tile=32)


@query("pixel_lookup", views="cells sites", oracle="""
with e as (select cast(max(r) as int) as nr from cells),
p as (select site_id, lat, lon, least(greatest(ceil((lat-8)/0.5e0), 0), nr) as r, least(greatest(ceil((lon-70)/0.5e0), 0), 49) as c from sites, e
 where lat between 8 and 8 + nr*0.5e0 and lon between 70 and 94.5e0)
select s.site_id, cells.z from sites s left join p using (site_id) left join cells on cells.r = p.r and cells.c = p.c""")
def pixel_lookup(spark, sf):
    cells = raster(spark, sf)
    nrows = RS.extent(cells)[1] + 1
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    return RS.pixel_lookup(points, cells, 8.0, 0.5, nrows, 70.0, 0.5, 50, ["z"]).select("site_id", "z")


@query("lattice", views="borders", oracle="""
with b as (select poly, min(y1) as south, max(y1) as north, min(x1) as west, max(x1) as east from borders group by poly),
n as (select *, cast(ceil((north-south)/0.25e0 - 0.5e0) as int) as nr, cast(ceil((east-west)/0.25e0 - 0.5e0) as int) as nc from b),
i as (select *, unnest(generate_series(0, nr-1)) as i from n), j as (select *, unnest(generate_series(0, nc-1)) as j from i)
select poly, round(south + 0.125e0 + i*0.25e0, 4) as lat, round(west + 0.125e0 + j*0.25e0, 4) as lon from j""")
def lattice(spark, sf):
    b = view(spark, sf, "borders").groupBy("poly").agg(F.min("y1").alias("south"), F.max("y1").alias("north"),
                                                       F.min("x1").alias("west"), F.max("x1").alias("east"))
    return L.cell_centres(b, 0.25).select("poly", "lat", "lon")


@query("padded_lattice", views="borders", oracle="""
with b as (select poly, min(y1) as south, max(y1) as north, min(x1) as west, max(x1) as east from borders group by poly),
n as (select *, floor(south/0.5e0)*0.5e0 - 0.5e0 as s0, floor(west/0.5e0)*0.5e0 - 0.5e0 as w0 from b),
i as (select *, unnest(generate_series(0, cast(ceil((north + 1 - s0)/0.5e0) as int) - 1)) as i from n),
j as (select *, unnest(generate_series(0, cast(ceil((east + 1 - w0)/0.5e0) as int) - 1)) as j from i)
select poly, round(s0 + i*0.5e0, 2) as lat, round(w0 + j*0.5e0, 2) as lon from j""")
def padded_lattice(spark, sf):
    b = view(spark, sf, "borders").groupBy("poly").agg(F.min("y1").alias("south"), F.max("y1").alias("north"),
                                                       F.min("x1").alias("west"), F.max("x1").alias("east"))
    return L.padded_nodes(b, 0.5).select("poly", "lat", "lon")


@query("order_lattice", views="cells", oracle="select lat, lon, z from cells where z is not null order by lat, lon")
def order_lattice(spark, sf):
    return raster(spark, sf).where("z is not null").select("lat", "lon", "z").orderBy("lat", "lon")


@query("climate_bilinear", views="cells sites", oracle="""
with e as (select 1 + max(r) as nr from (select r from cells group by r having count(*) = 50)), z as (select r, c, coalesce(z, 1000e0) as z from cells),
p as (select site_id, (lat-8)/0.5e0 as fr, (lon-70)/0.5e0 as fc, nr from sites, e),
q as (select *, cast(least(greatest(floor(fr), 0), nr-2) as int) as r, cast(least(greatest(floor(fc), 0), 48) as int) as c from p),
w as (select *, fr-r as wr, fc-c as wc from q)
select site_id, round(a.z*(1-wr)*(1-wc) + b.z*(1-wr)*wc + d.z*wr*(1-wc) + f.z*wr*wc, 5) as ghi,
 round((a.z+2)*(1-wr)*(1-wc) + (b.z+2)*(1-wr)*wc + (d.z+2)*wr*(1-wc) + (f.z+2)*wr*wc, 5) as mar
from w join z a on a.r=w.r and a.c=w.c join z b on b.r=w.r and b.c=w.c+1 join z d on d.r=w.r+1 and d.c=w.c join z f on f.r=w.r+1 and f.c=w.c+1""")
def climate_bilinear(spark, sf):
    # the lattice ends with its last whole row: beyond it a cell lacks corners
    nodes = raster(spark, sf).withColumn("ghi", F.coalesce("z", F.lit(1000.0)))
    nrows = 1 + nodes.groupBy("r").count().where("count = 50").agg(F.max("r")).first()[0]
    nodes = nodes.withColumn("monthly", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.col("ghi") + i))
    cells = L.corner_cells(nodes.select("r", "c", "ghi", "monthly"), ["ghi", "monthly"])
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    out = L.bilinear(points, cells, ["ghi"], ["monthly"], 8.0, 0.5, nrows, 70.0, 0.5, 50)
    return out.select("site_id", R("ghi", 5).alias("ghi"), R(F.col("monthly")[2], 5).alias("mar"))


@query("tiled_sources", views="plants", oracle="""
select plant_id, least(cast(floor((plon-59.7e0)/(40.49e0/3)) as int), 2) as tx, least(cast(floor((plat+20.3e0)/(40.59e0/3)) as int), 2) as ty
from plants where plat between -20.3e0 and 20.29e0 and plon between 59.7e0 and 100.19e0""")
def tiled_sources(spark, sf):
    p = view(spark, sf, "plants").select("plant_id", F.col("plat").alias("lat"), F.col("plon").alias("lon"))
    return L.source_tiles(p, -20.0, 19.99, 60.0, 99.89, 3, 3, pad=0.3).select("plant_id", "tx", "ty")


@query("points_to_grid", views="sites", oracle="""
select cast(floor((lat+20)/0.5e0) as int) as r, cast(floor((lon-60)/0.5e0) as int) as c, arg_max(ghi, site_id) as value
from sites where floor((lat+20)/0.5e0) between 0 and 79 and floor((lon-60)/0.5e0) between 0 and 69 group by 1, 2""")
def points_to_grid(spark, sf):
    return RS.points_to_grid(view(spark, sf, "sites"), "ghi", "site_id", -20.0, 60.0, 0.5, 80, 70)


@query("grid_to_mercator", views="sites", oracle="""
with g as (select cast(floor((lat+20)/2e0) as int) as r, cast(floor((lon-60)/2e0) as int) as c, arg_max(ghi, site_id) as v from sites
 where floor((lon-60)/2e0) between 0 and 19 group by 1, 2),
f as (select 6378137e0*ln(tan(pi()/4+radians(-20e0)/2)) as y0, 6378137e0*ln(tan(pi()/4+radians(20e0)/2)) as y1),
px as (select i as px, (60 + (i+0.5e0)/96*40 - 60)/2e0 - 0.5e0 as fc from range(96) t(i)),
py as (select i as py, (degrees(2*atan(exp((y1-(i+0.5e0)/98*(y1-y0))/6378137e0))-pi()/2) + 20)/2e0 - 0.5e0 as fr from range(98) t(i), f),
k as (select px, py, least(greatest(floor(fc),0),19) as c0, least(greatest(floor(fr),0),19) as r0,
 least(greatest(round_even(fc,0),0),19) as cn, least(greatest(round_even(fr,0),0),19) as rn, fc, fr from px, py),
w as (select *, least(c0+1,19) as c1, least(r0+1,19) as r1, least(greatest(fc-c0,0),1) as wc, least(greatest(fr-r0,0),1) as wr from k),
s as (select px, py, coalesce(a.v*(1-wr)*(1-wc),0)+coalesce(b.v*(1-wr)*wc,0)+coalesce(d.v*wr*(1-wc),0)+coalesce(e.v*wr*wc,0) as num,
 case when a.v is null then 0 else (1-wr)*(1-wc) end + case when b.v is null then 0 else (1-wr)*wc end + case when d.v is null then 0 else wr*(1-wc) end + case when e.v is null then 0 else wr*wc end as den, n.v as nv
 from w left join g a on a.r=r0 and a.c=c0 left join g b on b.r=r0 and b.c=c1 left join g d on d.r=r1 and d.c=c0 left join g e on e.r=r1 and e.c=c1 left join g n on n.r=rn and n.c=cn)
select cast(px as int) as px, cast(py as int) as py, round(num/den, 6) as value from s where den > 0.25e0 and nv is not null""")
def grid_to_mercator(spark, sf):
    grid = RS.points_to_grid(view(spark, sf, "sites"), "ghi", "site_id", -20.0, 60.0, 2.0, 20, 20)
    out = RS.grid_to_mercator(grid, -20.0, 60.0, 2.0, 20, 20, 96)
    return out.select("px", "py", R("value", 6).alias("value"))


@query("grid_to_mercator_classes", views="sites", oracle="""
with g as (select cast(floor((lat+20)/2e0) as int) as r, cast(floor((lon-60)/2e0) as int) as c, arg_max(worldcover, site_id) as v from sites
 where floor((lon-60)/2e0) between 0 and 19 group by 1, 2),
f as (select 6378137e0*ln(tan(pi()/4+radians(-20e0)/2)) as y0, 6378137e0*ln(tan(pi()/4+radians(20e0)/2)) as y1),
px as (select i as px, least(greatest(round_even((i+0.5e0)/96*20 - 0.5e0,0),0),19) as c from range(96) t(i)),
py as (select i as py, least(greatest(round_even((degrees(2*atan(exp((y1-(i+0.5e0)/98*(y1-y0))/6378137e0))-pi()/2) + 20)/2e0 - 0.5e0,0),0),19) as r from range(98) t(i), f)
select cast(px as int) as px, cast(py as int) as py, v as value from px join g on g.c = px.c join py on py.r = g.r""")
def grid_to_mercator_classes(spark, sf):
    grid = RS.points_to_grid(view(spark, sf, "sites"), "worldcover", "site_id", -20.0, 60.0, 2.0, 20, 20)
    return RS.grid_to_mercator(grid, -20.0, 60.0, 2.0, 20, 20, 96, categorical=True).select("px", "py", "value")


@query("palette_ramp", views="cells", oracle="""
with s as (select [140,191,223,246,199,116,49,0] as rs, [81,129,194,232,233,196,163,109] as gs, [10,45,125,195,192,118,84,44] as bs),
t as (select r, c, z, coalesce(least(greatest((z-900)/1200e0, 0), 1), 0)*7 as pos, coalesce(least(greatest((z-900)/1200e0, 0), 1), 0) as t from cells),
u as (select *, cast(least(floor(pos), 6) as int) as k from t)
select r, c, cast(floor(rs[k+1]*(1-(pos-k)) + rs[k+2]*(pos-k)) as int) as red, cast(floor(gs[k+1]*(1-(pos-k)) + gs[k+2]*(pos-k)) as int) as green,
 cast(floor(bs[k+1]*(1-(pos-k)) + bs[k+2]*(pos-k)) as int) as blue, case when z is null then 0 else cast(floor((0.35e0 + (0.92e0-0.35e0)*t)*255) as int) end as alpha from u, s""")
def palette_ramp(spark, sf):
    rgba = colour.colorize(F.col("z"), K.NDVI_PALETTE, 900.0, 2100.0)
    return raster(spark, sf).select("r", "c", rgba.alias("p")).select(
        "r", "c", F.col("p.r").alias("red"), F.col("p.g").alias("green"), F.col("p.b").alias("blue"), F.col("p.a").alias("alpha"))


@query("category_colours", views="cells", oracle=f"""
select r, c, cast(('0x' || substr(h,1,2)) as int) as red, cast(('0x' || substr(h,3,2)) as int) as green, cast(('0x' || substr(h,5,2)) as int) as blue, cast(216 as int) as alpha
from (select r, c, case cast(code as int) {' '.join(f"when {k} then '{v}'" for k, v in K.WORLDCOVER_PALETTE.items())} end as h from cells) t""")
def category_colours(spark, sf):
    rgba = colour.categorical_rgba(F.col("code").cast("int"), K.WORLDCOVER_PALETTE)
    return raster(spark, sf).select("r", "c", rgba.alias("p")).select(
        "r", "c", F.col("p.r").alias("red"), F.col("p.g").alias("green"), F.col("p.b").alias("blue"), F.col("p.a").alias("alpha"))


def _painted(spark, sf):
    """Cells painted by class; a few pixels are off by a shade or transparent."""
    rgba = colour.categorical_rgba(F.col("code").cast("int"), K.WORLDCOVER_PALETTE)
    return raster(spark, sf).select("r", "c", "code", rgba.alias("p")).select(
        F.col("r").alias("row"), F.col("c").alias("col"), "code", F.least(F.col("p.r") + F.col("r") % 3, F.lit(255)).alias("r"),
        F.col("p.g").alias("g"), F.col("p.b").alias("b"), F.when(F.col("c") % 17 == 0, 100).otherwise(F.col("p.a")).alias("a"))


@query("nearest_palette", views="cells", oracle="""
select r as row, c as col, case when c % 17 <> 0 then code end as value from cells""")
def nearest_palette(spark, sf):
    return RS.nearest_class(_painted(spark, sf), K.WORLDCOVER_PALETTE).select("row", "col", "value")


@query("decode_ramp")
def decode_ramp(spark, sf):
    """Values read back from colours of a continuous ramp."""
    rgba = colour.colorize(F.col("z"), K.NDVI_PALETTE, 900.0, 2100.0, alpha=(0.85, 0.85))
    pixels = raster(spark, sf).select(F.col("r").alias("row"), F.col("c").alias("col"), "z", rgba.alias("p")).select(
        "row", "col", "z", *[F.col(f"p.{x}").alias(x) for x in "rgba"])
    return RS.nearest_palette(pixels, K.NDVI_PALETTE, 900.0, 2100.0).select("row", "col", "z", "value")


@query("raster_stack", views="cells", oracle="""
select r, c, z as ndvi, case when c % 7 <> 0 then lat end as lst, code as landcover, z is not null as mask from cells""")
def raster_stack(spark, sf):
    cells = raster(spark, sf)
    layer = lambda v, cond="true": cells.where(cond).select("r", "c", F.col(v).alias("value"))
    out = RS.raster_stack({"ndvi": layer("z"), "lst": layer("lat", "c % 7 <> 0"), "landcover": layer("code")})
    return out.select("r", "c", "ndvi", "lst", "landcover", "mask")


@query("raster_validation", views="cells sites", oracle="""
with e as (select max(r) as nr from cells),
p as (select site_id, ghi, worldcover, ceil((lat-8)/0.5e0) as r, ceil((lon-70)/0.5e0) as c from sites, e where lat between 8 and 8 + nr*0.5e0 and lon between 70 and 94.5e0),
j as (select ghi*300 as b, cells.z as a, worldcover, code from p join cells on cells.r = p.r and cells.c = p.c)
select round(corr(a, b), 8) as r, round(avg(abs(a-b)), 6) as mae, round(avg(case when code = worldcover then 1e0 else 0e0 end), 8) as agreement,
 cast(count(a) as bigint) as n from j""")
def raster_validation(spark, sf):
    cells = raster(spark, sf)
    nrows = RS.extent(cells)[1] + 1
    points = view(spark, sf, "sites").select("site_id", "lat", "lon", "ghi", "worldcover")
    j = RS.pixel_lookup(points, cells, 8.0, 0.5, nrows, 70.0, 0.5, 50, ["z", "code"]).withColumn("b", F.col("ghi") * 300)
    agree = F.when(F.col("code").isNotNull(), (F.col("code") == F.col("worldcover")).cast("double"))
    return j.agg(R(F.corr(F.when(F.col("z").isNotNull(), F.col("z")), "b"), 8).alias("r"), R(F.avg(F.abs(F.col("z") - F.col("b"))), 6).alias("mae"),
                 R(F.avg(agree), 8).alias("agreement"), F.count("z").alias("n"))


@query("heatmap_arrays", views="sites", oracle="""
with n as (select site_id, lat, lon, ghi, cast(floor((row_number() over (order by site_id) - 1)/500) as bigint) as chunk from sites)
select chunk, count(*) as n, string_agg(cast(site_id as varchar), ',' order by site_id) as ids, round(sum(round_even(lat,3)), 6) as lat_sum,
 round(sum(round_even(ghi,1)), 6) as score_sum, arg_min(round_even(lon, 3), site_id) as first_lon from n group by chunk""")
def heatmap_arrays(spark, sf):
    docs = heatmap_documents(view(spark, sf, "sites").select("site_id", "lat", "lon", "ghi"), "site_id", ["ghi"])
    parsed = docs.select("chunk", F.from_json("document", "n bigint, id array<bigint>, lat array<double>, lon array<double>, ghi array<double>").alias("d"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return parsed.select("chunk", F.col("d.n").alias("n"), F.array_join(F.transform("d.id", lambda x: x.cast("string")), ",").alias("ids"),
                         R(total("d.lat"), 6).alias("lat_sum"), R(total("d.ghi"), 6).alias("score_sum"), F.col("d.lon")[0].alias("first_lon"))


def heatmap_documents(points, id_col, scores, size: int = 500):
    """Ordered parallel arrays as JSON, in chunks of `size` points so that no document holds the whole map."""
    numbered = ordinal(points, [], id_col, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("bigint"))
    row = F.struct(F.col(id_col), F.bround("lat", 3).alias("lat"), F.bround("lon", 3).alias("lon"),
                   *[F.bround(s, 1).alias(s) for s in scores])
    listed = numbered.groupBy("chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
    pick = lambda name: F.transform("rows", lambda x: x[name])
    body = F.struct("n", pick(id_col).alias("id"), pick("lat").alias("lat"), pick("lon").alias("lon"), *[pick(s).alias(s) for s in scores])
    return listed.select("chunk", F.to_json(body).alias("document"))


@query("layer_catalog", views="sites", oracle="""
select 'global' as scope, 'ghi' as layer, 'continuous' as kind, round(quantile_cont(ghi, 0.01), 2) as min, round(quantile_cont(ghi, 0.99), 2) as max, cast(0 as bigint) as classes from sites
union all select 'global', 'slope', 'continuous', round(quantile_cont(slope, 0.01), 2), round(quantile_cont(slope, 0.99), 2), 0 from sites
union all select 'global', 'landcover', 'categorical', null, null, 10""")
def layer_catalog(spark, sf):
    sites = view(spark, sf, "sites")
    long = sites.select(F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("x")) for n in ("ghi", "slope")])).alias("e")).select("e.*")
    limits = percentiles(long, ["layer"], "x", [0.01, 0.99], ["min", "max"])
    classes = F.array(*[F.struct(F.lit(k).alias("code"), F.lit(K.WORLDCOVER_NAMES[k]).alias("name"), F.lit("#" + K.WORLDCOVER_PALETTE[k]).alias("color"))
                        for k in K.WORLDCOVER_PALETTE if k != 70])
    cover = sites.select("worldcover").where("worldcover is not null").limit(1).select(F.lit("landcover").alias("layer"))
    entries = limits.withColumn("kind", F.lit("continuous")).withColumn("classes", F.slice(classes, 1, 0)).unionByName(
        cover.withColumn("kind", F.lit("categorical")).withColumn("classes", classes), allowMissingColumns=True)
    catalogue = entries.groupBy(F.lit("global").alias("scope")).agg(F.map_from_entries(F.collect_list(
        F.struct("layer", F.struct("kind", "min", "max", "classes")))).alias("layers"))
    return catalogue.select("scope", F.explode("layers").alias("layer", "e")).select(
        "scope", "layer", "e.kind", R("e.min", 2).alias("min"), R("e.max", 2).alias("max"), F.size("e.classes").cast("bigint").alias("classes"))
