"""Joins: keys, containment, nearest neighbours, polylines and polygons."""
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import merc_x, merc_y, project_metric
from ..operators import dissolve as D, lattice
from ..operators import nearest as NN
from ..operators import polygons as P
from ..operators import sampling as SM
from ..operators.ordered import first_per_key
from ..operators.service import exact_or_nearest as exact_or_nearest_values, resolve_sources
from ..operators.spark_support import stored
from .registry import query
from .shape_queries import R
from .views import table, view, ways

BORDER_CELL = 0.5
FOOTPRINT_CELL = 100.0

# even-odd containment of sites in borders, as SQL
INSIDE = """inside as (select site_id, poly from (select s.site_id, b.poly,
 sum(case when (b.y1 > s.lat) <> (b.y2 > s.lat) and s.lon < b.x1 + (s.lat-b.y1)*(b.x2-b.x1)/(b.y2-b.y1) then 1 else 0 end) as hits
 from sites s join borders b on s.lat between -20 and 20.4e0 group by s.site_id, b.poly) t where hits % 2 = 1)"""


@query("attach_features", views="sites requests", oracle="""
select request_id, site_id, ghi, slope from requests left join sites using (site_id)""")
def attach_features(spark, sf):
    feats = view(spark, sf, "sites").select("site_id", "ghi", "slope")
    return view(spark, sf, "requests").join(feats, "site_id", "left").select("request_id", "site_id", "ghi", "slope")


@query("join_interior", views="plants footprints", oracle="""
with c as (select poly, cx, cy from footprints group by poly, cx, cy)
select plant_id, area_m2, cx as plon, cy as plat from plants join c on poly = plant_id where confidence <> 'D'""")
def join_interior(spark, sf):
    interior = view(spark, sf, "footprints").select(F.col("poly").alias("plant_id"), F.col("cx").alias("plon"), F.col("cy").alias("plat")).distinct()
    kept = view(spark, sf, "plants").where("confidence <> 'D'").drop("plat", "plon")
    return kept.join(interior, "plant_id", "inner").select("plant_id", "area_m2", "plon", "plat")


@query("join_scores3", views="sites", oracle="""
select s.site_id, s.ghi as suitability, d.cloud_cover as development, a.temperature as overlay from sites s
left join (select site_id, cloud_cover from sites where slope is not null) d using (site_id) left join (select site_id, temperature from sites where ndvi is not null) a using (site_id)""")
def join_scores3(spark, sf):
    s = view(spark, sf, "sites")
    suit = s.select("site_id", F.col("ghi").alias("suitability"))
    dev = s.where("slope is not null").select("site_id", F.col("cloud_cover").alias("development"))
    over = s.where("ndvi is not null").select("site_id", F.col("temperature").alias("overlay"))
    return suit.join(dev, "site_id", "left").join(over, "site_id", "left")


@query("point_in_polygon", views="sites borders", oracle=f"""
with {INSIDE} select s.site_id, min(poly) as poly from sites s left join inside using (site_id) group by s.site_id""")
def point_in_polygon(spark, sf):
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    return P.attach_polygon(points, view(spark, sf, "borders"), BORDER_CELL, "site_id").select("site_id", "poly")


@query("contains_filter", views="sites borders", oracle=f"""
with {INSIDE} select site_id, region from sites where site_id in (select site_id from inside)""")
def contains_filter(spark, sf):
    points = view(spark, sf, "sites").select("site_id", "region", "lat", "lon")
    return P.keep_inside(points, view(spark, sf, "borders"), BORDER_CELL, "site_id").select("site_id", "region")


@query("polygons_by_leaves", views="sites borders", oracle=f"""
with {INSIDE} select i.site_id, i.poly from inside i""")
def polygons_by_leaves(spark, sf):
    """Every polygon of every site, over cells that are split until four edges are left in each."""
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    return P.polygons_around(points, view(spark, sf, "borders"), 4 * BORDER_CELL, "site_id", most=4)


SEGMENT_D2 = """case when (b.x2-b.x1)*(b.x2-b.x1)+(b.y2-b.y1)*(b.y2-b.y1) = 0 then pow(p.x-b.x1,2)+pow(p.y-b.y1,2) else
 pow(p.x-(b.x1+(b.x2-b.x1)*least(greatest(((p.x-b.x1)*(b.x2-b.x1)+(p.y-b.y1)*(b.y2-b.y1))/((b.x2-b.x1)*(b.x2-b.x1)+(b.y2-b.y1)*(b.y2-b.y1)),0),1)),2)
 + pow(p.y-(b.y1+(b.y2-b.y1)*least(greatest(((p.x-b.x1)*(b.x2-b.x1)+(p.y-b.y1)*(b.y2-b.y1))/((b.x2-b.x1)*(b.x2-b.x1)+(b.y2-b.y1)*(b.y2-b.y1)),0),1)),2) end"""


@query("nearest_polygon", views="sites borders", oracle=f"""
with {INSIDE},
p as (select site_id, 6378137e0*radians(lon) as x, 6378137e0*ln(tan(pi()/4+radians(lat)/2)) as y from sites where site_id not in (select site_id from inside)),
b as (select poly, 6378137e0*radians(x1) as x1, 6378137e0*ln(tan(pi()/4+radians(y1)/2)) as y1, 6378137e0*radians(x2) as x2, 6378137e0*ln(tan(pi()/4+radians(y2)/2)) as y2 from borders),
d as (select site_id, poly, sqrt(min({SEGMENT_D2})) as m from p join b on true group by site_id, poly)
select site_id, arg_min(poly, (round(m, 3), poly)) as poly, round(min(m)/1000, 4) as km from d group by site_id""")
def nearest_polygon(spark, sf):
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    borders = view(spark, sf, "borders")
    inside = P.containing_polygons(points, P.polygon_cells(borders, BORDER_CELL), BORDER_CELL, "site_id")
    missed = stored(points.join(inside, "site_id", "left_anti").select(
        "site_id", merc_x(F.col("lon")).alias("x"), merc_y(F.col("lat")).alias("y")), "missed")
    flat = borders.select("poly", merc_x(F.col("x1")).alias("x1"), merc_y(F.col("y1")).alias("y1"),
                          merc_x(F.col("x2")).alias("x2"), merc_y(F.col("y2")).alias("y2"))
    hit = NN.nearest_segment(missed, NN.split_segments(flat, 50_000.0), "site_id", ["poly"])
    return hit.select("site_id", "poly", R(F.col("distance") / 1000, 4).alias("km"))


# One lattice over the latitude band: 256 rows from 56 degrees south, 720 columns; written from the definition.
LAND_SQL = """g as (select i, j, -56 + 0.25e0 + i*0.5e0 as lat, -180 + 0.25e0 + j*0.5e0 as lon
 from (select unnest(generate_series(0, 255)) as i), (select unnest(generate_series(0, 719)) as j)),
b as (select poly, min(y1) as south, max(y1) as north, min(x1) as west, max(x1) as east from borders group by poly),
h as (select e.poly, g.i, g.j, g.lat, g.lon, sum(case when (e.y1 > g.lat) <> (e.y2 > g.lat) and g.lon < e.x1 + (g.lat-e.y1)*(e.x2-e.x1)/(e.y2-e.y1) then 1 else 0 end) as hits
 from g join b on g.lat between south and north and g.lon between west and east join borders e on e.poly = b.poly group by e.poly, g.i, g.j, g.lat, g.lon),
l as (select min(poly) as poly, round(lat, 4) as lat, round(lon, 4) as lon, printf('C05_%06d', row_number() over (order by i, j) - 1) as pid from h where hits % 2 = 1 group by i, j, lat, lon)
"""


@query("land_cells", views="borders", oracle=f"with {LAND_SQL} select poly, lat, lon, pid from l")
def land_cells(spark, sf):
    return lattice.land_cells(view(spark, sf, "borders"), 0.5)


NEAREST_PLANT = """near as (select site_id, arg_min(plant_id, (round(d, 12), plant_id)) as plant_id, min(d) as d from (
 select s.site_id, p.plant_id, sqrt(pow(cos(radians(s.lat))*cos(radians(s.lon))-cos(radians(p.plat))*cos(radians(p.plon)),2)
 + pow(cos(radians(s.lat))*sin(radians(s.lon))-cos(radians(p.plat))*sin(radians(p.plon)),2) + pow(sin(radians(s.lat))-sin(radians(p.plat)),2)) as d
 from sites s join plants p on true) t group by site_id)"""


@query("nearest_cell", views="sites plants", oracle=f"""
with {NEAREST_PLANT} select site_id, plant_id, round(2*6371.0088e0*asin(d/2), 4) as km from near""")
def nearest_cell(spark, sf):
    hit = NN.nearest_on_sphere(view(spark, sf, "sites"), view(spark, sf, "plants"), "site_id", ["plant_id"], tlat="plat", tlon="plon")
    return hit.select("site_id", "plant_id", R("km", 4).alias("km"))


@query("far_from_plants", views="sites plants", oracle=f"""
with {NEAREST_PLANT} select s.site_id, s.lat, s.lon from sites s join near using (site_id) join plants using (plant_id)
where 2*6371.0088e0*asin(d/2) > 1 + sqrt(area_m2/pi())/1000""")
def far_from_plants(spark, sf):
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    return SM.far_from_plants(points, view(spark, sf, "plants"), "site_id").select("site_id", "lat", "lon")


@query("outside_buffer", views="footprints plants", oracle=f"""
with p as (select plant_id, plant_id*6007 % 40000 * 5e1 + (plant_id % 5)*3e2 as x, plant_id*7103 % 39989 * 5e1 as y from plants),
d as (select plant_id, min({SEGMENT_D2}) as d2 from p join footprints b on true group by plant_id)
select plant_id from d where d2 > 1e6""")
def outside_buffer(spark, sf):
    pts = view(spark, sf, "plants").selectExpr("plant_id", "plant_id*6007 % 40000 * 5e1 + (plant_id % 5)*3e2 as x", "plant_id*7103 % 39989 * 5e1 as y")
    return SM.outside_buffer(pts, view(spark, sf, "footprints"), "plant_id", K.OUTER_BUFFER_M, FOOTPRINT_CELL).select("plant_id")


def densified(ways_df, step: float):
    """Vertices of polylines spaced at most `step`: consecutive vertices meet by position, not by a window."""
    nxt = ways_df.select("way_id", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    seg = ways_df.join(nxt, ["way_id", "seq"]).withColumn("length", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / step)).cast("int")
    pts = seg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("i") / F.col("n")
    inner = pts.select("way_id", "seq", "i", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))
    # a way with a single vertex gives nothing, so the start comes from the first segment
    start = seg.where("seq = 1").select("way_id", F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("i"), "x", "y")
    return start.unionByName(inner)


@query("segments", views="ways", oracle="""
select * from (select way_id, seq, round(sqrt(pow(lead(x) over w - x, 2) + pow(lead(y) over w - y, 2)), 6) as length from ways window w as (partition by way_id order by seq)) t
where length is not null""")
def segments(spark, sf):
    w = ways(spark, sf)
    nxt = w.select("way_id", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return w.join(nxt, ["way_id", "seq"]).select("way_id", "seq", R(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), 6).alias("length"))


@query("densify_points", views="ways", oracle="""
with s as (select way_id, seq, x, y, lead(x) over w as x2, lead(y) over w as y2 from ways window w as (partition by way_id order by seq)),
n as (select *, greatest(1, cast(ceil(sqrt(pow(x2-x,2)+pow(y2-y,2))/5000) as int)) as n from s where x2 is not null),
p as (select *, unnest(generate_series(1, n)) as i from n),
a as (select way_id, x + (i*1e0/n)*(x2-x) as px, y + (i*1e0/n)*(y2-y) as py from p union all select way_id, x, y from n where seq = 1)
select way_id, count(*) as points, round(sum(px), 3) as sx, round(sum(py), 3) as sy from a group by way_id""")
def densify_points(spark, sf):
    return densified(ways(spark, sf), 5000.0).groupBy("way_id").agg(F.count("*").alias("points"), R(F.sum("x"), 3).alias("sx"), R(F.sum("y"), 3).alias("sy"))


@query("dist_infrastructure", views="ways plants", oracle="""
with p as (select plant_id, (plant_id*7103 % 100000)*1e0 as x, (plant_id*6007 % 99991)*1e0 as y from plants),
d as (select plant_id, sqrt(min(case when way_id % 2 = 0 then pow(w.x-p.x,2)+pow(w.y-p.y,2) end)) as road, sqrt(min(case when way_id % 2 = 1 then pow(w.x-p.x,2)+pow(w.y-p.y,2) end)) as line,
 sqrt(min(case when seq = 1 then pow(w.x-p.x,2)+pow(w.y-p.y,2) end)) as sub from p join ways w on true group by plant_id)
select plant_id, round(road/1000, 6) as dist_road_km, round(line/1000, 6) as dist_powerline_km, round(sub/1000, 6) as dist_substation_km from d""")
def dist_infrastructure(spark, sf):
    w = stored(ways(spark, sf), "ways")  # read by three layers
    pts = view(spark, sf, "plants").selectExpr("plant_id", "(plant_id*7103 % 100000)*1e0 as x", "(plant_id*6007 % 99991)*1e0 as y")
    out = NN.distance_index(pts, {"dist_road_km": w.where("way_id % 2 = 0"), "dist_powerline_km": w.where("way_id % 2 = 1"),
                               "dist_substation_km": w.where("seq = 1")}, "plant_id")
    return out.select("plant_id", *[R(c, 6).alias(c) for c in out.columns[1:]])


@query("relation_area", views="footprints", oracle="""
with r as (select poly, ring, any_value(role) as role, abs(sum(x1*y2-x2*y1))/2 as a from footprints group by poly, ring)
select poly, round(sum(case when role = 'inner' then -a else a end), 3) as area from r group by poly""")
def relation_area(spark, sf):
    return P.ring_area(view(spark, sf, "footprints")).select("poly", R("area", 3).alias("area"))


@query("dissolve_sites")
def dissolve_sites(spark, sf):
    return D.dissolve_sites(view(spark, sf, "footprints"), K.DISSOLVE_GAP_M, K.MIN_SITE_AREA_M2).select("poly", "site", R("site_area", 3).alias("site_area"))


def shifted(footprints):
    """A copy of the footprints moved by 40 m, standing for the site polygons."""
    return footprints.where("role = 'outer' and kind = 'plant'").selectExpr("poly", "x1 + 4e1 as x1", "y1 + 1.3e1 as y1", "x2 + 4e1 as x2", "y2 + 1.3e1 as y2")


@query("site_constituents", views="footprints", oracle="""
with raw as (select poly, kind, cx, cy, w from footprints group by poly, kind, cx, cy, w), s as (select poly as site, cx + 4e1 as cx, cy + 1.3e1 as cy, w from raw where kind = 'plant'),
pair as (select site, r.poly, s.cx as sx, s.cy as sy, s.w as sw, r.cx, r.cy, r.w from s join raw r on abs(s.cx-r.cx) <= s.w+r.w and abs(s.cy-r.cy) <= s.w+r.w)
select site, poly from pair where not (sx-sw > cx+w or cx-w > sx+sw or sy-sw > cy+w or cy-w > sy+sw)
 and cy-w <= sy + 0.9e0*sw - 0.1e0*(least(sx+sw, cx+w)*0 + greatest(sx-sw, cx-w) - sx)
 and sy-sw <= cy + 0.9e0*w - 0.1e0*(greatest(sx-sw, cx-w) - cx)""")
def site_constituents(spark, sf):
    foot = view(spark, sf, "footprints")
    raw = foot.where("role = 'outer'").select("poly", "x1", "y1", "x2", "y2")
    return D.intersecting_constituents(shifted(foot), raw, FOOTPRINT_CELL)


@query("site_metadata", views="footprints", oracle="""
with f as (select distinct poly as idx, cast(floor(poly/4e0) as bigint) as site, kind, name, start_date from footprints),
h as (select site, bool_or(kind = 'plant') as has, count(*) as n_parts from f group by site)
select site, n_parts, coalesce((select name from f where f.site = h.site and name <> '' and (kind = 'plant' or not has) order by idx limit 1), '') as name,
 coalesce((select start_date from f where f.site = h.site and start_date <> '' and (kind = 'plant' or not has) order by idx limit 1), '') as start_date from h""")
def site_metadata(spark, sf):
    parts = view(spark, sf, "footprints").select(F.col("poly").alias("idx"), F.floor(F.col("poly") / 4).cast("bigint").alias("site"), "kind", "name", "start_date").distinct()
    return D.site_metadata(parts)


@query("footprint_total", views="footprints", oracle="""
with r as (select poly, ring, any_value(role) as role, abs(sum(x1*y2-x2*y1))/2 as a from footprints group by poly, ring),
p as (select poly, sum(case when role = 'inner' then -a else a end) as area from r group by poly)
select count(*) as sites, round(sum(area)/1e6, 9) as km2 from p""")
def footprint_total(spark, sf):
    return P.ring_area(view(spark, sf, "footprints")).agg(F.count("*").alias("sites"), R(F.sum("area") / 1e6).alias("km2"))


@query("largest_sites", views="plants", oracle="select plant_id, round(area_m2/1e6, 9) as km2 from plants order by area_m2 desc, plant_id limit 8")
def largest_sites(spark, sf):
    return view(spark, sf, "plants").orderBy(F.desc("area_m2"), "plant_id").limit(8).select("plant_id", R(F.col("area_m2") / 1e6).alias("km2"))


@query("dedupe_tiles", views="plants", oracle="""
with t as (select plant_id, tile from plants, (values (0),(1),(2)) v(tile) where plat > 10*tile - 10)
select plant_id, min(tile) as tile from t group by plant_id""")
def dedupe_tiles(spark, sf):
    tiles = view(spark, sf, "plants").select("plant_id", "plat", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("tile")) \
        .where("plat > 10*tile - 10")
    return first_per_key(tiles, ["plant_id"], ["tile"]).select("plant_id", "tile")


@query("exact_or_nearest", views="sites plants", oracle=f"""
with {NEAREST_PLANT}
select s.site_id, coalesce(case when s.slope < 5 then s.ghi*100 end, p.capacity_mw) as value,
 case when s.slope < 5 then 0e0 else round(2*6371.0088e0*asin(d/2), 1) end as feature_km
from sites s join near using (site_id) join plants p using (plant_id)""")
def exact_or_nearest(spark, sf):
    points = view(spark, sf, "sites").select("site_id", "lat", "lon")
    exact = view(spark, sf, "sites").where("slope < 5").select("site_id", (F.col("ghi") * 100).alias("value"))
    cells = view(spark, sf, "plants").select("plant_id", F.col("plat").alias("lat"), F.col("plon").alias("lon"), F.col("capacity_mw").alias("value"))
    return exact_or_nearest_values(points, exact, cells, "site_id", "plant_id").select("site_id", "value", R("feature_km", 1).alias("feature_km"))


@query("source_priority", views="sites plants", oracle=f"""
with {NEAREST_PLANT}
select s.site_id, case when s.landcover = 16 then 'cached' when s.slope < 5 then 'live' else 'grid_estimate' end as source,
 case when s.landcover = 16 then s.ghi when s.slope < 5 then s.ghi + 1 else p.capacity_mw end as ghi,
 case when s.landcover = 16 or (s.slope < 5) then null else round(2*6371.0088e0*asin(d/2), 1) end as cell_km
from sites s join near using (site_id) join plants p using (plant_id)
where s.landcover = 16 or (s.slope < 5) or 2*6371.0088e0*asin(d/2) <= 60""")
def source_priority(spark, sf):
    s = view(spark, sf, "sites")
    cached = s.where("landcover = 16").select("site_id", "ghi")
    live = s.where("slope < 5").select("site_id", (F.col("ghi") + 1).alias("ghi"))
    cells = view(spark, sf, "plants").select("plant_id", F.col("plat").alias("lat"), F.col("plon").alias("lon"), F.col("capacity_mw").alias("ghi"))
    return resolve_sources(s.select("site_id", "lat", "lon"), cached, live, cells, "site_id", "plant_id", ["ghi"]).select(
        "site_id", "provenance.source", "ghi", R("provenance.cell_km", 1).alias("cell_km"))


# ---------------------------------------------------------------- sampling and labels

UNIFORM = "((cast(('0x' || substr(md5(concat('{salt}:', {key})), 1, 8)) as bigint) + 0.5e0)/4294967296e0)"


def u_sql(key: str, salt: str = "42") -> str:
    return UNIFORM.format(salt=salt, key=key)


@query("weighted_topn", views="plants", oracle=f"""
with k as (select plant_id, region, row_number() over (partition by region order by -ln({u_sql('plant_id')})/sqrt(area_m2), plant_id) as rn from plants where area_m2 >= 10000 and confidence <> 'D')
select plant_id, region from k where rn <= 10""")
def weighted_topn(spark, sf):
    from ..operators.shaping import eligible_plants
    chosen = SM.weighted_top(eligible_plants(view(spark, sf, "plants")), ["region"], "plant_id", F.sqrt("area_m2"), 10)
    return chosen.select("plant_id", "region")


@query("first_n", views="sites", oracle=f"select site_id from sites order by {u_sql('site_id', 'cut')}, site_id limit 100")
def first_n(spark, sf):
    return SM.first_n(view(spark, sf, "sites").select("site_id"), "site_id", 100, "cut")


@query("keep_first", views="requests", oracle="select site_id, min(request_id) as request_id from requests group by site_id")
def keep_first(spark, sf):
    return first_per_key(view(spark, sf, "requests"), ["site_id"], ["request_id"]).select("site_id", "request_id")


@query("stratified_split", views="sites", oracle="""
with g as (select concat('B', cast(floor(lat/2) as int), '_', cast(floor(lon/2) as int)) as group_id, site_id, label from sites), y as (select group_id, max(label) as y from g group by group_id)
select site_id, cast(cast(('0x' || substr(md5(concat('42:', y, '|', group_id)), 1, 8)) as bigint) % 5 as int) as fold,
 cast(('0x' || substr(md5(concat('42:', y, '|', group_id)), 1, 8)) as bigint) % 5 = 0 as is_test from g join y using (group_id)""")
def stratified_split(spark, sf):
    s = SM.with_blocks(view(spark, sf, "sites").select("site_id", "lat", "lon", "label"))
    return SM.stratified_fold(s, "group_id", "label").select("site_id", "fold", "is_test")


@query("group_folds", views="sites", oracle="""
select site_id, cast(cast(('0x' || substr(md5(concat('42:B', cast(floor(lat/2) as int), '_', cast(floor(lon/2) as int))), 1, 8)) as bigint) % 5 as int) as fold from sites""")
def group_folds(spark, sf):
    return SM.group_folds(SM.with_blocks(view(spark, sf, "sites")), "group_id").select("site_id", "fold")


# Draws are numbered from 0; a SQL text tries a fixed number that is ample for the accepted share and keeps the first ones.
def box_sql(sfx: str, tries: str, south: str, north: str, west: str, east: str) -> str:
    low, high = f"sin(radians({south}))", f"sin(radians({north}))"
    return f"""n{sfx} as (select unnest(range(0, cast({tries} as bigint))) as draw),
cand{sfx} as (select draw, round(degrees(asin({low} + {u_sql('draw', 'lat')}*({high} - {low}))), 7) as lat, round({west} + {u_sql('draw', 'lon')}*({east} - {west}), 7) as lon from n{sfx})"""


def land_sql(sfx: str) -> str:
    return f"""land{sfx} as (select distinct draw from (select c.draw, b.poly,
 sum(case when (b.y1 > c.lat) <> (b.y2 > c.lat) and c.lon < b.x1 + (c.lat-b.y1)*(b.x2-b.x1)/(b.y2-b.y1) then 1 else 0 end) as hits
 from cand{sfx} c join borders b on c.lat between -20 and 21 and c.lon between 60 and 101 group by c.draw, b.poly) t where hits % 2 = 1)"""


def accepted_sql(sfx: str, limit: int) -> str:
    """ok: candidates on land and far from plants, the first `limit` by number."""
    return f"""{land_sql(sfx)},
near{sfx} as (select draw, arg_min(area_m2, (round(d, 12), plant_id, area_m2)) as area_m2, min(d) as d from (
 select s.draw, p.plant_id, p.area_m2, sqrt(pow(cos(radians(s.lat))*cos(radians(s.lon))-cos(radians(p.plat))*cos(radians(p.plon)),2)
 + pow(cos(radians(s.lat))*sin(radians(s.lon))-cos(radians(p.plat))*sin(radians(p.plon)),2) + pow(sin(radians(s.lat))-sin(radians(p.plat)),2)) as d
 from cand{sfx} s join plants p on true where s.draw in (select draw from land{sfx})) t group by draw),
ok{sfx} as (select c.draw, c.lat, c.lon from cand{sfx} c join near{sfx} using (draw) where 2*6371.0088e0*asin(d/2) > 1 + sqrt(area_m2/pi())/1000 order by c.draw limit {limit})"""


REGION_SQL = f"""pin as (select plant_id, min(poly) as poly from (select p.plant_id, b.poly,
 sum(case when (b.y1 > p.plat) <> (b.y2 > p.plat) and p.plon < b.x1 + (p.plat-b.y1)*(b.x2-b.x1)/(b.y2-b.y1) then 1 else 0 end) as hits
 from plants p join borders b on true group by p.plant_id, b.poly) t where hits % 2 = 1 group by plant_id),
pm as (select plant_id, 6378137e0*radians(plon) as x, 6378137e0*ln(tan(pi()/4+radians(plat)/2)) as y from plants where plant_id not in (select plant_id from pin)),
bm as (select poly, 6378137e0*radians(x1) as x1, 6378137e0*ln(tan(pi()/4+radians(y1)/2)) as y1, 6378137e0*radians(x2) as x2, 6378137e0*ln(tan(pi()/4+radians(y2)/2)) as y2 from borders),
pd as (select plant_id, poly, sqrt(min({SEGMENT_D2})) as m from pm p join bm b on true group by plant_id, poly),
pq as (select * from pin union all select plant_id, arg_min(poly, (round(m, 3), poly)) from pd group by plant_id),
preg as (select plant_id, poly, region from pq join (select distinct poly, region from borders) using (poly))"""
POSITIVES_SQL = f"""{REGION_SQL},
pos as (select * from (select p.plant_id, plat, plon, area_m2, capacity_mw, r.poly, r.region,
 row_number() over (partition by r.region order by -ln({u_sql('p.plant_id')})/sqrt(area_m2), p.plant_id) as rn
 from plants p join preg r using (plant_id) where area_m2 >= 10000 and confidence <> 'D') t where rn <= {K.MAX_POSITIVES_PER_REGION})"""
BACKGROUND = box_sql("b", "220000", f"{K.LATITUDE_BAND[0]}e0", f"{K.LATITUDE_BAND[1]}e0", "-180e0", "180e0")
HARD = f"""nh as (select unnest(range(0, 40000)) as draw), placed as (select plat, plon, row_number() over (order by plant_id) as pos from pos),
t1 as (select draw, cast(floor({u_sql('draw', 'source')}*(select count(*) from pos)) as bigint) + 1 as pos from nh),
t2 as (select *, sqrt(25 + {u_sql('draw', 'km')}*(10000-25))/6371.0088e0 as d, radians({u_sql('draw', 'bearing')}*360) as b, radians(plat) as la from t1 join placed using (pos)),
t3 as (select *, sin(la)*cos(d) + cos(la)*sin(d)*cos(b) as s2 from t2),
candh as (select draw, round(degrees(asin(s2)), 7) as lat, round(((plon + degrees(atan2(sin(b)*sin(d)*cos(la), cos(d)-sin(la)*s2)) + 540) % 360) - 180, 7) as lon from t3)"""


@query("assign_region", views="plants borders", oracle=f"with {REGION_SQL} select plant_id, poly, region from preg")
def assign_region(spark, sf):
    plants = view(spark, sf, "plants").select("plant_id", F.col("plat").alias("lat"), F.col("plon").alias("lon"))
    return SM.assign_region(plants, view(spark, sf, "borders"), BORDER_CELL, "plant_id").select("plant_id", "poly", "region")


def positives(spark, sf):
    from ..operators.shaping import eligible_plants
    plants = eligible_plants(view(spark, sf, "plants")).withColumnsRenamed({"plat": "lat", "plon": "lon"}).drop("region")
    return stored(SM.select_positives(plants, view(spark, sf, "borders"), BORDER_CELL), "positives")


def land_and_far(spark, sf):
    land, plants = stored(P.polygon_cells(view(spark, sf, "borders"), BORDER_CELL), "land"), view(spark, sf, "plants")
    return lambda candidates: SM.accept(candidates, "draw", land, BORDER_CELL, plants)


def background_negatives(spark, keep):
    """As many as the labelled set asks for, uniform over all land of the latitude band."""
    return SM.sample_exact(spark, lambda ids: SM.background_candidates(ids, "draw", *K.LATITUDE_BAND, -180, 180), keep, K.N_BACKGROUND)


def hard_negatives(spark, keep, chosen):
    """Negatives in the surroundings of chosen positives; none where nothing was chosen."""
    placed, count = SM.numbered(chosen.select("plant_id", "lat", "lon"), "plant_id")
    return SM.sample_exact(spark, lambda ids: SM.hard_draws(ids, "draw", placed, count), keep, K.N_HARD if count else 0)


@query("sample_background", views="plants borders", oracle=f"with {BACKGROUND}, {accepted_sql('b', K.N_BACKGROUND)} select draw, lat, lon from okb")
def sample_background(spark, sf):
    return background_negatives(spark, land_and_far(spark, sf)).select("draw", "lat", "lon")


@query("sample_hard", views="plants borders", oracle=f"with {POSITIVES_SQL}, {HARD}, {accepted_sql('h', K.N_HARD)} select draw, lat, lon from okh")
def sample_hard(spark, sf):
    return hard_negatives(spark, land_and_far(spark, sf), positives(spark, sf)).select("draw", "lat", "lon")


@query("sample_interior")
def sample_interior(spark, sf):
    foot = view(spark, sf, "footprints").select("poly", "ring", "role", "x1", "y1", "x2", "y2")
    return SM.interior_points(foot, SM.points_per_area(F.col("area")), K.INNER_BUFFER_M).select(
        "poly", "rn", R("x", 4).alias("x"), R("y", 4).alias("y"), R("margin", 4).alias("margin"))


METRIC_SQL = """k as (select 6378137.0e0/(1+n)*(1+n*n/4+n*n*n*n/64) as a, n/2-2*n*n/3+5*n*n*n/16+41*n*n*n*n/180 as a1,
  13*n*n/48-3*n*n*n/5+557*n*n*n*n/1440 as a2, 61*n*n*n/240-103*n*n*n*n/140 as a3, 49561*n*n*n*n/161280 as a4, 2*sqrt(n)/(1+n) as e
  from (select (1/298.257223563e0)/(2-1/298.257223563e0) as n)),
km as (select draw, lat, lon, sinh(atanh(sin(radians(lat))) - e*atanh(e*sin(radians(lat)))) as t, radians(lon-81) as d, k.* from candr, k where draw in (select draw from landr)),
ku as (select *, atan2(t, cos(d)) as xi, asinh(sin(d)/sqrt(t*t+cos(d)*cos(d))) as eta from km),
kp as (select draw, lat, lon, 500000 + 0.9996e0*a*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta) + a4*cos(8*xi)*sinh(8*eta)) as x,
  0.9996e0*a*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta) + a4*sin(8*xi)*cosh(8*eta)) as y from ku)"""
WANTED_SQL = f"""wanted as (select cast(floor({K.NEGATIVE_RATIO}*sum(least(greatest(round_even(area/10000*{K.POINTS_PER_HA}, 0), 1), {K.MAX_POINTS_PER_POLYGON}))) as bigint) as w from (
 select poly, sum(case when role = 'inner' then -r else r end) as area from (select poly, ring, role, abs(sum(x1*y2 - x2*y1))/2 as r from footprints group by poly, ring, role) q group by poly) q2)"""
BOUNDS = ["(select min(y1) from borders)", "(select max(y1) from borders)", "(select min(x1) from borders)", "(select max(x1) from borders)"]


@query("sample_region_negatives", views="borders footprints", oracle=f"""
with {WANTED_SQL}, {box_sql('r', '(select 3*w + 200 from wanted)', *BOUNDS)}, {land_sql('r')}, {METRIC_SQL},
f as (select p.draw, min(p.lat) as lat, min(p.lon) as lon from kp p join footprints b on true group by p.draw having min({SEGMENT_D2}) > 1e6)
select draw, lat, lon, concat('B', cast(floor(lat/25e-2) as int), '_', cast(floor(lon/25e-2) as int)) as group_id from f
where draw in (select draw from f order by draw limit (select w from wanted))""")
def sample_region_negatives(spark, sf):
    """Uniform points in a region's box, inside its polygons and outside the buffers of footprints: 1.5 for every interior point wanted."""
    borders, foot = view(spark, sf, "borders"), view(spark, sf, "footprints")
    land = stored(P.polygon_cells(borders, BORDER_CELL), "land")
    positive = P.ring_area(foot).agg(F.sum(SM.points_per_area(F.col("area")))).first()[0] or 0
    bounds = borders.agg(F.min("y1"), F.max("y1"), F.min("x1"), F.max("x1")).first()

    def keep(candidates):
        x, y = project_metric(F.col("lat"), F.col("lon"))
        found = P.containing_polygons(candidates, land, BORDER_CELL, "draw").select("draw").distinct()
        inside = stored(candidates.join(found, "draw", "left_semi").withColumns({"x": x, "y": y}), "inside")
        return SM.outside_buffer(inside, foot, "draw", K.OUTER_BUFFER_M, FOOTPRINT_CELL)

    kept = SM.sample_exact(spark, lambda ids: SM.background_candidates(ids, "draw", *bounds), keep, int(K.NEGATIVE_RATIO * positive))
    return SM.with_blocks(kept, 0.25).select("draw", "lat", "lon", "group_id")


@query("union_labels", views="plants sites", oracle="""
select plant_id as id, area_m2, cast(1 as int) as label, '' as neg_type from plants union all select site_id, null, 0, 'background' from sites where neg_type = 'background'
union all select site_id, null, 0, 'hard' from sites where neg_type = 'hard'""")
def union_labels(spark, sf):
    s = view(spark, sf, "sites").select(F.col("site_id").alias("id"), F.lit(0).alias("label"), "neg_type")
    pos = view(spark, sf, "plants").select(F.col("plant_id").alias("id"), "area_m2", F.lit(1).alias("label"), F.lit("").alias("neg_type"))
    return pos.unionByName(s.where("neg_type = 'background'"), allowMissingColumns=True) \
        .unionByName(s.where("neg_type = 'hard'"), allowMissingColumns=True)


BANDS = ["ghi", "temperature", "cloud_cover", "elevation", "slope", "aspect", "accessibility", "worldcover", *[
    f"{b}{sfx}" for sfx in ("_pre", "") for b in ("ndvi", "ndbi", "lst", "landcover", "nightlights", "population")]]


@query("build_labelled", views="plants borders sites", oracle=f"""
with {POSITIVES_SQL}, {BACKGROUND}, {accepted_sql('b', K.N_BACKGROUND)}, {HARD}, {accepted_sql('h', K.N_HARD)},
neg as (select 'B' as src, draw as id, lat, lon, 'background' as neg_type from okb union all select 'H', draw, lat, lon, 'hard' from okh),
npoly as (select src, id, min(poly) as poly from (select c.src, c.id, b.poly,
 sum(case when (b.y1 > c.lat) <> (b.y2 > c.lat) and c.lon < b.x1 + (c.lat-b.y1)*(b.x2-b.x1)/(b.y2-b.y1) then 1 else 0 end) as hits
 from neg c join borders b on true group by c.src, c.id, b.poly) t where hits % 2 = 1 group by src, id),
u as (select concat('P-', plant_id) as pid, plat as lat, plon as lon, 1 as label, '' as neg_type, area_m2, capacity_mw, poly, region from pos
 union all select concat(src, '-', id), lat, lon, 0, neg_type, null, null, poly, region from neg join npoly using (src, id) join (select distinct poly, region from borders) using (poly)),
d as (select u.pid, s.site_id, sqrt(pow(cos(radians(u.lat))*cos(radians(u.lon))-cos(radians(s.lat))*cos(radians(s.lon)),2)
 + pow(cos(radians(u.lat))*sin(radians(u.lon))-cos(radians(s.lat))*sin(radians(s.lon)),2) + pow(sin(radians(u.lat))-sin(radians(s.lat)),2)) as d from u join sites s on true),
m as (select pid, arg_min(site_id, (round(d, 12), site_id)) as site_id from d group by pid)
select u.pid, u.lat, u.lon, cast(u.label as int) as label, u.neg_type, u.area_m2, u.capacity_mw, u.poly, u.region,
 concat('B', cast(floor(u.lat/2) as int), '_', cast(floor(u.lon/2) as int)) as group_id, {', '.join('s.' + b for b in BANDS)}
from u join m using (pid) join sites s using (site_id)""")
def build_labelled(spark, sf):
    """Positives, background and hard negatives to their full counts, regions, blocks and all bands of the nearest measured place."""
    chosen, keep = positives(spark, sf), land_and_far(spark, sf)
    pos = chosen.select(F.concat(F.lit("P-"), F.col("plant_id")).alias("pid"), "lat", "lon", "area_m2", "capacity_mw", "poly", "region",
                        F.lit(1).alias("label"), F.lit("").alias("neg_type"))
    named = lambda df, src, kind: df.select(F.concat(F.lit(src), F.col("draw")).alias("pid"), "lat", "lon", F.lit(0).alias("label"), F.lit(kind).alias("neg_type"))
    neg = stored(named(background_negatives(spark, keep), "B-", "background").unionByName(named(hard_negatives(spark, keep, chosen), "H-", "hard")), "negatives")
    neg = SM.assign_region(neg, view(spark, sf, "borders"), BORDER_CELL, "pid")
    points = stored(SM.with_blocks(pos.unionByName(neg, allowMissingColumns=True)), "labelled")
    sites = view(spark, sf, "sites")
    hit = NN.nearest_on_sphere(points, sites, "pid", ["site_id"]).select("pid", "site_id")
    return points.join(hit, "pid", "left").join(sites.select("site_id", *BANDS), "site_id", "left").select(
        "pid", "lat", "lon", "label", "neg_type", "area_m2", "capacity_mw", "poly", "region", "group_id", *BANDS)


@query("grid_features", views="borders cells", oracle=f"""
with n as (select max(r) as nr from cells), {LAND_SQL}
select pid, z, code from l left join cells k on l.lat between 8 and 8 + (select nr from n)*0.5e0 and l.lon between 70 and 94.5e0 and k.r = ceil((l.lat-8)/0.5e0) and k.c = ceil((l.lon-70)/0.5e0)""")
def grid_features(spark, sf):
    from ..operators import raster as RS
    from .raster_queries import raster
    cells = raster(spark, sf)
    nrows = RS.extent(cells)[1] + 1
    land = lattice.land_cells(view(spark, sf, "borders"), 0.5)
    return RS.pixel_lookup(land, cells, 8.0, 0.5, nrows, 70.0, 0.5, 50, ["z", "code"]).select("pid", "z", "code")

