"""Projections, filters, predicates and scalar functions."""
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import features as FT
from ..functions import geo as G
from ..functions import nulls as N
from ..functions import spectral as S
from ..operators import shaping
from ..operators.polygons import centroids
from ..sources.tables import LABELLED_POINTS
from .registry import query
from .views import table, view


def R(x, n=9):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


@query("inventory_projection", views="plants footprints", oracle="""
with r as (select poly, ring, any_value(role) as role, sum(x1*y2-x2*y1) as a, sum((x1+x2)*(x1*y2-x2*y1)) as sx, sum((y1+y2)*(x1*y2-x2*y1)) as sy
  from footprints group by poly, ring),
s as (select *, sign(a)*(case when role = 'inner' then -1 else 1 end) as f from r),
o as (select poly, sum(f*a) as a, sum(f*sx) as sx, sum(f*sy) as sy from s group by poly)
select plant_id as unique_id, area_m2, capacity_mw, confidence, round(sx/(3*a), 3) as x, round(sy/(3*a), 3) as y
from plants join o on poly = plant_id""")
def inventory_projection(spark, sf):
    centre = centroids(view(spark, sf, "footprints"))
    return view(spark, sf, "plants").join(centre, F.col("poly") == F.col("plant_id")).select(
        F.col("plant_id").alias("unique_id"), "area_m2", "capacity_mw", "confidence", R("cx", 3).alias("x"), R("cy", 3).alias("y"))


@query("eligible_plants", views="plants", oracle="""
select plant_id, area_m2 from plants where area_m2 >= 10000 and confidence in ('A','B','C')""")
def eligible_plants(spark, sf):
    return shaping.eligible_plants(view(spark, sf, "plants")).select("plant_id", "area_m2")


@query("scene_filter", views="obs", oracle="""
select sensor, count(*) as n, round(sum(red_dn), 4) as red from obs
where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and scene_cloud_pct < 60 group by sensor""")
def scene_filter(spark, sf):
    kept = shaping.scene_filter(view(spark, sf, "obs"), "2024-01-05", "2024-01-20", 60)
    return kept.groupBy("sensor").agg(F.count("*").alias("n"), R(F.sum("red_dn"), 4).alias("red"))


@query("admin_filter", oracle="""
select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and c_mktsegment = 'MACHINERY'""")
def admin_filter(spark, sf):
    areas = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    both = table(spark, sf, "customer").join(areas, F.expr("c_nationkey = n_nationkey"))
    return shaping.admin_filter(both, {"r_name": "ASIA", "c_mktsegment": "MACHINERY"}).select("c_custkey", "n_name")


@query("in_list", views="plants", oracle="""
select plant_id, area_m2 from plants where plant_id in (select s_suppkey from supplier where s_acctbal > 5000)""")
def in_list(spark, sf):
    wanted = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("plant_id"))
    return shaping.in_list(view(spark, sf, "plants"), wanted, "plant_id").select("plant_id", "area_m2")


@query("map_region_group", oracle="""
select n_nationkey, case r_name when 'AFRICA' then 'Africa' when 'EUROPE' then 'Europe' else 'Other' end as grp
from nation join region on n_regionkey = r_regionkey""")
def map_region_group(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return both.select("n_nationkey", FT.region_group(F.initcap("r_name")).alias("grp"))


@query("assign_ids", views="sites", oracle="""
select site_id, printf('G%06d', row_number() over (order by site_id) - 1) as pid from sites""")
def assign_ids(spark, sf):
    return shaping.assign_ids(view(spark, sf, "sites").select("site_id"), "site_id", "G")


@query("spatial_block", views="sites", oracle="""
select site_id, concat('B', cast(floor(lat/2) as int), '_', cast(floor(lon/2) as int)) as block2,
  concat('B', cast(floor(lat/0.25e0) as int), '_', cast(floor(lon/0.25e0) as int)) as block025 from sites""")
def spatial_block(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    return view(spark, sf, "sites").select("site_id", G.block_id(lat, lon).alias("block2"), G.block_id(lat, lon, 0.25).alias("block025"))


@query("tag_regex", oracle="""
with t as (select o_orderkey, case o_orderkey % 5 when 0 then 'motorway' when 1 then 'trunk_link' when 2 then 'residential'
  when 3 then 'tertiary' else null end as highway from orders)
select o_orderkey, highway from t where regexp_matches(highway, '^(motorway|trunk|primary|secondary|tertiary)(_link)?$')""")
def tag_regex(spark, sf):
    # Road classes that count as infrastructure.
    pattern = "^(motorway|trunk|primary|secondary|tertiary)(_link)?$"
    kind = F.expr("case o_orderkey % 5 when 0 then 'motorway' when 1 then 'trunk_link' when 2 then 'residential' when 3 then 'tertiary' end")
    tagged = table(spark, sf, "orders").select("o_orderkey", F.create_map(F.lit("highway"), kind).alias("tags"))
    return tagged.where(shaping.tag_matches(F.col("tags"), "highway", pattern)).select(
        "o_orderkey", F.element_at("tags", "highway").alias("highway"))


@query("bbox_filter", views="sites", oracle="""
select site_id, lat, lon from sites where lat between -5.3 and 10.3 and lon between 69.7 and 85.3""")
def bbox_filter(spark, sf):
    box = G.in_box(F.col("lat"), F.col("lon"), -5, 10, 70, 85, pad=0.3)
    return view(spark, sf, "sites").where(box & G.valid_coordinates(F.col("lat"), F.col("lon"))).select("site_id", "lat", "lon")


@query("valid_mask", views="sites", oracle="""
select site_id, slope, case when nightlights > 0 then nightlights end as nightlights from sites where slope is not null and ndvi is not null""")
def valid_mask(spark, sf):
    kept = N.drop_incomplete(view(spark, sf, "sites"), ["slope", "ndvi"])
    return kept.select("site_id", "slope", N.positive_only(F.col("nightlights")).alias("nightlights"))


@query("pre_post_columns", views="sites", oracle="""
select site_id, 'pre' as epoch, ndvi_pre as ndvi, ndbi_pre as ndbi, lst_pre as lst, landcover_pre as landcover, nightlights_pre as nightlights, population_pre as population from sites
union all select site_id, 'current', ndvi, ndbi, lst, landcover, nightlights, population from sites""")
def pre_post_columns(spark, sf):
    sites = view(spark, sf, "sites")
    # one scan, two rows per site
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), *[F.col(s).alias(c) for c, s in shaping.epoch_columns(e).items()])
                               for e in ("pre", "current")]))
    return sites.select("site_id", both.alias("e")).select("site_id", "e.*")


@query("validate_requests", views="requests sites", oracle="""
with r as (select request_id, site_id, area_m2 - 4200e0 as area_m2, case when request_id % 7 = 0 then 0.6e0 else 0.2e0 end as efficiency,
  case when request_id % 11 = 0 then 1.2e0 else 0.75e0 end as performance_ratio,
  case when request_id % 13 = 0 then 95e0 else 10e0 + site_id/100e0 end as lat, 20e0 as lon, cast(floor(request_id/4e0) as bigint) as compare_id from requests),
c as (select compare_id, count(*) as n, count(distinct concat(round_even(lat,4), '_', round_even(lon,4))) as d from r group by compare_id)
select request_id, case when lat not between -90 and 90 then 'coordinates out of range'
  when not (area_m2 > 0 and area_m2 <= 1e9) then 'area out of range'
  when efficiency > 0.5 then 'efficiency out of range' when performance_ratio > 1 then 'performance ratio out of range'
  when n < 2 or n > 5 then 'two to five sites are needed' when d < n then 'sites must be distinct locations' end as error
from r join c using (compare_id)""")
def validate_requests(spark, sf):
    r = view(spark, sf, "requests").selectExpr(
        "request_id", "area_m2 - 4200e0 as area_m2", "case when request_id % 7 = 0 then 6e-1 else 2e-1 end as efficiency",
        "case when request_id % 11 = 0 then 1.2e0 else 7.5e-1 end as performance_ratio",
        "case when request_id % 13 = 0 then 95e0 else 10e0 + site_id/1e2 end as lat", "20e0 as lon",
        "cast(floor(request_id/4e0) as bigint) as compare_id")
    return shaping.validate_requests(r, "compare_id").select("request_id", "error")


@query("unmask_default", views="sites", oracle="""
select site_id, greatest(nightlights, 0) + 0e0 as lights, coalesce(greatest(ndvi, 0), 0) + 0e0 as ndvi from sites""")
def unmask_default(spark, sf):
    return view(spark, sf, "sites").select("site_id", N.unmask(F.col("nightlights")).alias("lights"), N.unmask(F.col("ndvi")).alias("ndvi"))


@query("require_columns", views="sites", oracle="""
select cast(site_id as varchar) as pid, lat, lon, cast(null as varchar) as country_na, cast(null as double) as biome, worldcover from sites""")
def require_columns(spark, sf):
    sites = view(spark, sf, "sites").withColumn("pid", F.col("site_id"))
    return N.require_columns(sites, LABELLED_POINTS).select("pid", "lat", "lon", "country_na", "biome", "worldcover")


# ---------------------------------------------------------------- scalar functions

@query("great_circle", views="sites", oracle="""
select site_id, round(cos(radians(lat))*cos(radians(lon)), 9) as ux, round(cos(radians(lat))*sin(radians(lon)), 9) as uy, round(sin(radians(lat)), 9) as uz,
  round(2*6371.0088e0*asin(sqrt(pow(sin(radians(lat - 10)/2), 2) + cos(radians(10))*cos(radians(lat))*pow(sin(radians(lon - 80)/2), 2))), 6) as km,
  round(2*6371.0088e0*asin(sqrt(pow(cos(radians(lat))*cos(radians(lon)) - cos(radians(10))*cos(radians(80)), 2)
   + pow(cos(radians(lat))*sin(radians(lon)) - cos(radians(10))*sin(radians(80)), 2) + pow(sin(radians(lat)) - sin(radians(10)), 2))/2), 6) as chord_km
from sites""")
def great_circle(spark, sf):
    lat, lon, la0, lo0 = F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(80.0)
    d2 = sum(((a - b) * (a - b) for a, b in zip(G.unit_xyz(lat, lon), G.unit_xyz(la0, lo0))), F.lit(0.0))
    x, y, z = G.unit_xyz(lat, lon)
    return view(spark, sf, "sites").select("site_id", R(x).alias("ux"), R(y).alias("uy"), R(z).alias("uz"),
                                           R(G.haversine_km(la0, lo0, lat, lon), 6).alias("km"), R(G.chord_km(F.sqrt(d2)), 6).alias("chord_km"))


@query("destination", views="sites", oracle="""
with p as (select site_id, radians(lat) as la, lon, radians((site_id*37) % 360) as b, (5 + site_id % 95)/6371.0088e0 as d from sites),
q as (select *, sin(la)*cos(d) + cos(la)*sin(d)*cos(b) as s2 from p)
select site_id, round(degrees(asin(s2)), 9) as lat2, round(((lon + degrees(atan2(sin(b)*sin(d)*cos(la), cos(d) - sin(la)*s2)) + 540) % 360) - 180, 9) as lon2 from q""")
def destination(spark, sf):
    lat2, lon2 = G.destination(F.col("lat"), F.col("lon"), ((F.col("site_id") * 37) % 360).cast("double"), (F.lit(5) + F.col("site_id") % 95).cast("double"))
    return view(spark, sf, "sites").select("site_id", R(lat2).alias("lat2"), R(lon2).alias("lon2"))


_N = G._krueger()[0]
_E = 2 * _N ** 0.5 / (1 + _N)


@query("project_metric", views="sites", oracle="""
with k as (select 6378137.0e0/(1+n)*(1+n*n/4+n*n*n*n/64) as a, n, n/2-2*n*n/3+5*n*n*n/16+41*n*n*n*n/180 as a1,
  13*n*n/48-3*n*n*n/5+557*n*n*n*n/1440 as a2, 61*n*n*n/240-103*n*n*n*n/140 as a3, 49561*n*n*n*n/161280 as a4, 2*sqrt(n)/(1+n) as e
  from (select (1/298.257223563e0)/(2-1/298.257223563e0) as n)),
s as (select site_id, lat, lon, sinh(atanh(sin(radians(lat))) - e*atanh(e*sin(radians(lat)))) as t, radians(lon-81) as d, k.* from sites, k),
u as (select *, atan2(t, cos(d)) as xi, asinh(sin(d)/sqrt(t*t+cos(d)*cos(d))) as eta from s)
select site_id,
 round(500000 + 0.9996e0*a*(eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta) + a4*cos(8*xi)*sinh(8*eta)), 4) as x,
 round(0.9996e0*a*(xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta) + a4*sin(8*xi)*cosh(8*eta)), 4) as y,
 round(lat, 6) as lat, round(lon, 6) as lon from u""")
def project_metric(spark, sf):
    x, y = G.project_metric(F.col("lat"), F.col("lon"))
    xy = view(spark, sf, "sites").select("site_id", x.alias("x"), y.alias("y"))
    lat, lon = G.unproject_metric(F.col("x"), F.col("y"))
    return xy.select("site_id", R("x", 4).alias("x"), R("y", 4).alias("y"), R(lat + 0.0, 6).alias("lat"), R(lon, 6).alias("lon"))


@query("web_mercator", views="sites", oracle="""
select site_id, round(6378137e0*radians(lon), 4) as mx, round(6378137e0*ln(tan(pi()/4 + radians(lat)/2)), 4) + 0e0 as my, round(lat, 9) as lat from sites""")
def web_mercator(spark, sf):
    y = G.merc_y(F.col("lat"))
    return view(spark, sf, "sites").select("site_id", R(G.merc_x(F.col("lon")), 4).alias("mx"), (R(y, 4) + 0.0).alias("my"),
                                           (R(G.inv_merc_y(y)) + 0.0).alias("lat"))


@query("spectral_index", views="obs", oracle="""
select obs_id, round((nir_dn-red_dn)/(nir_dn+red_dn), 9) as ndvi, round((swir_dn-nir_dn)/(swir_dn+nir_dn), 9) as ndbi,
 case when (nir_dn - red_dn) + (red_dn - nir_dn) <> 0 then 1e0 end as undefined from obs""")
def spectral_index(spark, sf):
    nir, red, swir = F.col("nir_dn"), F.col("red_dn"), F.col("swir_dn")
    return view(spark, sf, "obs").select(
        "obs_id", R(S.normalized_difference(nir, red)).alias("ndvi"), R(S.normalized_difference(swir, nir)).alias("ndbi"),
        S.normalized_difference(nir - red, red - nir).alias("undefined"))


@query("qa_mask", views="obs", oracle="""
select obs_id, (qa & 31) = 0 as landsat, (qa & 3) = 0 and (qa & 4) = 0 as state, (qa & 3) <= 1 as thermal, qa <= 1 as summary, clear_score >= 0.6e0 as score from obs""")
def qa_mask(spark, sf):
    qa = F.col("qa")
    return view(spark, sf, "obs").select("obs_id", S.landsat_clear(qa).alias("landsat"), S.state_clear(qa).alias("state"),
                                         S.thermal_clear(qa).alias("thermal"), S.summary_clear(qa).alias("summary"),
                                         S.score_clear(F.col("clear_score")).alias("score"))


@query("scale_factors", views="obs", oracle="""
select obs_id, round(red_dn*0.0000275e0 - 0.2e0, 9) as sr, round(thermal_dn*0.00341802e0 + 149 - 273.15e0, 9) as lst, round(red_dn/10000, 9) as s2,
 round(thermal_dn*0.02e0 - 273.15e0, 9) as modis, round(thermal_dn*1e4/3.6e6/30.4375e0, 9) as ghi, round(red_dn*100, 6) as pop from obs""")
def scale_factors(spark, sf):
    red, th = F.col("red_dn"), F.col("thermal_dn")
    return view(spark, sf, "obs").select("obs_id", R(S.landsat_reflectance(red)).alias("sr"), R(S.landsat_celsius(th)).alias("lst"),
                                         R(S.sentinel_reflectance(red)).alias("s2"), R(S.modis_celsius(th)).alias("modis"),
                                         R(S.daily_ghi(th * 1e4)).alias("ghi"), R(S.people_per_km2(red), 6).alias("pop"))


@query("membership", views="sites", oracle="""
select site_id, round(case when ghi is null then null else least(greatest((ghi-2.5e0)/4, 0), 1) end, 9) as ghi,
 round(case when slope is null then null else 1 - least(greatest(slope/10, 0), 1) end, 9) as slope,
 round(least(greatest(least((temperature+10)/20, (40-temperature)/15), 0), 1), 9) as temperature from sites""")
def membership(spark, sf):
    return view(spark, sf, "sites").select("site_id", R(FT.benefit(F.col("ghi"), 2.5, 6.5)).alias("ghi"),
                                           R(FT.cost(F.col("slope"), 0, 10)).alias("slope"),
                                           R(FT.trapezoid(F.col("temperature"), -10, 10, 25, 40)).alias("temperature"))


_CASE_IGBP = "case landcover " + " ".join(f"when {k} then {v}e0" for k, v in K.IGBP_SCORE.items()) + " when null then null else case when landcover is null then null else 0e0 end end"


@query("code_lookup", views="sites", oracle=f"""
select site_id, {_CASE_IGBP} as igbp, case worldcover {' '.join(f'when {k} then {v}e0' for k, v in K.WORLDCOVER_SCORE.items())} end as cover,
 case when landcover is null then null else 0e0 end as unknown from sites""")
def code_lookup(spark, sf):
    lc = F.col("landcover")
    return view(spark, sf, "sites").select("site_id", FT.code_lookup(lc, K.IGBP_SCORE).alias("igbp"),
                                           FT.code_lookup(F.col("worldcover"), K.WORLDCOVER_SCORE).alias("cover"),
                                           FT.code_lookup(lc + 100, K.IGBP_SCORE).alias("unknown"))


@query("encode_aspect", views="sites", oracle="""
select site_id, round(coalesce(-cos(radians(aspect))*(case when lat >= 0 then 1 else -1 end)*least(slope/10, 1), 0), 9) + 0e0 as equator,
 round(coalesce(sin(radians(aspect))*least(slope/10, 1), 0), 9) + 0e0 as east, round(coalesce(-cos(radians(aspect))*least(slope/10, 1), 0), 9) + 0e0 as south from sites""")
def encode_aspect(spark, sf):
    a, s = F.col("aspect"), F.col("slope")
    return view(spark, sf, "sites").select("site_id", (R(FT.aspect_equator(a, s, F.col("lat"))) + 0.0).alias("equator"),
                                           (R(FT.aspect_east(a, s)) + 0.0).alias("east"), (R(FT.aspect_south(a, s)) + 0.0).alias("south"))


@query("log_features", views="sites", oracle="""
select site_id, round(ln(1+greatest(accessibility,0)), 9) as log_access, round(ln(1+greatest(nightlights,0)), 9) as log_lights,
 round(case when ndvi is null then null else ln(1+greatest(ndvi,0)) end, 9) as log_ndvi from sites""")
def log_features(spark, sf):
    return view(spark, sf, "sites").select("site_id", R(FT.log_floor(F.col("accessibility"))).alias("log_access"),
                                           R(FT.log_floor(F.col("nightlights"))).alias("log_lights"), R(FT.log_floor(F.col("ndvi"))).alias("log_ndvi"))


@query("one_hot_landcover", views="sites", oracle=f"""
select site_id, {', '.join(f"cast(coalesce(landcover in ({','.join(map(str, v))}), false) as int) as {k}" for k, v in K.IGBP_GROUPS.items())},
 cast(worldcover = 60 as int) as lc_bare, cast(worldcover = 10 as int) as lc_tree from sites""")
def one_hot_landcover(spark, sf):
    return view(spark, sf, "sites").select(
        "site_id", *[FT.one_hot(F.col("landcover"), codes).alias(n) for n, codes in K.IGBP_GROUPS.items()],
        *[FT.one_hot(F.col("worldcover"), [code]).alias(n) for code, n in K.WORLDCOVER_DUMMIES.items() if n in ("lc_bare", "lc_tree")])


@query("exclusion", views="sites", oracle="""
with e as (select site_id, case landcover when 11 then 'permanent wetland' when 13 then 'urban / built-up land' when 15 then 'snow and ice' when 17 then 'water'
 else case when slope > 15 then 'slope above 15°' end end as reason from sites)
select site_id, reason, case reason when 'permanent wetland' then 'Excluded: wetland, protected and not suitable for ground-mounted solar.'
 when 'urban / built-up land' then 'Excluded: urban area, not suitable for ground-mounted solar.' when 'snow and ice' then 'Excluded: permanent snow or ice, not suitable for ground-mounted solar.'
 when 'water' then 'Excluded: water body, not suitable for ground-mounted solar.' when 'slope above 15°' then 'Excluded: terrain steeper than 15°, too steep for ground-mounted solar.' end as message from e""")
def exclusion(spark, sf):
    reason = FT.exclusion_reason(F.col("landcover"), F.col("slope"))
    return view(spark, sf, "sites").select("site_id", reason.alias("reason"), FT.exclusion_message(reason).alias("message"))


@query("temper", views="sites", oracle="""
with p as (select site_id, least(greatest(cloud_cover/99, 1e-6), 1-1e-6) as p from sites)
select site_id, round(100/(1+exp(-ln(p/(1-p))/2)), 8) as score from p""")
def temper(spark, sf):
    return view(spark, sf, "sites").select("site_id", R(FT.temper(F.col("cloud_cover") / 99), 8).alias("score"))


@query("score_class", views="sites", oracle="""
select site_id, case when cloud_cover >= 70 then 'High' when cloud_cover >= 40 then 'Medium' else 'Low' end as class from sites""")
def score_class(spark, sf):
    return view(spark, sf, "sites").select("site_id", FT.score_class(F.col("cloud_cover")).alias("class"))


@query("energy_estimate", views="requests sites", oracle="""
with e as (select request_id, ghi, area_m2, area_m2*ghi*365*0.2e0*0.75e0 as kwh from requests join sites using (site_id))
select request_id, round(kwh, 7) as annual_kwh, round(kwh/1000, 10) as annual_mwh, round(area_m2*0.2e0, 6) as peak_kwp, round(kwh/(area_m2*0.2e0), 6) as specific_yield,
 round(kwh*0.475e0/1000, 11) as co2_tonnes, round(kwh/3500, 8) as households, round(area_m2/4046.8564224e0, 9) as area_acres,
 round(area_m2*ghi*28.25e0*0.15e0, 8) as feb_kwh from e""")
def energy_estimate(spark, sf):
    joined = view(spark, sf, "requests").join(view(spark, sf, "sites").select("site_id", "ghi"), "site_id")
    e = FT.energy(F.col("ghi"), F.col("area_m2"))
    months = FT.monthly_energy(F.array(*[F.col("ghi")] * 12), F.col("area_m2"))
    digits = {"annual_kwh": 7, "annual_mwh": 10, "area_acres": 9, "co2_tonnes": 11, "households": 8}
    return joined.select("request_id", *[R(c, digits.get(n, 6)).alias(n) for n, c in e.items()], R(months[1], 8).alias("feb_kwh"))


@query("landcover_names", views="sites", oracle=f"""
select site_id, case landcover {' '.join(f"when {k} then '{v}'" for k, v in K.IGBP_NAMES.items())} end as igbp,
 case worldcover {' '.join(f"when {k} then '{v}'" for k, v in K.WORLDCOVER_NAMES.items())} end as cover from sites""")
def landcover_names(spark, sf):
    return view(spark, sf, "sites").select("site_id", FT.landcover_name(F.col("landcover"), K.IGBP_NAMES).alias("igbp"),
                                           FT.landcover_name(F.col("worldcover"), K.WORLDCOVER_NAMES).alias("cover"))
