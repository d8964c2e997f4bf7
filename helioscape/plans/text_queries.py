"""Place names, search and ranking of candidates."""
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import gazetteer as GZ, retrieval as RT
from ..operators.ordered import top_n
from ..operators.spark_support import growing
from .registry import query
from .shape_queries import R
from .views import table, view

RAW_NAME = "concat(case when place_id % 3 = 0 then 'The ' else '' end, upper(name), case when place_id % 4 = 0 then ' d''Été' else ' of Näh' end)"
NORM = "trim(regexp_replace(regexp_replace(translate(lower({x}), 'éä', 'ea'), '''', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("normalize_name", views="gazetteer", oracle=f"""
select place_id, {NORM.format(x=RAW_NAME)} as norm, array_to_string(list_filter(string_split({NORM.format(x=RAW_NAME)}, ' '), lambda t: t not in ('the','of','in','at','near','and','de','la','le') and t <> ''), '|') as toks from gazetteer""")
def normalize_name(spark, sf):
    raw = view(spark, sf, "gazetteer").selectExpr("place_id", "concat(case when place_id % 3 = 0 then 'The ' else '' end, upper(name), case when place_id % 4 = 0 then \" d'Été\" else ' of Näh' end) as raw")
    return raw.select("place_id", TX.normalize_name(F.col("raw")).alias("norm"), F.array_join(TX.tokens(F.col("raw")), "|").alias("toks"))


COORD_TEXT = """case when c_custkey % 5 = 0 then concat(c_custkey % 95, '.5 N ', c_custkey % 190, '.25 W') when c_custkey % 5 = 1 then concat('-', c_custkey % 80, '.125, ', c_custkey % 170)
 when c_custkey % 5 = 2 then concat(' ', c_custkey % 60, '° S; ', c_custkey % 100, '.5° e ') when c_custkey % 5 = 3 then concat('place ', c_custkey) else concat(c_custkey % 1000, '.1, 20') end"""


@query("parse_coordinates", oracle="""
with made as (select c_custkey, case c_custkey % 5 when 0 then c_custkey % 95 + 0.5e0 when 1 then -(c_custkey % 80 + 0.125e0) when 2 then -(c_custkey % 60) when 4 then c_custkey % 1000 + 0.1e0 end as lat,
 case c_custkey % 5 when 0 then -(c_custkey % 190 + 0.25e0) when 1 then c_custkey % 170 when 2 then c_custkey % 100 + 0.5e0 when 4 then 20e0 end as lon from customer)
select c_custkey, case when lat between -90 and 90 and lon between -180 and 180 then lat + 0e0 end as lat, case when lat between -90 and 90 and lon between -180 and 180 then lon + 0e0 end as lon from made""")
def parse_coordinates(spark, sf):
    t = table(spark, sf, "customer").selectExpr("c_custkey", f"{COORD_TEXT} as q")
    p = TX.parse_coordinates(F.col("q"))
    return t.select("c_custkey", (p["lat"] + 0.0).alias("lat"), (p["lon"] + 0.0).alias("lon"))


@query("suggest_zoom", views="gazetteer", oracle="""
with b as (select place_id, case when place_id % 2 = 0 then 'area' else 'point' end as kind, case place_id % 4 when 0 then 'city' when 2 then 'lagoon' end as t, case when place_id % 7 <> 0 then 10e0 end as s,
 10 + (place_id % 30)/2e2 as n, 70e0 as w, 70 + (place_id % 23)/1e3 as e from gazetteer),
x as (select *, greatest(abs(n-s), abs(e-w)*cos(radians((n+s)/2)))*111 as span from b)
select place_id, cast(case when kind = 'area' then case t when 'city' then 11 else 10 end when s is null then 17 when span > 8 then 13 when span > 3 then 14 when span > 1 then 15 else 17 end as int) as zoom from x""")
def suggest_zoom(spark, sf):
    b = view(spark, sf, "gazetteer").selectExpr(
        "place_id", "case when place_id % 2 = 0 then 'area' else 'point' end as kind", "case place_id % 4 when 0 then 'city' when 2 then 'lagoon' end as t",
        "case when place_id % 7 <> 0 then 10e0 end as s", "10 + (place_id % 30)/2e2 as n", "70e0 as w", "70 + (place_id % 23)/1e3 as e")
    return b.select("place_id", TX.suggest_zoom(*[F.col(c) for c in ("kind", "t", "s", "n", "w", "e")]).alias("zoom"))


@query("query_variants", views="gazetteer", oracle="""
with q as (select place_id, concat(name, case place_id % 3 when 0 then ' Solar park' when 1 then ' lords' else '' end) as q from gazetteer),
w as (select place_id, q, string_split(q, ' ') as t from q),
x as (select place_id, t, list_filter(t, lambda a: lower(a) not in ('solar','park')) as kept, list_transform(t, lambda a: case when lower(a) in ('solar','park') then a else regexp_replace(a, '^([A-Za-z]{3,})s$', '\\1''s') end) as poss from w)
select place_id, case when len(kept) <> len(t) and len(kept) > 0 then array_to_string(kept, ' ') end as no_category, case when poss <> t then array_to_string(poss, ' ') end as possessive from x""")
def query_variants(spark, sf):
    q = view(spark, sf, "gazetteer").selectExpr("place_id", "concat(name, case place_id % 3 when 0 then ' Solar park' when 1 then ' lords' else '' end) as q")
    return q.select("place_id", TX.without_categories(F.col("q")).alias("no_category"), TX.with_possessive(F.col("q")).alias("possessive"))


@query("format_place_size", views="sites", oracle="""
select site_id, concat(case when site_id % 9 = 0 then 'Multi-phase solar park' else concat(format('{:,}', site_id*37), ' MW solar park') end, ', ', region) as size,
 concat(printf('%.4f', abs(lat)), case when lat >= 0 then '° N, ' else '° S, ' end, printf('%.4f', abs(lon)), case when lon >= 0 then '° E' else '° W' end) as coord from sites""")
def format_place_size(spark, sf):
    cap = F.when(F.col("site_id") % 9 != 0, F.col("site_id") * 37)
    return view(spark, sf, "sites").select("site_id", TX.park_size_text(cap, F.col("region")).alias("size"),
                                                                TX.coordinate_text(F.col("lat"), F.col("lon")).alias("coord"))


# ---------------------------------------------------------------- search

QUERY_TEXT = """case place_id % 6 when 0 then concat('the ', name) when 1 then concat(name, ' ', lower(context)) when 2 then concat('solar ', substr(name, 1, length(name) - 1)) when 3 then 'bhadla solar park'
 when 4 then concat(place_id % 80, '.5, ', place_id % 170) else concat('near ', name, ' street') end"""


def queries(spark, sf):
    return view(spark, sf, "gazetteer").selectExpr("place_id as query_id", f"{QUERY_TEXT} as query")


def provider_answers(spark, sf):
    """Up to ten candidates per query in provider order, as a geocoder would return them."""
    g = view(spark, sf, "gazetteer").selectExpr(
        "place_id", "name", "concat(context, ' ', osm_value) as context", "case place_id % 5 when 0 then 'plant' when 1 then 'bus_stop' when 2 then 'stadium' else osm_value end as osm_value",
        "case place_id % 7 when 0 then 'highway' when 1 then 'shop' else 'place' end as category", "20 + (place_id % 17)*1e0 as lat", "65 + (place_id % 13)*1e0 as lon")
    asked = queries(spark, sf).select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("rank"))
    return asked.withColumn("place_id", F.col("query_id") + F.col("rank") * F.col("rank")).join(growing(g), "place_id").drop("place_id")


NORMQ = "trim(regexp_replace(regexp_replace(lower({x}), '''', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
TOKS = "list_filter(string_split(" + NORMQ + ", ' '), lambda t: t not in ('the','of','in','at','near','and','de','la','le') and t <> '')"
CANDS = f"""g as (select place_id, name, concat(context, ' ', osm_value) as context, case place_id % 5 when 0 then 'plant' when 1 then 'bus_stop' when 2 then 'stadium' else osm_value end as osm_value,
 case place_id % 7 when 0 then 'highway' when 1 then 'shop' else 'place' end as category, 20 + (place_id % 17)*1e0 as lat, 65 + (place_id % 13)*1e0 as lon from gazetteer),
q as (select place_id as query_id, {QUERY_TEXT} as query from gazetteer), c as (select query_id, query, rank, g.* from q, (select unnest(generate_series(0, 9)) as rank) r join g on g.place_id = query_id + rank*rank),
n as (select query_id, count(*) as total from c group by query_id),
d as (select * from (select *, row_number() over (partition by query_id, {NORMQ.format(x='name')}, lat, lon order by rank) as rn from c) t where rn = 1),
t as (select d.*, total, {TOKS.format(x='query')} as qt, {TOKS.format(x='name')} as nt, {TOKS.format(x='context')} as ct from d join n using (query_id)),
h as (select *, list_transform(qt, lambda w: case when list_contains(nt, w) then 2e0 when (w = 'solar' and osm_value = 'plant') or (w = 'park' and osm_value = 'plant') then 1.5e0 when list_contains(ct, w) then 1e0 else 0e0 end) as hits from t),
s as (select query_id, rank, name, lat, lon, osm_value, len(list_filter(hits, lambda x: x > 0)) = len(qt) as covered,
 coalesce(list_sum(hits), 0)/greatest(len(qt), 1) - (case when osm_value = 'bus_stop' or category = 'shop' then 0.45e0 else 0 end) - (case when category = 'highway' and not list_contains(qt, 'street') then 0.5e0 else 0 end)
 - 0.08e0*len(list_filter(nt, lambda w: not list_contains(qt, w))) + 0.25e0*(1 - rank*1e0/total) as base from h)"""


# Similar words as the matcher finds them: the longest common run of letters (the first in a, then in b), then the same on both sides of it.
SIMILAR = """pairs as (select distinct a, b from (select a, unnest(b) as b from (select unnest(qt) as a, list_concat(nt, ct) as b from t union all select unnest(nt), qt from t) w) p where length(a) > 3 and a <> b),
seg(a, b, x, y, n) as (select a, b, a, b, 0 from pairs union all
 select a, b, unnest([substr(x, 1, i - 1), substr(x, i + k)]), unnest([substr(y, 1, j - 1), substr(y, j + k)]), unnest([k, 0]) from (
  select *, strpos(y, substr(x, i, k)) as j from (select a, b, x, y, best // 100000 as k, 100000 - best % 100000 as i from (
   select *, list_max(flatten(list_transform(range(1, length(x) + 1), lambda i:
    list_transform(list_filter(range(1, length(x) - i + 2), lambda k: contains(y, substr(x, i, k))), lambda k: k*100000 + 100000 - i)))) as best
   from seg where x <> '' and y <> '') f where best is not null) g) r),
near as (select coalesce(list(concat(a, '|', b)), []) as alike from (select a, b from seg group by a, b having 2e0*sum(n)/(length(a) + length(b)) >= 0.84e0) s)"""
NEAR = "len(list_filter({pool}, lambda v: list_contains(alike, concat(w, '|', v)))) > 0"
FUZZY = f"""{SIMILAR},
hf as (select *, list_transform(qt, lambda w: case when list_contains(nt, w) then 2e0 when {NEAR.format(pool='nt')} then 1.6e0 when (w = 'solar' and osm_value = 'plant') or (w = 'park' and osm_value = 'plant') then 1.5e0
  when list_contains(ct, w) or {NEAR.format(pool='ct')} then 1e0 else 0e0 end) as hits from t, near),
sf as (select query_id, rank, len(list_filter(hits, lambda x: x > 0)) = len(qt) as covered,
 coalesce(list_sum(hits), 0)/greatest(len(qt), 1) - (case when osm_value = 'bus_stop' or category = 'shop' then 0.45e0 else 0 end) - (case when category = 'highway' and not list_contains(qt, 'street') then 0.5e0 else 0 end)
 - 0.08e0*len(list_filter(nt, lambda w: not list_contains(qt, w) and not {NEAR.format(pool='qt')})) + 0.25e0*(1 - rank*1e0/total) as base from hf)"""


@query("gazetteer_match", views="gazetteer", oracle=f"with recursive {CANDS}, {FUZZY} select query_id, rank, covered, round(base + case when covered then 0.3e0 else 0 end, 8) as score from sf")
def gazetteer_match(spark, sf):
    return GZ.rank_candidates(provider_answers(spark, sf)).select("query_id", F.col("rank").cast("bigint").alias("rank"), "covered", R("score", 8).alias("score"))


@query("gazetteer_match_fuzzy")
def gazetteer_match_fuzzy(spark, sf):
    return GZ.rank_candidates(provider_answers(spark, sf)).select("query_id", "rank", "covered", R("score", 8).alias("score"))


@query("provider_prior", views="gazetteer", oracle=f"with {CANDS} select query_id, rank, round(0.25e0*(1 - rank*1e0/total), 9) as prior from h")
def provider_prior(spark, sf):
    c = GZ.rank_candidates(provider_answers(spark, sf), fuzzy=False).select("query_id", "rank")
    n = provider_answers(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"))
    return c.join(growing(n), "query_id").select("query_id", F.col("rank").cast("bigint").alias("rank"), R(GZ.provider_prior(F.col("rank"), F.col("n"))).alias("prior"))


@query("dedupe_candidates", views="gazetteer", oracle=f"with {CANDS} select query_id, rank, name from d")
def dedupe_candidates(spark, sf):
    return GZ.rank_candidates(provider_answers(spark, sf), fuzzy=False).select("query_id", F.col("rank").cast("bigint").alias("rank"), "name")


@query("top_places", views="gazetteer", oracle=f"""
with {CANDS} select query_id, place, name from (select query_id, rank, name, cast(row_number() over (partition by query_id order by -round(base + case when covered then 0.3e0 else 0 end, 9), rank) as int) as place from s) t where place <= 5""")
def top_places(spark, sf):
    ranked = GZ.rank_candidates(provider_answers(spark, sf), fuzzy=False).withColumn("_s", -F.round("score", 9))
    return top_n(ranked, ["query_id"], ["_s", "rank"], 5, spread="rank", salts=4, rank="place").select("query_id", "place", "name")


@query("curated_match", views="gazetteer", oracle=f"""
with q as (select place_id as query_id, {QUERY_TEXT} as query from gazetteer) select query_id, 'Bhadla Solar Park' as name from q where list_contains(string_split(query, ' '), 'bhadla')""")
def curated_match(spark, sf):
    return GZ.match_parks(queries(spark, sf), fuzzy=False).select("query_id", "name")


@query("curated_match_fuzzy")
def curated_match_fuzzy(spark, sf):
    misspelt = queries(spark, sf).withColumn("query", F.regexp_replace("query", "bhadla", "bhadlla"))
    return GZ.match_parks(misspelt).select("query_id", "name", TX.park_size_text(F.col("capacity_mw"), F.col("place")).alias("display_name"))


@query("suppress_near_curated", views="gazetteer", oracle=f"""
with {CANDS}, m as (select query_id from q where list_contains(string_split(query, ' '), 'bhadla')), k as (select *, case when rank = 0 then 27.4e0 else lat end as la, case when rank = 0 then 71.9e0 else lon end as lo from d)
select query_id, rank from k where not (query_id in (select query_id from m) and abs(la - 27.4745e0) < 0.15e0 and abs(lo - 71.9726e0) < 0.15e0 and osm_value = 'plant')""")
def suppress_near_curated(spark, sf):
    ranked = GZ.rank_candidates(provider_answers(spark, sf), fuzzy=False).withColumns(
        {"lat": F.when(F.col("rank") == 0, F.lit(27.4)).otherwise(F.col("lat")), "lon": F.when(F.col("rank") == 0, F.lit(71.9)).otherwise(F.col("lon"))})
    return GZ.drop_near_curated(ranked, GZ.match_parks(queries(spark, sf), fuzzy=False)).select("query_id", F.col("rank").cast("bigint").alias("rank"))


@query("correct_words")
def correct_words(spark, sf):
    q = queries(spark, sf).withColumn("query", F.concat("query", F.lit(" stadum parck")))
    return GZ.correct_queries(q).select("query_id", "query", "fixed")


@query("similarity_ratio")
def similarity_ratio(spark, sf):
    """Ratio of each distinct brand-and-type word pair that could be similar."""
    words = table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("a")).distinct()
    pairs = words.withColumn("b", F.concat(F.substring("a", 1, 4), F.lit("s"))).unionByName(words.withColumn("b", F.concat("a", F.lit("x"))))
    return GZ.similar_words(pairs).select("a", "b", R("ratio").alias("ratio"))


@query("search_places", views="gazetteer", oracle=f"""
with {CANDS}, typed as (select query_id, 1 as position, 'coordinates' as source, printf('%.5f, %.5f', (query_id % 80) + 0.5e0, (query_id % 170)*1e0) as name from q where query_id % 6 = 4),
parks as (select query_id, 'curated' as source, 'Bhadla Solar Park' as name, 0 as tier, 0e0 as o, 0 as i from q where list_contains(string_split(query, ' '), 'bhadla')),
alls as (select * from parks union all select query_id, 'provider', name, 1, -round(base + case when covered then 0.3e0 else 0 end, 9), rank from s where query_id % 6 <> 4),
r as (select *, row_number() over (partition by query_id order by tier, o, i) as position from alls)
select query_id, cast(position as int) as position, source, name from typed union all select query_id, cast(position as int), source, name from r where position <= 5""")
def search_places(spark, sf):
    return GZ.search_places(queries(spark, sf), provider_answers(spark, sf), fuzzy=False).select("query_id", "position", "source", "name")


@query("search_places_fuzzy")
def search_places_fuzzy(spark, sf):
    return GZ.search_places(queries(spark, sf), provider_answers(spark, sf))


# ---------------------------------------------------------------- retrieval from the gazetteer itself

def places(spark, sf):
    return view(spark, sf, "gazetteer").selectExpr(
        "place_id", "name", "concat(context, ' ', osm_value) as context", "case place_id % 5 when 0 then 'plant' when 1 then 'bus_stop' when 2 then 'city' else osm_value end as osm_value",
        "case place_id % 7 when 0 then 'highway' when 1 then 'shop' else 'place' end as category", "20 + (place_id % 1700)/1e2 as lat", "65 + (place_id % 1300)/1e2 as lon")


WORDS = f"""p as (select place_id, list_distinct(list_concat({TOKS.format(x='name')}, {TOKS.format(x="concat(context, ' ', osm_value)")})) as words from gazetteer),
i as (select place_id, words, unnest(words) as word from p), n as (select word, count(*) as n from i group by word),
q as (select place_id as query_id, list_distinct({TOKS.format(x=QUERY_TEXT)}) as words from gazetteer where place_id % 6 <> 4),
r as (select query_id, arg_min(word, (n, word)) as word from (select query_id, unnest(words) as word from q) join n using (word) group by query_id),
m as (select query_id, i.place_id, len(list_intersect(q.words, i.words)) as hits, len(i.words) as size from r join q using (query_id) join i using (word)),
found as (select query_id, place_id, row_number() over (partition by query_id order by hits desc, size, place_id) - 1 as rank from m)"""


@query("retrieve_places", views="gazetteer", oracle=f"with {WORDS} select query_id, place_id, cast(rank as int) as rank from found where rank < 10")
def retrieve_places(spark, sf):
    asked = queries(spark, sf).where("query_id % 6 <> 4")
    return RT.retrieve(asked, ["query_id"], "query", places(spark, sf)).select("query_id", "place_id", "rank")


@query("search_gazetteer")
def search_gazetteer(spark, sf):
    """Whole composition: corrected query, variants, beginnings of words, curated parks, all result columns."""
    asked = queries(spark, sf).withColumn("query", F.when(F.col("query_id") % 12 == 5, F.concat("query", F.lit(" stadum"))).otherwise(F.col("query")))
    return RT.search(asked, places(spark, sf)).withColumns({"lat": R("lat", 6), "lon": R("lon", 6)})
