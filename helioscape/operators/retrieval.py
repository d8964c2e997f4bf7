"""Search over a table of places: an inverted index of their words, looked up by the rarest word of a query first.

A query meets only the places that hold its rarest known word, so words that half of all places share are not looked up
unless a query has no other. Queries with the same words are looked up once.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as TX
from . import gazetteer as GZ
from .ordered import top_n
from .spark_support import growing, stored

#: Answers of one lookup, and the letters that a word and a place's word must share when exact words are not enough.
ANSWERS, PREFIX = 10, 4
#: Best answers that are looked at to decide whether a query is answered.
LOOKED_AT = 3


def block_of(word: Column, prefix: bool) -> Column:
    """The index entry of a word: the word itself, or its first letters (words that are shorter have none)."""
    return F.when(F.length(word) >= PREFIX, F.substring(word, 1, PREFIX)) if prefix else word


def place_words(places: DataFrame) -> DataFrame:
    """(place_id, words): distinct words of a place's name and context."""
    return places.select("place_id", F.array_distinct(F.concat(TX.tokens(F.col("name")), TX.tokens(F.col("context")))).alias("words"))


def index_places(places: DataFrame, prefix: bool = False) -> DataFrame:
    """(block, place_id, words): one row per entry of a place."""
    words = place_words(places)
    blocks = F.array_distinct(F.transform("words", lambda w: block_of(w, prefix)))
    return words.select(F.explode(F.filter(blocks, lambda b: b.isNotNull())).alias("block"), "place_id", "words")


def retrieve(asked: DataFrame, keys: list[str], text: str, places: DataFrame, answers: int = ANSWERS, prefix: bool = False) -> DataFrame:
    """(*keys, rank, place_id): up to `answers` places for every row of `asked`, ranked from 0.

    Candidates hold the query's rarest word that any place holds (of equally rare ones the first by letters); with `prefix`
    words agree that share their first letters. More query words found come first, then places of fewer words, then the
    smaller place_id. Queries without a known word, null and empty queries get no answer.
    """
    index = index_places(places, prefix)
    blocks = F.transform(TX.tokens(F.col(text)), lambda w: block_of(w, prefix))
    known = asked.select(*keys, F.array_sort(F.array_distinct(F.filter(blocks, lambda b: b.isNotNull()))).alias("_blocks"))
    named = known.where(F.size("_blocks") > 0).withColumn("_set", F.array_join("_blocks", " "))
    sets = named.select("_set", "_blocks").distinct()
    counts = index.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    rare = sets.select("_set", F.explode("_blocks").alias("block")).join(growing(counts), "block").groupBy("_set").agg(
        F.min(F.struct("_n", "block")).alias("_rare"))
    chosen = sets.join(growing(rare), "_set").select("_set", "_blocks", F.col("_rare.block").alias("block"))
    met = chosen.join(growing(index), "block")
    has = F.array_distinct(F.transform("words", lambda w: block_of(w, prefix)))
    scored = met.select("_set", "place_id", (-F.size(F.array_intersect("_blocks", has))).alias("_missing"), F.size("words").alias("_size"))
    best = top_n(scored, ["_set"], ["_missing", "_size", "place_id"], answers, spread="place_id", rank="_rank")
    return named.select(*keys, "_set").join(growing(best), "_set").select(*keys, (F.col("_rank") - 1).alias("rank"), "place_id")


def _candidates(texts: DataFrame, places: DataFrame, stage: int, prefix: bool = False) -> DataFrame:
    """Answers to every text (query_id, number, text) of a query, in their order."""
    found = retrieve(texts, ["query_id", "number"], "text", places, prefix=prefix)
    return found.select("query_id", F.lit(stage).alias("stage"), "number", "rank", "place_id")


def _described(found: DataFrame, asked: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates of a query, numbered through all its lookups, with what ranking needs; a query has a few lookups."""
    order = W.partitionBy("query_id").orderBy("stage", "number", "rank")
    numbered = found.withColumn("rank", F.row_number().over(order) - 1).select("query_id", "rank", "place_id")
    return numbered.join(growing(places), "place_id").join(growing(asked.select("query_id", F.col("fixed").alias("query"))), "query_id")


def _unanswered(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """Queries none of whose best candidates covers all words."""
    top = top_n(ranked.withColumn("_s", -F.round("score", 9)), ["query_id"], ["_s", "rank"], LOOKED_AT, spread="rank", salts=1)
    return asked.join(growing(top.where("covered").select("query_id").distinct()), "query_id", "left_anti")


def variants(asked: DataFrame, numbers: list[int]) -> DataFrame:
    """(query_id, number, text): 0 the query itself, 1 without category words, 2 with the possessive restored."""
    forms = {0: F.col("fixed"), 1: TX.without_categories(F.col("fixed")), 2: TX.with_possessive(F.col("fixed"))}
    each = F.array(*[F.struct(F.lit(n).alias("number"), forms[n].alias("text")) for n in numbers])
    return asked.select("query_id", F.explode(each).alias("v")).select("query_id", "v.*").where("text is not null")


def search(queries: DataFrame, places: DataFrame, limit: int = 5, fuzzy: bool = True) -> DataFrame:
    """Best places per query: position, source, name, display_name, lat, lon, type, category, osm_value, kind, zoom.

    Typed coordinates answer alone. Otherwise category words are corrected and the places with the query's words ranked;
    a query that none of them covers is asked again in its variants, and if that fails by the beginnings of its words.
    Curated parks that the query names come first, and places that repeat one are left out. Null and empty queries
    have no answer.
    """
    point = TX.parse_coordinates(F.col("query"))
    # the parser is a large expression: it runs in one projection, whose rows are written
    parsed = stored(queries.select("query_id", "query", point["lat"].alias("lat"), point["lon"].alias("lon")), "search-parsed")
    numeric = parsed.where("lat is not null and lon is not null").select("query_id", "lat", "lon")
    text = lambda value: F.lit(value)
    typed = numeric.select("query_id", F.lit(1).alias("position"), text("coordinates").alias("source"), F.format_string("%.5f, %.5f", "lat", "lon").alias("name"),
                           text("Coordinates").alias("display_name"), "lat", "lon", text("coordinates").alias("type"), text("coordinates").alias("category"),
                           F.lit(None).cast("string").alias("osm_value"), text("point").alias("kind"), F.lit(16).alias("zoom"))
    free = parsed.where("(lat is null or lon is null) and query is not null").select("query_id", "query")
    asked = GZ.correct_queries(free).select("query_id", "query", "fixed") if fuzzy else free.withColumn("fixed", F.col("query"))

    # every lookup is written once; only queries that it leaves open are asked and ranked again
    open_, found, ranked = stored(asked, "search-asked"), None, None
    for stage, (numbers, prefix) in enumerate((([0], False), ([1, 2], False), ([0, 2], True))):
        new = _candidates(variants(open_, numbers), places, stage, prefix)
        found = stored(new if found is None else found.join(growing(open_.select("query_id")), "query_id", "left_semi").unionByName(new), "search-found")
        rows = stored(GZ.rank_candidates(stored(_described(found, open_, places), "search-rows"), fuzzy), "search-ranked")
        left = stored(_unanswered(open_, rows), "search-open")
        last = stage == 2
        done = rows if last else rows.join(growing(left.select("query_id")), "query_id", "left_anti")
        ranked = done if ranked is None else ranked.unionByName(done)
        open_ = left

    parks = GZ.match_parks(free, fuzzy)
    kept = GZ.drop_near_curated(ranked, parks)
    area = F.col("osm_value").isin(*TX.AREA_ZOOM) & F.col("category").isin("place", "boundary")
    none = F.lit(None).cast("double")
    kind = F.when(F.coalesce(area, F.lit(False)), "area").otherwise("point")
    rows = parks.select(
        "query_id", text("curated").alias("source"), "name", TX.park_size_text(F.col("capacity_mw"), F.col("place")).alias("display_name"), "lat", "lon",
        text("solar park").alias("type"), text("power").alias("category"), text("plant").alias("osm_value"), text("point").alias("kind"), F.lit(15).alias("zoom"),
        F.lit(0).alias("_tier"), F.lit(0.0).alias("_s"), F.col("park").alias("_i"))
    rows = rows.unionByName(kept.select(
        "query_id", text("gazetteer").alias("source"), "name", F.col("context").alias("display_name"), "lat", "lon",
        F.translate(F.coalesce("osm_value", text("place")), "_", " ").alias("type"), "category", "osm_value", kind.alias("kind"),
        TX.suggest_zoom(kind, F.col("osm_value"), none, none, none, none).alias("zoom"),
        F.lit(1).alias("_tier"), (-F.round("score", 9)).alias("_s"), F.col("rank").cast("int").alias("_i")))
    best = top_n(rows.withColumn("_spread", F.concat_ws("-", "_tier", "_i")), ["query_id"], ["_tier", "_s", "_i"], limit, spread="_spread", salts=1, rank="position")
    return typed.unionByName(best.select(typed.columns))
