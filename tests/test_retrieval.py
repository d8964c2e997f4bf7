"""Retrieval and search against plain Python on a small gazetteer."""
from pyspark.sql import functions as F

from helioscape.operators import retrieval as RT

PLACES = [
    (1, "Lord's Stadium", "London England", "stadium", "leisure", 51.53, -0.17), (2, "Lords Lane", "Leeds England", "residential", "highway", 53.8, -1.5),
    (3, "Green Park", "London England", "park", "leisure", 51.5, -0.14), (4, "Green Village", "Kent England", "village", "place", 51.2, 0.5),
    (5, "Badla Solar Park", "Rajasthan India", "plant", "power", 27.50, 71.95), (6, None, None, None, None, 0.0, 0.0),
    (7, "Saltash Old Bridge", "Cornwall England", "bridge", "man_made", 50.4, -4.2), (8, "Green Stadium", "Leeds", "stadium", "leisure", 53.7, -1.4)]
QUERIES = [(1, "lords stadum"), (2, "green park london"), (3, "51.5, -0.12"), (4, "bhadla"), (5, ""), (6, None), (7, "saltas bridg"), (8, "the of"), (9, "england"),
           (10, "green park london"), (11, "zzz")]
SCHEMA = "place_id long, name string, context string, osm_value string, category string, lat double, lon double"


def plain_retrieve(words, prefix=False):
    cut = lambda ws: {w[:4] for w in ws if len(w) >= 4} if prefix else set(ws)
    held = {p[0]: ((p[1] or "") + " " + (p[2] or "")).lower().replace("'", "").split() for p in PLACES}
    have = {i: cut(ws) for i, ws in held.items()}
    counts = {w: sum(w in h for h in have.values()) for w in cut(words)}
    known = [w for w in counts if counts[w]]
    if not known:
        return []
    rare = min(known, key=lambda w: (counts[w], w))
    found = [(-len(cut(words) & h), len(set(held[i])), i) for i, h in have.items() if rare in h]
    return [i for _, _, i in sorted(found)][:RT.ANSWERS]


def test_retrieval_by_hand(spark):
    places, queries = spark.createDataFrame(PLACES, SCHEMA), spark.createDataFrame(QUERIES, "query_id long, query string")
    stop = {"the", "of"}
    for prefix in (False, True):
        got = {}
        for r in RT.retrieve(queries, ["query_id"], "query", places, prefix=prefix).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["place_id"])
        for i, q in QUERIES:
            if i != 3:
                assert got.get(i, []) == plain_retrieve([w for w in (q or "").split() if w not in stop], prefix), (i, prefix)


def test_a_common_word_is_not_looked_up(spark):
    """Half of all places share a word; a query with a rarer one meets only that one's places."""
    places = spark.range(2000).selectExpr("id as place_id", "concat('park w', id) as name", "cast(null as string) as context")
    index = RT.index_places(places)
    assert index.where("block = 'park'").count() == 2000
    asked = spark.createDataFrame([(i, f"park w{i}") for i in range(300)], "query_id long, query string")
    found = RT.retrieve(asked, ["query_id"], "query", places)
    assert sorted(map(tuple, found.collect())) == [(i, 0, i) for i in range(300)]


def test_search(spark):
    found = RT.search(spark.createDataFrame(QUERIES, "query_id long, query string"), spark.createDataFrame(PLACES, SCHEMA))
    got = {}
    for r in found.orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r.asDict())
    assert got[1][0]["name"] == "Lord's Stadium" and got[1][0]["type"] == "stadium"  # corrected, then the possessive
    assert [r["name"] for r in got[2]] == [r["name"] for r in got[10]] and got[2][0]["name"] == "Green Park"
    assert got[3] == [{"query_id": 3, "position": 1, "source": "coordinates", "name": "51.50000, -0.12000", "display_name": "Coordinates", "lat": 51.5, "lon": -0.12,
                       "type": "coordinates", "category": "coordinates", "osm_value": None, "kind": "point", "zoom": 16}]
    assert [r["name"] for r in got[4]] == ["Bhadla Solar Park"] and got[4][0]["zoom"] == 15 and got[4][0]["display_name"].startswith("2,245 MW")
    assert got[7][0]["name"] == "Saltash Old Bridge"  # by the beginnings of its words
    village = next(r for r in got[9] if r["name"] == "Green Village")
    assert (village["kind"], village["zoom"]) == ("area", 14)
    assert not {5, 6, 8, 11} & set(got)
    assert all(len(v) <= 5 for v in got.values())


def test_without_places(spark):
    none = spark.createDataFrame([], SCHEMA)
    found = RT.search(spark.createDataFrame(QUERIES, "query_id long, query string"), none, fuzzy=False)
    assert sorted((r["query_id"], r["source"]) for r in found.collect()) == [(3, "coordinates"), (4, "curated")]


def test_growing_tables_are_not_broadcast(spark):
    """Joins of place search and lattices shuffle tables that grow with the input, though these look small to Spark."""
    from helioscape.operators import gazetteer as GZ, lattice as L

    cands = spark.createDataFrame([(1, "lake park", 0, "Lake", "park", "park", "place", 1.0, 2.0)],
                                  "query_id int, query string, rank int, name string, context string, osm_value string, category string, lat double, lon double")
    nodes = spark.createDataFrame([(r, c, 1.0, [1.0]) for r in range(2) for c in range(2)], "r int, c int, v double, m array<double>")
    points = spark.createDataFrame([(1, 0.5, 0.5)], "pid int, lat double, lon double")
    spread = L.bilinear(points, L.corner_cells(nodes, ["v", "m"]), ["v"], ["m"], 0.0, 1.0, 2, 0.0, 1.0, 2)
    for df in (GZ.rank_candidates(cands, fuzzy=False), GZ.rank_candidates(cands), spread):
        assert len(df.collect()) == 1
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_words_of_one_row_are_those_of_the_matcher(spark):
    import difflib

    from pyspark.sql import functions as F

    from helioscape.operators import gazetteer as GZ

    words = ["stadium", "stadum", "museum", "museam", "park", "parks", "lake", "aaaa", "aaab", "abcdefgh", "hgfedcba", "ünder", "under"]
    df = spark.createDataFrame([(1, words, words[::-1]), (1, ["lakes"], ["lake"]), (None, ["parks"], ["park"]), (2, [], ["park"])], "k int, a array<string>, b array<string>")
    pairs = {(x, y) for x in words for y in words if x != y and len(x) > 3 and difflib.SequenceMatcher(None, x, y).ratio() >= 0.84} | {("lakes", "lake")}
    got = GZ.with_fuzzy(df, ["k"], [(F.col("a"), F.col("b"))], "close").collect()
    assert sorted((r.k or 0, len(r.close)) for r in got) == [(0, 0), (1, len(pairs)), (1, len(pairs)), (2, 0)]
    assert set(next(r for r in got if r.k == 1).close) == {f"{x}|{y}" for x, y in pairs}
