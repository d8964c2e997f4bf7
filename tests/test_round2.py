"""Faults of the first round: each with the case that showed it."""
import math

import pytest
from pyspark.sql import functions as F

from helioscape.functions import text as TX
from helioscape.operators import dissolve, lattice, metrics, ordered, polygons, sampling, spark_support, weighting
from helioscape.plans import catalogue, service_queries
from helioscape.plans.views import view
from helioscape.sources import payloads
from helioscape.streaming import requests


def edges_of(spark, rings):
    rows = []
    for poly, ring, role, pts in rings:
        rows += [(poly, ring, role, *map(float, (*a, *b))) for a, b in zip(pts, [*pts[1:], pts[0]], strict=True)]
    return spark.createDataFrame(rows, "poly long, ring int, role string, x1 double, y1 double, x2 double, y2 double")


def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


@pytest.mark.parametrize("files", [1, 2, 4])
def test_stream_keeps_every_request_whatever_the_batches(spark, sf, files):
    got = service_queries.stream_dedupe(spark, sf, files).toPandas().sort_values(["key", "ts", "request_id"])
    assert sorted(got["request_id"]) == sorted(r[0] for r in view(spark, sf, "requests").select("request_id").collect())
    anchors = {}
    for key, t, hit in zip(got["key"], got["ts"], got["cache_hit"], strict=True):
        fresh = key not in anchors or (t - anchors[key]).total_seconds() >= 24 * 3600
        assert hit == (not fresh)
        anchors[key] = t if fresh else anchors[key]


def test_requests_without_time_or_key(spark):
    rows = spark.createDataFrame([(1, None, None), (2, None, None), (3, "a", None), (4, "a", "2024-01-01 00:00:00"), (5, "a", "2024-01-01 23:59:59"),
                                  (6, "a", "2024-01-02 00:00:00"), (7, None, "2024-01-01 00:00:00"), (8, None, "2024-01-01 01:00:00")], "request_id long, key string, ts string")
    got = {r.request_id: r.cache_hit for r in requests.once_per_day(rows.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True}


def test_median_of_null_keys_nan_and_missing_values(spark):
    rows = [(None, float(i), None) for i in range(101)] + [("a", math.nan, 1.0), ("a", 3.0, None), ("b", None, None)]
    got = [tuple(r) for r in ordered.grouped_median(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], ["x", "y"]).collect()]
    assert sorted(got, key=repr) == sorted([(None, 50.0, None), ("a", 3.0, 1.0), ("b", None, None)], key=repr)


def test_thin_strips_get_all_their_points(spark):
    strip = [(0.0, 0.0), (5000.0, 5000.0), (5000.0 - 42.4, 5000.0 + 42.4), (-42.4, 42.4)]
    rings = [(1, 0, "outer", strip), (2, 0, "outer", box(0, 0, 600.0)), (2, 1, "inner", box(100, 100, 400.0)), (3, 0, "outer", box(0, 0, 5.0))]
    got = sampling.interior_points(edges_of(spark, rings), F.when(F.col("area") > 1e5, 8).otherwise(4).cast("int"), 10.0).collect()
    count = {p: sum(r.poly == p for r in got) for p in (1, 2, 3)}
    assert count == {1: 8, 2: 8, 3: 1}
    for r in got:
        assert r.margin >= 10 or r.poly == 3
        if r.poly == 2:
            assert not (100 < r.x < 500 and 100 < r.y < 500)


def test_area_with_holes_of_either_winding(spark):
    rings = [(1, 0, "outer", box(0, 0, 10)), (1, 1, "inner", box(2, 2, 4)), (2, 0, "outer", box(0, 0, 10)), (2, 1, "inner", box(2, 2, 4)[::-1])]
    assert {r.poly: r.area for r in polygons.ring_area(edges_of(spark, rings)).collect()} == {1: 84.0, 2: 84.0}
    got = {r.poly: (round(r.cx, 9), round(r.cy, 9)) for r in polygons.centroids(edges_of(spark, rings)).collect()}
    c = round((100 * 5 - 16 * 4) / 84, 9)
    assert got == {1: (c, c), 2: (c, c)}


def test_squares_on_one_line_do_not_touch(spark):
    sites = edges_of(spark, [(1, 0, "outer", box(10, 10, 10))]).drop("ring", "role")
    raw = edges_of(spark, [(5, 0, "outer", box(40, 10, 10)), (6, 0, "outer", box(20, 10, 10)), (7, 0, "outer", box(15, 12, 3)), (8, 0, "outer", box(0, 0, 99))]).drop("ring", "role")
    assert {(r.site, r.poly) for r in dissolve.intersecting_constituents(sites, raw, 50.0).collect()} == {(1, 6), (1, 7), (1, 8)}


def test_one_lattice_for_all_polygons(spark):
    low, high = [(0.1, 0.1), (10.1, 0.1), (10.1, 10.1)], [(0.1, 0.1), (10.1, 10.1), (0.1, 10.1)]
    cells = lattice.land_cells(edges_of(spark, [(1, 0, "outer", low), (2, 0, "outer", high), (3, 0, "outer", box(0.3, 0.3, 5))]), 0.5).collect()
    assert len({(r.lat, r.lon) for r in cells}) == len(cells) == len({r.pid for r in cells}) == 400
    assert all((r.lat + 56) % 0.5 == 0.25 and (r.lon + 180) % 0.5 == 0.25 for r in cells)
    order = sorted(cells, key=lambda r: (r.lat, r.lon))
    assert [r.pid for r in order] == [f"C05_{i:06d}" for i in range(400)] and {r.poly for r in cells} == {1, 2}


def test_relations_from_split_rings(spark):
    point = lambda p: {"lat": float(p[1]), "lon": float(p[0])}
    way = lambda role, *pts: {"type": "way", "role": role, "geometry": [point(p) for p in pts]}
    square = [way("outer", (0, 0), (10, 0)), way("outer", (0, 10), (10, 10), (10, 0)), way("outer", (0, 0), (0, 10)),
              way("inner", (2, 2), (4, 2), (4, 4), (2, 4), (2, 2)), way("outer", (20, 0), (30, 0), (30, 9))]
    ring = [point(p) for p in [*box(0, 0, 3), (0, 0)]]
    rows = [("relation", 1, None, square), ("way", 2, ring, None), ("way", 3, ring[:-1], None), ("node", 4, None, None)]
    latlon = "struct<lat:double,lon:double>"
    df = spark.createDataFrame(rows, f"type string, id long, geometry array<{latlon}>, members array<struct<type:string,role:string,geometry:array<{latlon}>>>")
    areas = {r.poly: r.area for r in polygons.ring_area(polygons.ring_edges(payloads.element_rings(df))).collect()}
    assert areas == {"relation/1": 96.0, "way/2": 9.0}


def test_ring_numbers_stay_apart(spark, tmp_path):
    square = lambda i: [[i, 0], [i + 0.5, 0], [i + 0.5, 1], [i, 0]]
    feature = {"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(i) for i in range(1001)], [square(2000)]]}}
    import json
    (tmp_path / "f.json").write_text(json.dumps(feature))
    rings = payloads.read_polygons(spark, str(tmp_path / "f.json"), "id")
    assert rings.select("ring").distinct().count() == rings.count() == 1002


def test_rows_with_null_labels_and_regions_stay(spark):
    rows = [("a", 1), ("a", 0), (None, 1), ("a", None), ("b", 0)]
    assert metrics.balanced_weights(spark.createDataFrame(rows, "region string, label int"), "region", "label").count() == 5
    scored = spark.createDataFrame([(None, 1, 0.9, True), (None, 0, 0.1, True), ("a", 1, 0.3, True), ("a", 0, 0.2, False)], "region string, label int, p double, is_test boolean")
    assert {r.region for r in metrics.by_region(scored, "label", "p").collect()} == {None, "a"}


def test_incomplete_experts_are_reported(spark):
    rows = [("x", "a", "b", 2.0), ("x", "a", "c", 4.0), ("x", "b", "c", 2.0), ("y", "a", "b", 3.0)]
    got = {r.expert: r.weights for r in weighting.expert_weights(spark.createDataFrame(rows, "expert string, a string, b string, ratio double"), "expert", ["a", "b", "c"]).collect()}
    assert got["y"] is None and abs(sum(got["x"]) - 1) < 1e-9


def test_no_plants_and_points_without_place(spark):
    points = spark.createDataFrame([(i, 10.0 + i, 20.0) for i in range(4)] + [(9, None, None)], "id int, lat double, lon double")
    none = spark.createDataFrame([], "plant_id int, plat double, plon double, area_m2 double")
    one = spark.createDataFrame([(1, 11.0, 20.0, 1e6)], "plant_id int, plat double, plon double, area_m2 double")
    assert sampling.far_from_plants(points, none, "id").count() == 5
    assert {r.id for r in sampling.far_from_plants(points, one, "id").collect()} == {0, 2, 3, 9}


def test_training_weights_are_balanced_over_the_rows_that_train(spark, sf):
    from helioscape.plans.model_queries import physical_training
    rows = physical_training(spark, sf).where("in_training").groupBy("region", "label").agg(F.sum("weight").alias("w")).collect()
    assert max(r.w for r in rows) < 1.001 * min(r.w for r in rows)


@pytest.mark.parametrize("text,place", [
    ("12.5, 30", (12.5, 30.0)), ("12.5N 30.25W", (12.5, -30.25)), (" 5° S; 100.5° e ", (-5.0, 100.5)), ("5°S,6°E", (-5.0, 6.0)), ("-5,6", (-5.0, 6.0)), ("5°6°", (5.0, 6.0)),
    ("1000.1, 20", None), ("91, 20", None), ("5", None), ("5, 6, 7", None), ("place 3", None), ("5., 6", None), ("5,", None), (None, None), ("", None)])
def test_coordinates(spark, text, place):
    df = spark.createDataFrame([(text,)], "q string")
    p = TX.parse_coordinates(F.col("q"))
    r = df.select(p["lat"].alias("lat"), p["lon"].alias("lon")).first()
    assert (r.lat, r.lon) == (place or (None, None))


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        spark_support.shared_dir(Session())


def test_registered_queries_have_rows(spark, sf):
    for name in ("top_contributions", "mean_abs_contribution", "importance_share", "top_features"):
        assert catalogue.QUERIES[name](spark, sf).take(1)
