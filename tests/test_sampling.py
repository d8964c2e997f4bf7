"""Rejection sampling to exact counts, hard negatives, regions: against brute force on small places."""
import math

import pytest
from pyspark.sql import functions as F

from helioscape.operators import polygons, sampling
from helioscape.operators.spark_support import stored

EARTH = 6371.0088


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH * math.asin(min(1.0, math.sqrt(h)))


def square(spark, *squares):
    rows = []
    for poly, region, x, y, w in squares:
        pts = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        rows += [(poly, region, 0, "outer", *map(float, (*a, *b))) for a, b in zip(pts, [*pts[1:], pts[0]], strict=True)]
    return spark.createDataFrame(rows, "poly long, region string, ring int, role string, x1 double, y1 double, x2 double, y2 double")


def plants_of(spark, rows):
    return spark.createDataFrame(rows, "plant_id long, plat double, plon double, area_m2 double")


@pytest.mark.parametrize("wanted", [1, 7, 150])
def test_first_accepted_draws_whatever_the_rounds(spark, wanted):
    keep = lambda df: df.where("draw * 7919 % 1000 < 31")
    got = sorted(r.draw for r in sampling.sample_exact(spark, lambda ids: ids, keep, wanted).collect())
    assert got == [i for i in range(20_000) if i * 7919 % 1000 < 31][:wanted]


def test_nothing_wanted_and_nothing_to_find(spark):
    assert sampling.sample_exact(spark, lambda ids: ids, lambda df: df, 0).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_exact(spark, lambda ids: ids, lambda df: df.where("draw < 3"), 5, most=100)


def test_nth_smallest_of_scattered_ids(spark):
    ids = sorted({i * i % 100_003 for i in range(3_000)})
    df = spark.createDataFrame([(i,) for i in ids], "draw long")
    for n in (1, 2, 999, len(ids)):
        assert sampling._nth_smallest(df, "draw", n, 100_003, buckets=16) == ids[n - 1]


def test_background_is_on_land_and_far_from_plants(spark):
    """Both conditions reject draws; the sample equals what Python leaves of the same draws."""
    land = stored(polygons.polygon_cells(square(spark, (1, "a", 2, 2, 4)), 0.5), "land")
    plants = [(1, 3.0, 3.0, math.pi * 90e3 ** 2), (2, 5.5, 5.5, math.pi * 20e3 ** 2)]
    draw = lambda ids: sampling.background_candidates(ids, "draw", 0, 8, 0, 8)
    keep = lambda df: sampling.accept(df, "draw", land, 0.5, plants_of(spark, plants))
    got = {r.draw for r in sampling.sample_exact(spark, draw, keep, 60).collect()}
    on_land, ok = [], []
    for r in draw(spark.range(1_000).withColumnRenamed("id", "draw")).orderBy("draw").collect():
        if 2 < r.lat < 6 and 2 < r.lon < 6:
            on_land.append(r.draw)
            d, radius = min((km(r.lat, r.lon, y, x), math.sqrt(a / math.pi) / 1000) for _, y, x, a in plants)
            if d > 1 + radius:
                ok.append(r.draw)
    assert got == set(ok[:60]) and len(ok) < len(on_land) < 400


def test_hard_negatives_surround_positives(spark):
    rows = [(10, 1.0, 1.0), (20, 40.0, 179.9), (30, -60.0, -100.0)]
    placed, count = sampling.numbered(spark.createDataFrame(rows, "plant_id long, lat double, lon double"), "plant_id")
    assert count == 3 and {r.plant_id: r.pos for r in placed.collect()} == {10: 1, 20: 2, 30: 3}
    got = sampling.sample_exact(spark, lambda ids: sampling.hard_draws(ids, "draw", placed, count), lambda df: df, 90).collect()
    near = [min((km(r.lat, r.lon, a, b), i) for i, a, b in rows) for r in got]
    assert sorted(r.draw for r in got) == list(range(90)) and all(4.99 < d < 100.01 for d, _ in near)
    assert {i for _, i in near} == {10, 20, 30}


def test_regions_inside_beside_and_unknown(spark):
    borders = square(spark, (1, "west", 0, 0, 4), (2, "east", 10, 0, 4), (3, "west", 1, 1, 1))
    points = spark.createDataFrame([(1, 2.5, 2.5), (2, 1.5, 1.5), (3, 2.0, 9.0), (4, 2.0, 5.0), (5, None, 3.0), (6, 60.0, -170.0)], "pid long, lat double, lon double")
    got = {r.pid: (r.poly, r.region) for r in sampling.assign_region(points, borders, 0.5, "pid").collect()}
    assert got == {1: (1, "west"), 2: (1, "west"), 3: (2, "east"), 4: (1, "west"), 5: (None, None), 6: (1, "west")}
    none = {r.pid: (r.poly, r.region) for r in sampling.assign_region(points, borders.where("false"), 0.5, "pid").collect()}
    assert set(none) == set(got) and set(none.values()) == {(None, None)}
    assert sampling.assign_region(points.where("false"), borders, 0.5, "pid").count() == 0


def test_positives_are_capped_by_the_region_they_lie_in(spark):
    borders = square(spark, (1, "west", 0, 0, 4), (2, "east", 10, 0, 4))
    plants = spark.createDataFrame([(i, 1.0 + i / 100, 1.0, 1e4 * (i + 1)) for i in range(12)] + [(50, 1.0, 11.0, 1e5), (60, 1.0, 9.5, 1e5)],
                                   "plant_id long, lat double, lon double, area_m2 double")
    got = sampling.select_positives(plants, borders, 0.5, most=5).groupBy("region").agg(F.count("*").alias("n")).collect()
    assert {r.region: r.n for r in got} == {"west": 5, "east": 2}
