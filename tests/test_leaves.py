"""Containment over cells that are split where an outline is dense."""
import math
import random

import numpy as np
from pyspark.sql import functions as F

from helioscape.operators import polygons as P

EDGES = "poly int, x1 double, y1 double, x2 double, y2 double"
POINTS = "pid int, lon double, lat double"


def inside(points, edges):
    e = np.array([r[1:] for r in edges])
    out = set()
    for pid, x, y in points:
        spans = (e[:, 1] > y) != (e[:, 3] > y)
        x1, y1, x2, y2 = e[spans].T
        hit = x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x
        out |= {(pid, p) for p, n in zip(*np.unique([edges[i][0] for i in np.flatnonzero(spans)[hit]], return_counts=True)) if n % 2}
    return out


def ring(poly, cx, cy, n, radius):
    pts = [(cx + radius(i) * math.cos(2 * math.pi * i / n), cy + radius(i) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [(poly, *pts[i], *pts[(i + 1) % n]) for i in range(n)]


def pairs(df):
    return {(r["pid"], r["poly"]) for r in df.collect()}


def test_a_dense_outline_leaves_few_edges_a_cell(spark):
    rnd = random.Random(4)
    edges = ring(1, 10, 10, 100_000, lambda i: 5 + math.sin(i / 900)) + ring(2, 11, 9, 7, lambda i: 3.0) + ring(1, 10, 10, 30, lambda i: 1.5)
    pts = [(i, rnd.uniform(3, 17), rnd.uniform(3, 17)) for i in range(400)]
    near = [(400 + i, edges[k][1] + rnd.uniform(-1e-3, 1e-3), edges[k][2] + rnd.uniform(-1e-3, 1e-3))
            for i, k in enumerate(rnd.randrange(len(edges)) for _ in range(100))]
    pts += near + [(500, None, 3.0)]
    leaves, levels = P.polygon_leaves(spark.createDataFrame(edges, EDGES), 20.0, most=64)
    most = leaves.groupBy("poly", "level", "cy", "cx").agg(F.count("x1").alias("n")).agg(F.max("n")).first()[0]
    assert 5 < levels < 16 and most <= 64 and leaves.count() < 2 * len(edges)
    got = pairs(P.polygons_at(spark.createDataFrame(pts, POINTS), leaves, levels, 20.0, "pid"))
    assert got == inside(pts[:-1], edges)


def test_edges_that_meet_in_one_spot_end_at_the_deepest_level(spark):
    edges = []
    for poly in range(40):  # slices of one polygon that all begin in the middle
        a, b = 2 * math.pi * poly / 40, 2 * math.pi * (poly + 0.5) / 40
        corner = [(0.3, 0.4), (0.3 + math.cos(a), 0.4 + math.sin(a)), (0.3 + math.cos(b), 0.4 + math.sin(b))]
        edges += [(7, *corner[i], *corner[(i + 1) % 3]) for i in range(3)]
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-1, 2), rnd.uniform(-1, 2)) for i in range(300)] + [(300 + i, 0.3 + rnd.uniform(-.01, .01), 0.4 + rnd.uniform(-.01, .01)) for i in range(100)]
    leaves, levels = P.polygon_leaves(spark.createDataFrame(edges, EDGES), 1.0, most=8, deepest=5)
    assert levels == 5
    assert pairs(P.polygons_at(spark.createDataFrame(pts, POINTS), leaves, levels, 1.0, "pid")) == inside(pts, edges)


def test_a_polygon_across_the_180th_meridian(spark):
    wrap = lambda x: x - 360 if x > 180 else x
    flat = ring(1, 179, 0, 50, lambda i: 6.0) + ring(2, 10, 0, 20, lambda i: 4.0)
    edges = [(p, wrap(x1), y1, wrap(x2), y2) for p, x1, y1, x2, y2 in flat]
    rnd = random.Random(6)
    pts = [(i, rnd.uniform(170, 190), rnd.uniform(-8, 8)) for i in range(300)] + [(300 + i, rnd.uniform(-5, 25), rnd.uniform(-5, 5)) for i in range(100)]
    given = spark.createDataFrame([(i, wrap(x), y) for i, x, y in pts], POINTS)
    assert pairs(P.polygons_around(given, spark.createDataFrame(edges, EDGES), 5.0, "pid", most=6)) == inside(pts, flat)


def test_no_polygons_and_no_points(spark):
    none, some = spark.createDataFrame([], EDGES), spark.createDataFrame(ring(1, 0, 0, 9, lambda i: 1.0), EDGES)
    points = spark.createDataFrame([(1, 0.0, 0.0)], POINTS)
    assert P.polygons_around(points, none, 1.0, "pid").count() == 0
    assert P.polygons_around(points.where("false"), some, 1.0, "pid").count() == 0
