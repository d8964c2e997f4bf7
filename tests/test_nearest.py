"""The packed tree: bounded leaves whatever the layout of the targets, and the exact nearest target."""
import math
import random

import pytest
from pyspark.sql import functions as F

from helioscape.operators import nearest as NN


def layouts():
    draw = random.Random(4)
    ring = [(1000 * math.cos(i), 1000 * math.sin(i)) for i in range(900)]
    clump = [(5e5 + draw.random() * 1e-3, 5e5 + draw.random() * 1e-3) for _ in range(900)] + [(0.0, 0.0), (1e6, 1e6)]
    line = [(float(i), 0.0) for i in range(700)]
    return {"ring": ring, "clump": clump, "line": line, "same": [(3.0, 4.0)] * 500, "one": [(-7.0, 2.0)]}


@pytest.mark.parametrize("name", list(layouts()))
def test_nearest_and_bounds(spark, name):
    places = layouts()[name]
    draw = random.Random(9)
    span = max(abs(v) for p in places for v in p) * 1.5
    points = [(i, draw.uniform(-span, span), draw.uniform(-span, span)) for i in range(120)] + [(200 + i, *places[i * 7 % len(places)]) for i in range(40)]
    points += [(300, 0.0, 0.0), (300, 0.0, 0.0), (301, None, 1.0), (302, float("nan"), 1.0)]
    targets = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)] + [(-1, None, 0.0)], "tid int, x double, y double")
    df = spark.createDataFrame(points, "pid int, x double, y double").repartition(3)
    got = sorted(tuple(r) for r in NN.nearest(df, targets, ["x", "y"], "pid", ["tid"], digits=6).collect())
    want = []
    for pid, x, y in points:
        if x is not None and x == x:
            d, t = min((round(math.hypot(x - a, y - b) * 1e6), i) for i, (a, b) in enumerate(places))
            want.append((pid, t, d / 1e6))
    assert [(g[0], g[2]) for g in got] == [(w[0], pytest.approx(w[2], abs=2e-6)) for w in sorted(want)]
    assert sum(g[1] != w[1] for g, w in zip(got, sorted(want))) <= 2  # ties within the rounding
    low = min(v for p in places for v in p)
    tree = NN.PackedTree(targets.where("x is not null"), ["x", "y"], ["x", "y"], ["x", "y"], NN.LEAF, ([low, low], 3 * span))
    assert tree.targets.groupBy("_leaf").count().agg(F.max("count")).first()[0] <= NN.LEAF
    assert tree.nodes.groupBy("level", F.expr("shiftright(node, 4)")).count().agg(F.max("count")).first()[0] <= 1 << NN.FAN_BITS
    assert tree.nodes.where("level = 0").count() == tree.leaves <= len(places) / NN.LEAF + 8


def test_segments_with_one_midpoint(spark):
    star = [(i, math.cos(i) * 10, math.sin(i) * 10, -math.cos(i) * 10, -math.sin(i) * 10) for i in range(400)]
    segments = spark.createDataFrame(star, "sid int, x1 double, y1 double, x2 double, y2 double")
    points = [(i, 9.5 * math.cos(i + 0.001), 9.5 * math.sin(i + 0.001)) for i in range(0, 400, 9)] + [(999, 0.0, 0.0)]
    got = {r["pid"]: (r["sid"], r["distance"]) for r in NN.nearest_segment(spark.createDataFrame(points, "pid int, x double, y double"), segments, "pid", ["sid"]).collect()}
    for pid, x, y in points:
        best = min(round(abs(x * math.sin(i) - y * math.cos(i)), 6) for i in range(400))
        assert got[pid][1] == pytest.approx(best, abs=2e-6)
    assert got[999] == (0, 0.0)


def test_pairs_stay_few(spark):
    """A place meets a few leaves, however many targets there are."""
    targets = spark.range(40_000).selectExpr("id as tid", "id * 7919 % 200003 * 1D as x", "id * 104729 % 199999 * 1D as y")
    places = spark.range(500).selectExpr("id * 399 * 1D as x", "id * 17011 % 199999 * 1D as y")
    tree = NN.PackedTree(targets, ["x", "y"], ["x", "y"], ["x", "y"], NN.LEAF, ([0.0, 0.0], 200003.0))
    assert tree.candidates(places, 1e-6).count() < 12 * 500


def test_no_targets(spark):
    targets = spark.createDataFrame([], "tid int, x double, y double")
    assert NN.nearest(spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double"), targets, ["x", "y"], "pid", ["tid"]).count() == 0
