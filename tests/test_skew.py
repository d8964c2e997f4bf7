"""Hot keys: the split paths give the exact result of a plain computation."""
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from helioscape.operators import ordered as OD
from helioscape.operators import metrics as M


def hot_rows(n=3000, seed=1):
    rnd = random.Random(seed)
    return [(0 if i % 3 == 0 else rnd.randrange(50), float(rnd.randrange(400)) / 8, i) for i in range(n)]


def test_median_of_hot_keys(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, x double, id int").withColumn("y", F.when(F.col("x") > 20, F.col("x") * 2))
    got = {r["k"]: (r["x"], r["y"]) for r in OD.grouped_median(df, ["k"], ["x", "y"]).collect()}
    for k in {r[0] for r in rows}:
        xs = [r[1] for r in rows if r[0] == k]
        ys = [2 * x for x in xs if x > 20]
        assert got[k] == (float(np.median(xs)), float(np.median(ys)) if ys else None)


def test_percentiles(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, x double, id int")
    got = {r["k"]: (r["a"], r["b"]) for r in OD.percentiles(df, ["k"], "x", [0.01, 0.73], ["a", "b"]).collect()}
    for k in {r[0] for r in rows}:
        np.testing.assert_allclose(got[k], np.quantile([r[1] for r in rows if r[0] == k], [0.01, 0.73]))


def test_boundaries_do_not_change_results(spark):
    rows = [(i % 2, float(i), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, one int")
    for points in ([], [3.0], [10.5, 50.0, 51.0, 150.0], [-5.0, 500.0]):
        out = OD.running_totals(df, ["k"], "x", ["one"], points).collect()
        assert sorted((r["k"], r["x"], r["one_before"], r["one_total"]) for r in out) == [(k, float(x), (x - k) // 2, 100) for k in (0, 1) for x in range(k, 200, 2)]


def test_ordinal_is_dense(spark):
    df = spark.range(0, 5000).withColumn("o", F.col("id") * 7 % 5003)
    out = OD.ordinal(df, [], "o").orderBy("o").select("ordinal").collect()
    assert [r[0] for r in out] == list(range(1, 5001))


def test_top_n_of_a_hot_key(spark):
    df = spark.createDataFrame(hot_rows(), "k int, x double, id int")
    got = sorted((r["k"], r["id"]) for r in OD.top_n(df, ["k"], ["x", "id"], 5, spread="id", salts=7).collect())
    want = []
    by = {}
    for k, x, i in hot_rows():
        by.setdefault(k, []).append((x, i))
    for k, v in by.items():
        want += [(k, i) for _, i in sorted(v)[:5]]
    assert got == sorted(want)


def test_auc_by_brute_force_and_one_class(spark):
    rnd = random.Random(3)
    rows = [("a" if i % 3 else "b", rnd.random() < 0.4, rnd.randrange(30) / 30) for i in range(600)] + [("c", True, 0.5), ("c", True, 0.1)]
    df = spark.createDataFrame([(r, int(y), p) for r, y, p in rows], "region string, label int, p double")
    got = {r["region"]: r["auc"] for r in M.roc_auc(df, "label", "p", ["region"]).collect()}
    for region in "ab":
        pos = [p for r, y, p in rows if r == region and y]
        neg = [p for r, y, p in rows if r == region and not y]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[region] - want) < 1e-12
    assert got["c"] is None


def test_balanced_weights_have_mean_one_and_a_cap(spark):
    rows = [("A", 1)] * 300 + [("A", 0)] * 500 + [(None, 1)] * 2 + [("B", 0)] * 100
    df = spark.createDataFrame([(i, r, y) for i, (r, y) in enumerate(rows)], "id int, region string, label int")
    w = [r["weight"] for r in M.balanced_weights(df, "region", "label").collect()]
    raw = np.array([len(rows) / 4 / {("A", 1): 300, ("A", 0): 500, (None, 1): 2, ("B", 0): 100}[k] for k in rows])
    capped = np.minimum(raw, np.median(raw) * 10)
    np.testing.assert_allclose(sorted(w), sorted(capped * len(capped) / capped.sum()))
    assert abs(np.mean(w) - 1) < 1e-9


def test_median_runs_equal_brute_force_at_any_batch_size():
    import pyarrow as pa
    rng = random.Random(3)
    keys = sorted([rng.choice([None, 1, 2, 3, 4, 5, 6]) for _ in range(500)], key=lambda k: (k is not None, k or 0))
    xs = [rng.choice([None, 0.5, 1.0, 2.5, 7.0]) for _ in keys]
    rows = pa.table({"k": pa.array(keys, pa.int64()), "x": pa.array(xs, pa.float64())})
    for size, most in ((1, 1000), (7, 1000), (64, 20), (500, 1000), (3, 1)):
        out = list(OD._median_runs(1, most)(iter(rows.to_batches(max_chunksize=size))))
        got = pa.Table.from_batches(out).to_pylist()
        raw = [(r["k"], r["x"]) for r in got if not r["_whole"]]
        whole = {r["k"]: r["x"] for r in got if r["_whole"]}
        assert not whole.keys() & {k for k, _ in raw} and None not in whole and 6 not in whole
        assert len(whole) == sum(r["_whole"] for r in got)
        for key in {None, 1, 2, 3, 4, 5, 6}:
            mine = [x for k, x in zip(keys, xs) if k == key]
            if key in whole:
                assert whole[key] == statistics.median([x for x in mine if x is not None])
            else:
                assert sorted(map(str, mine)) == sorted(str(x) for k, x in raw if k == key)


def test_median_of_many_keys_a_hot_key_and_none(spark):
    rows = [(i % 97 if i % 3 else None, float(i * 37 % 1001), float("nan") if i % 5 else 1.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(6)
    got = {r["k"]: (r["x"], r["y"]) for r in OD.grouped_median(df, ["k"], ["x", "y"]).collect()}
    assert len(got) == 98
    for key, (x, y) in got.items():
        assert x == statistics.median([r[1] for r in rows if r[0] == key])
        assert y == (1.0 if any(r[0] == key and r[2] == 1.0 for r in rows) else None)
    assert OD.grouped_median(df.where("x < 0"), ["k"], ["x", "y"]).count() == 0
