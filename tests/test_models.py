"""Invariants of models, folds, samples, search and streams."""
import difflib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helioscape.operators import gazetteer as GZ
from helioscape.operators import models as ML
from helioscape.plans.views import view

Q = entry.queries()


def test_score_never_moves_the_wrong_way(spark, sf):
    rows = Q["monotone_model"](spark, sf).collect()
    assert len(rows) == 9 and all(r["violations"] == 0 and r["n"] > 0 for r in rows)


def test_contributions_add_up(spark, sf):
    for r in Q["explain_scores"](spark, sf).collect():
        assert abs(r["points_sum"] - (r["model_score"] - r["base_score"])) < 1e-4 or abs(r["points_sum"]) < 1e-9


def test_out_of_fold_covers_each_site_once(spark, sf):
    rows = Q["oof_predictions"](spark, sf).collect()
    ids = [r["site_id"] for r in rows]
    assert len(ids) == len(set(ids)) == view(spark, sf, "sites").count()
    assert all(0 <= r["p"] <= 1 for r in rows)


def test_groups_never_split(spark, sf):
    from helioscape.operators import sampling as SM
    s = SM.with_blocks(view(spark, sf, "sites"))
    for df in (SM.group_folds(s, "group_id"), SM.stratified_fold(s, "group_id", "label")):
        assert df.groupBy("group_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_bundle_round_trips(spark, sf, tmp_path):
    row = Q["model_bundle"](spark, sf).first()
    assert row["n"] > 0 and row["max_difference"] == 0.0
    model = ML.MonotoneModel()
    model.features, model.medians, model.ramps = ["x"], {"x": 0.5}, [("x", 0.0, 1.0)]
    model.coefficients, model.intercept, model.means = [2.0], -1.0, [0.4]
    ML.save_bundle(spark, str(tmp_path / "m"), model, {"name": "additive"})
    loaded, meta = ML.load_bundle(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(0.2,), (None,)], "x double")
    assert [r["p"] for r in loaded.predict(df).collect()] == [r["p"] for r in model.predict(df).collect()]
    assert meta["name"] == "additive"


def test_sampled_negatives_keep_their_distance(spark, sf):
    assert Q["sample_background"](spark, sf).count() > 0
    near = Q["far_from_plants"](spark, sf)
    assert near.count() <= view(spark, sf, "sites").count()


@pytest.mark.parametrize("query,park", [("bhadla", "Bhadla Solar Park"), ("badhla solar", "Bhadla Solar Park"), ("ben", "Benban Solar Park"),
                                        ("shakti sthala plant", "Pavagada Solar Park"), ("solar star", "Solar Star"), ("berlin", None), ("solar park", None)])
def test_parks(spark, query, park):
    got = [r["name"] for r in GZ.match_parks(spark.createDataFrame([(1, query)], "query_id int, query string")).collect()]
    assert got == ([park] if park else [])


def test_similar_words_are_those_of_the_matcher(spark):
    words = ["stadium", "stadum", "museum", "museam", "park", "parks", "lake", "lakes", "bridge", "fridge", "abc", "abcd"]
    pairs = [(a, b) for a in words for b in words]
    got = {(r["a"], r["b"]) for r in GZ.similar_words(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {(a, b) for a, b in pairs if a != b and len(a) > 3 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.84}


def test_corrections(spark):
    df = spark.createDataFrame([(1, "Wembly stadum"), (2, "zoo at lake"), (3, "xyzzy")], "query_id int, query string")
    assert {r["query_id"]: r["fixed"] for r in GZ.correct_queries(df).collect()} == {1: "Wembly stadium", 2: "zoo at lake", 3: "xyzzy"}


def test_answers_once_per_day(spark, sf):
    got = Q["stream_dedupe"](spark, sf).toPandas().sort_values(["key", "ts", "request_id"])
    assert len(got) == view(spark, sf, "requests").count()
    for _, rows in got.groupby("key"):
        anchor = None
        for t, hit in zip(rows["ts"], rows["cache_hit"]):
            fresh = anchor is None or t >= anchor + pd.Timedelta(hours=24)
            assert hit == (not fresh)
            anchor = t if fresh else anchor


def test_sanity_table_reports_every_place(spark, sf):
    rows = Q["sanity_table"](spark, sf).collect()
    assert len(rows) == 12 and all(r["feature_km"] >= 0 and 0 <= r["final_excluded"] <= 100 for r in rows)


def test_predictions_are_complete(spark, sf):
    rows = Q["predict_batch"](spark, sf).collect()
    assert rows and all(r["n_contributions"] == 20 for r in rows)
    assert all(r["score"] == 0.0 for r in rows if r["excluded"])
    assert {r["source"] for r in rows} <= {"cached", "live", "grid_estimate"}
    assert all(r["cell_km"] <= 60 for r in rows if r["source"] == "grid_estimate")


def test_ramp_colours_decode_to_their_values(spark, sf):
    """Eight-bit colours lose a little: the decoded value stays within a few steps of the clipped original."""
    rows = Q["decode_ramp"](spark, sf).collect()
    assert rows and all((r["z"] is None) == (r["value"] is None) for r in rows)
    assert max(abs(min(max(r["z"], 900.0), 2100.0) - r["value"]) for r in rows if r["z"] is not None) < 15.0


def test_training_rows_are_spread_by_their_unpacked_size(spark):
    """The rows that one task of a fit holds stay bounded however many there are; few rows stay as they lie."""
    from helioscape.operators import models as ML

    rows = spark.range(4000).coalesce(1).selectExpr("id", "id % 7 as x")
    assert ML.spread(rows, 100).rdd.getNumPartitions() == 1
    wide = ML.spread(rows, 100, size=400_000)
    sizes = wide.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 8 and max(sizes) < 1000
    assert sorted(r.id for r in wide.collect()) == list(range(4000))
