"""Faults found in the third round, each with its case."""
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helioscape.llm import jaccard_join, quality, queries
from helioscape.operators import dissolve, models as ML
from helioscape.operators import service as SV
from helioscape.operators.dissolve import connected_components
from helioscape.operators.spark_support import cut


def fitted(value):
    model = ML.MonotoneModel()
    model.features, model.medians, model.ramps = ["x"], {"x": 0.0}, [("x", 0.0, 1.0)]
    model.coefficients, model.intercept, model.means = [value], 0.0, [0.0]
    return model


def test_models_registered_at_once(spark):
    """Appends to one folder removed each other's unfinished files."""
    rows = spark.createDataFrame([(1,)], "x long")

    def one(k):
        return ML.registered(spark, f"m{k}", rows, "race", lambda: fitted(float(k))).coefficients

    with ThreadPoolExecutor(max_workers=6) as pool:
        assert list(pool.map(one, range(6))) == [[float(k)] for k in range(6)]


def test_comparison_answers_are_made_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(lat):
        asked.add(1)
        return lat

    rows = [(c, i, None, float(c + i), 1.0, 100.0, 0.2, 0.75) for c in range(4) for i in range(3)]
    requests = spark.createDataFrame(rows, "compare_id long, index int, name string, lat double, lon double, area_m2 double, efficiency double, performance_ratio double")
    sites, summary = SV.compare_sites(requests, lambda good: good.select(
        "request_id", score("lat").alias("score"), F.lit("High").alias("class"), F.struct(F.col("lon").alias("annual_kwh")).alias("energy")))
    assert len(sites.collect()) == 12 and len(summary.collect()) == 4
    assert asked.value == 12


def test_star_round_deals_prefixes_out_twice_at_most(spark, capsys):
    """A round read them three times before, in one plan; such plans took the driver's memory."""
    bits = ", ".join(f"b{k} long" for k in range(jaccard_join.LANES))
    schema = f"node long, comp long, n long, take long, p0 array<long>, p1 array<long>, {bits}"
    nodes = spark.createDataFrame([(k, k, 2, 1, [5, 6], [5], *[0] * jaccard_join.LANES) for k in range(3)], schema)
    jaccard_join._star_pairs(nodes, 0, jaccard_join.Fraction(3, 4)).explain("simple")
    plan = capsys.readouterr().out
    plan = plan[plan.rindex("Initial Plan"):] if "Initial Plan" in plan else plan
    assert 0 < plan.count("posexplode") <= 2


@pytest.mark.parametrize("step", [jaccard_join._frequencies, jaccard_join._prefixes(jaccard_join.Fraction(3, 4), 1)])
def test_groups_give_memory_back(monkeypatch, step):
    calls = []
    monkeypatch.setattr(jaccard_join, "give_back", lambda: calls.append(1))
    step(pd.DataFrame([(0, 0, -1, *[b""] * 6)], columns=jaccard_join._ROW_NAMES))
    assert calls


def test_components_of_repeated_loops_and_chains(spark):
    pairs = [(1, 1), (2, 3), (3, 2), (2, 3), (4, 5), (5, 6), (7, 6), (8, 8)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 10)], "poly long")
    found = connected_components(nodes, spark.createDataFrame(pairs, "a long, b long"))
    assert dict(found.collect()) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 9}


def test_components_that_are_settled_take_no_round(spark, monkeypatch):
    """A round was spent before to see that nothing moves; 211 partitions of it took the driver's memory."""
    calls = []
    monkeypatch.setattr(dissolve, "cut", lambda df: calls.append(1) or cut(df))
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "poly long")
    stars = spark.createDataFrame([(1, 2), (3, 1), (3, 1), (5, 5), (7, 6)], "a long, b long")
    assert dict(connected_components(nodes, stars).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    assert len(calls) == 1
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 4), (None, 5), (5, None)], "a long, b long")
    assert dict(connected_components(nodes, chain).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 1}
    none = spark.createDataFrame([], "a long, b long")
    assert dict(connected_components(nodes, none).collect()) == {k: k for k in range(1, 8)}


def test_component_rounds_send_nothing_through_the_driver(spark, monkeypatch, capsys):
    """Every grouping of a round was broadcast before, four times a round."""
    monkeypatch.setattr(dissolve, "cut", lambda df: df.explain("simple") or cut(df))
    dissolve.smallest_reachable(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fits_give_the_drivers_memory_back(spark, monkeypatch):
    """The driver's Python kept what a fit took until the end of the pipeline."""
    calls = []
    monkeypatch.setattr(quality, "give_back", lambda: calls.append("quality"))
    monkeypatch.setattr(queries, "give_back", lambda: calls.append("secrets"), raising=False)
    docs = spark.createDataFrame([(k, f"word{k} good text here", k % 3) for k in range(12)], "doc_id long, text string, grade int")
    assert quality.fit_ratings(docs, "doc_id", "text", docs.select("doc_id", "grade"), "doc_id", "grade") is not None
    queries.secret_model(docs)
    assert calls == ["quality", "secrets"]
