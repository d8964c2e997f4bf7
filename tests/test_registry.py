"""Models are fitted once for given rows and loaded afterwards."""
import pytest

from helioscape.operators import models as ML
from helioscape.plans import catalogue, model_queries
from helioscape.plans.views import view


def test_scoring_loads_the_model_of_its_rows(spark, sf, monkeypatch):
    first = model_queries.physical_model(spark, sf)
    monkeypatch.setattr(ML.MonotoneModel, "fit", lambda *a, **k: pytest.fail("fitted again"))
    again = model_queries.physical_model(spark, sf)
    assert again.to_json() == first.to_json()
    scores = {r.site_id: r.score for r in catalogue.QUERIES["batch_score"](spark, sf).collect()}
    assert set(scores) == {r.site_id for r in view(spark, sf, "sites").collect()}


def test_key_follows_rows_not_their_order(spark):
    kind = "a long, b long"
    key = lambda *rows: ML.table_key(spark.createDataFrame(list(rows), kind))
    assert key((1, 2), (3, None)) == key((3, None), (1, 2))
    assert len({key((1, 2)), key((1, None)), key((None, 1)), key((1, 2), (1, 2)), key(), key((None, None))}) == 6
    assert ML.table_key(spark.createDataFrame([(1, 2)], "a long, c long")) != key((1, 2))


def test_other_rows_recipes_and_dead_fits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ML, "shared_dir", lambda s: str(tmp_path))
    monkeypatch.setattr(ML, "scratch_path", lambda s, label: f"{tmp_path}/{label}-{len(fits)}")
    fits = []

    def fit(weight):
        def run():
            fits.append(weight)
            model = ML.MonotoneModel()
            model.features, model.medians, model.ramps = ["x"], {"x": 0.5}, [("x", 0.0, 1.0)]
            model.coefficients, model.intercept, model.means = [weight], -1.0, [0.4]
            return model
        return run

    def dead():
        raise RuntimeError("lost")

    rows, more = spark.range(3), spark.range(4)
    with pytest.raises(RuntimeError):
        ML.registered(spark, "m", rows, "r1", dead)
    got = [ML.registered(spark, "m", df, recipe, fit(w)).coefficients[0]
           for w, (df, recipe) in enumerate([(rows, "r1"), (rows, "r1"), (more, "r1"), (rows, "r2"), (more, "r1")])]
    assert got == [0, 0, 2, 3, 2] and fits == [0, 2, 3]
