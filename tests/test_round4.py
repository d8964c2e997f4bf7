"""Each fault found in the fourth round with its case."""
import difflib

import numpy as np
import pytest

from helioscape.functions import text as TX
from helioscape.llm import jaccard_join
from helioscape.operators import models as ML
from helioscape.operators.spark_support import shared_dir
from helioscape.plans import model_queries, text_queries


def test_boosted_model_runs_all_rounds(spark, sf, monkeypatch):
    """8 rounds of depth 4 were registered for 500 of depth 6."""
    fitted = []
    fit = ML.TreeModel.fit

    def short(self, *rest):
        fitted.append((self.kind, self.trees, self.depth))
        self.trees = 11  # the whole fit takes minutes
        return fit(self, *rest)

    monkeypatch.setattr(ML.TreeModel, "fit", short)
    row = model_queries.boosted_model(spark, sf).first()
    assert fitted == [("boosted", 500, 6)] and row["n"] > 0


def test_boosting_cuts_its_lineage(spark, monkeypatch):
    """Without a checkpoint folder 500 rounds were one lineage."""
    kind, folders = type(spark.sparkContext), []
    monkeypatch.setattr(kind, "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(kind, "setCheckpointDir", lambda self, folder: folders.append(folder))
    rows = spark.range(60).selectExpr("cast(id as double) as x", "cast(id % 2 as int) as y")
    model = ML.TreeModel("boosted", 11, 2).fit(rows, ["x"], "y")
    assert len(model.pipeline.stages[-1].trees) == 11 and folders == [shared_dir(spark)]


def fuzzy_score(query, name, context, value, category, rank, total):
    """Score of one candidate, word by word."""
    words = lambda s: [w for w in s.lower().replace("#", " ").split() if w not in TX.STOPWORDS]
    q, n, c = words(query), words(name), words(context)
    near = lambda w, pool: any(w == v or len(w) > 3 and difflib.SequenceMatcher(None, w, v).ratio() >= 0.84 for v in pool)
    named = lambda w: value in TX.CATEGORY_WORDS.get(w, [])
    hits = [2.0 if w in n else 1.6 if near(w, n) else 1.5 if named(w) else 1.0 if near(w, c) else 0.0 for w in q]
    score = sum(hits) / max(1, len(q)) - 0.45 * (value in TX.MINOR_TYPES or category in ("shop", "office")) - 0.5 * (category == "highway" and "street" not in q)
    score -= 0.08 * sum(not near(w, q) and w not in TX.CATEGORY_WORDS for w in n)
    covered = all(hits)
    return covered, round(score + 0.25 * (1 - rank / max(1, total)) + 0.3 * covered, 8)


def test_gazetteer_match_knows_misspelt_words(spark, tmp_path):
    """The fuzzy step was left out: a misspelt word counted like an unknown one, in names, contexts and queries."""
    names = ["lavender gainsboro", "lavendar gainsborro", "lavander misty", "orchid", "orchids chocolat"]
    rows = [(k, f"{names[k % 5]} {names[k * 3 % 5]}", "Brand#13", ["LAVENDER TIN", "PROMO ORCHYD", "BRANDS STEEL"][k % 3]) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    asked = {(r.query_id, r.rank): r for r in text_queries.provider_answers(spark, str(tmp_path)).collect()}
    total = {}
    for q, _ in asked:
        total[q] = total.get(q, 0) + 1
    found = text_queries.gazetteer_match(spark, str(tmp_path)).collect()
    expected = {k: fuzzy_score(r.query, r.name, r.context, r.osm_value, r.category, r.rank, total[r.query_id]) for k, r in asked.items()}
    first = {}  # of equal names and places the first stays
    for k, r in sorted(asked.items()):
        first.setdefault((r.query_id, r.name, r.lat, r.lon), k)
    assert {(r.query_id, r.rank) for r in found} == set(first.values())
    for r in found:
        assert (r.covered, r.score) == (expected[r.query_id, r.rank][0], pytest.approx(expected[r.query_id, r.rank][1], abs=2e-8))


def five_words(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("chunk", [1024, 7])
def test_no_link_between_different_sets_is_left_out(spark, monkeypatch, chunk):
    """Links inside a component were left out once it was known to be one."""
    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", chunk)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1:])) for k in range(60)]  # one word of each is another: most are similar
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(None, rows[2][1])]  # copies
    rows += [(200 + k, " ".join(f"v{k // 3}_{i}" for i in range(k % 3, 40 + k % 3))) for k in range(30)]  # threes that are shifted
    members, links = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    sets = {i: five_words(t) for i, t in rows if i is not None and not 100 <= i < 200}
    expected = sorted((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert len(expected) > 1000 and sorted(map(tuple, links.collect())) == expected
    assert {r.node for r in members.collect()} == set(sets)


def test_overlaps_of_common_and_rare_tokens(monkeypatch):
    draw = np.random.default_rng(3)
    sets = [np.unique(np.concatenate((draw.integers(0, 40, 25), draw.integers(0, 5000, 60)))) for _ in range(90)]
    expected = [[len(np.intersect1d(x, y)) for y in sets[50:]] for x in sets[:50]]
    assert np.array_equal(jaccard_join._overlaps(sets[:50], sets[50:]), expected)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 8)
    monkeypatch.setattr(jaccard_join, "COUNTED", 50)
    assert np.array_equal(jaccard_join._overlaps(sets[:50], sets[50:]), expected)
