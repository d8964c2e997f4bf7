"""Published values: weights, overlay of known places, exclusions, energy and coordinates."""
import pytest
from pyspark.sql import functions as F

from helioscape.functions import constants as K
from helioscape.functions import features as FT
from helioscape.functions import text as TX
from helioscape.operators import overlay as O
from helioscape.operators import weighting as WT

# Measures of twelve known places and their overlay score.
PLACES = [
    ("Bhadla", 5.746135234832764, 0.5910575985908508, 16.0, 143.0, 0.13289999961853027, 27.20941734313965, 87.02, None),
    ("Atacama", 7.228329658508301, 4.62366247177124, 16.0, 350.0, 0.06350000202655792, 15.445490837097168, 78.67, None),
    ("Kamuthi", 5.39294958114624, 0.30616530776023865, 10.0, 51.0, 0.41964998841285706, 28.41921043395996, 81.93, None),
    ("Sahara", 6.657436847686768, 1.349837303161621, 16.0, 2230.0, 0.09000000357627869, 24.168169021606445, 85.03, None),
    ("Tonopah", 5.7834930419921875, 0.6214439868927002, 16.0, 256.0, 0.10554999858140945, 12.432090759277344, 84.17, None),
    ("Benban", 6.555191993713379, 0.4042472243309021, 16.0, 45.0, 0.09080000221729279, 26.04680633544922, 98.27, None),
    ("Tengger", 4.914793014526367, 4.067346572875977, 10.0, 13.0, 0.13654999434947968, 11.262494087219238, 75.56, None),
    ("Noor", 5.979672431945801, 0.9501784443855286, 16.0, 38.0, 0.08389999717473984, 18.06097984313965, 93.30, None),
    ("Berlin", 2.9974517822265625, 6.406342029571533, 13.0, 0.0, 0.2567000091075897, 10.419293403625488, 0.00, "urban / built-up land"),
    ("Amazon", 4.575774669647217, 1.1224372386932373, 2.0, 1544.0, 0.8650000095367432, 26.11768341064453, 43.66, None),
    ("Taiga", 2.9054877758026123, 3.3363471031188965, 8.0, 1115.0, 0.6643000245094299, -2.6369669437408447, 29.72, None),
    ("Greenland", 3.5785393714904785, 0.17118678987026215, 15.0, 17827.0, None, -25.118257522583008, 0.00, "snow and ice"),
]


def test_weights_of_published_judgements():
    g = WT.judged_weights(K.GLOBAL_CRITERIA, K.GLOBAL_JUDGEMENTS)
    assert {k: round(v, 4) for k, v in g["weights"].items()} == K.GLOBAL_WEIGHTS
    assert g["lambda_max"] == pytest.approx(6.0719431920937055, abs=1e-12)
    assert g["CI"] == pytest.approx(0.014388638418741096, abs=1e-12)
    assert g["CR"] == pytest.approx(0.011603740660275077, abs=1e-12)
    r = WT.judged_weights(K.REGIONAL_CRITERIA, K.REGIONAL_JUDGEMENTS)
    assert {k: round(v, 4) for k, v in r["weights"].items()} == K.REGIONAL_WEIGHTS
    assert r["CR"] == pytest.approx(0.016384049201742606, abs=1e-12)


def test_expert_job_equals_single_matrix(spark):
    rows = [(7, a, b, float(v)) for (a, b), v in K.GLOBAL_JUDGEMENTS.items()] + [(8, "GHI", "Slope", 2.0)]
    out = WT.expert_weights(spark.createDataFrame(rows, "expert int, a string, b string, ratio double"), "expert", K.GLOBAL_CRITERIA).collect()
    weights = {r["expert"]: r["weights"] for r in out}
    assert set(weights) == {7, 8} and weights[8] is None  # the second expert judged one pair only: reported, without weights
    assert dict(zip(K.GLOBAL_CRITERIA, [round(w, 4) for w in weights[7]])) == K.GLOBAL_WEIGHTS


def test_overlay_and_exclusion_of_known_places(spark):
    df = spark.createDataFrame([p[:7] for p in PLACES], "site string, ghi double, slope double, landcover double, accessibility double, ndvi double, temperature double")
    got = {r["site"]: r for r in df.select("site", F.round(O.global_overlay(), 2).alias("s"), FT.exclusion_reason(F.col("landcover"), F.col("slope")).alias("x")).collect()}
    for p in PLACES:
        assert got[p[0]]["s"] == p[7] and got[p[0]]["x"] == p[8]


def test_energy_of_one_acre(spark):
    e = FT.energy(F.lit(5.4), F.lit(K.ACRE_M2))
    row = spark.range(1).select(*[c.alias(n) for n, c in e.items()]).first()
    assert row["annual_mwh"] == pytest.approx(1196.4531, abs=1e-3)
    assert round(row["peak_kwp"]) == 809 and row["specific_yield"] == pytest.approx(1478.25)
    zero = FT.energy(F.lit(5.4), F.lit(0.0))["specific_yield"]
    assert spark.range(1).select(zero).first()[0] == 0.0


@pytest.mark.parametrize("text,expected", [
    ("51.5294, -0.1727", (51.5294, -0.1727)), ("51.5 N 0.17 W", (51.5, -0.17)), ("10 S; 20 E", (-10.0, 20.0)),
    ("95, 10", (None, None)), ("Berlin", (None, None)), ("-33.9° , 18.4°", (-33.9, 18.4))])
def test_coordinates(spark, text, expected):
    p = TX.parse_coordinates(F.lit(text))
    assert tuple(spark.range(1).select(p["lat"], p["lon"]).first()) == expected


@pytest.mark.parametrize("raw,norm", [("Café d'Été", "cafe dete"), ("São  Paulo!", "sao paulo"), ("Straße", "strae"), (None, "")])
def test_normalisation(spark, raw, norm):
    assert spark.range(1).select(TX.normalize_name(F.lit(raw).cast("string"))).first()[0] == norm


def test_null_rules(spark):
    row = spark.range(1).select(
        FT.benefit(F.lit(None).cast("double"), 0, 1).alias("benefit"), FT.code_lookup(F.lit(None).cast("double"), K.IGBP_SCORE).alias("code"),
        FT.code_lookup(F.lit(99.0), K.IGBP_SCORE).alias("unknown"), FT.one_hot(F.lit(None).cast("double"), [1]).alias("hot"),
        FT.aspect_east(F.lit(None).cast("double"), F.lit(3.0)).alias("aspect"), FT.log_floor(F.lit(None).cast("double")).alias("log"),
        FT.code_of(F.lit(2.5)).alias("even")).first()
    assert tuple(row) == (None, None, 0.0, 0, 0.0, None, 2)
