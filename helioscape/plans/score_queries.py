"""Overlays, expert weights, descriptive statistics and evaluation."""
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import features as FT
from ..operators import metrics as M
from ..operators import overlay as O
from ..operators import profile as PR
from ..operators import weighting as WT
from ..operators.ordered import percentiles
from .registry import query
from .shape_queries import R
from .views import table, view


def case_igbp(col: str) -> str:
    whens = " ".join(f"when {k} then {v}e0" for k, v in K.IGBP_SCORE.items())
    return f"(case when {col} is null then 0.5e0 else case {col} {whens} else 0e0 end end)"


def case_cover(col: str) -> str:
    whens = " ".join(f"when {k} then {v}e0" for k, v in K.WORLDCOVER_SCORE.items())
    return f"(case when {col} is null then 0.5e0 else case {col} {whens} else 0e0 end end)"


def clip_sql(expr: str) -> str:
    return f"least(greatest({expr}, 0), 1)"


def overlay_sql(sfx: str = "", weights=(0.3422, 0.2057, 0.2057, 0.1219, 0.0753, 0.0492)) -> str:
    g, s, l, a, n, t = weights
    return f"""(100*({g!r}e0*{clip_sql('(ghi-2.5e0)/4e0')} + {s!r}e0*coalesce(case when slope is null then null else 1-{clip_sql('slope/10e0')} end, 0.5e0)
 + {l!r}e0*{case_igbp('landcover' + sfx)} + {a!r}e0*(1-{clip_sql('(accessibility-30)/330e0')})
 + {n!r}e0*coalesce(case when ndvi{sfx} is null then null else 1-{clip_sql(f'(ndvi{sfx}-0.1e0)/0.6e0')} end, 0.5e0)
 + {t!r}e0*{clip_sql('least((temperature+10)/20e0, (40-temperature)/15e0)')})
 * (case when coalesce(landcover{sfx} in (11,13,15,17), false) or coalesce(slope > 15, false) then 0e0 else 1e0 end))"""


_P = [0.3422, 0.2057, 0.2057, 0.0, 0.0753, 0.0492]
_PLAUS = overlay_sql("_pre", [w / (1 - 0.1219 + (sum(_P) + 0.1219 - 1)) for w in _P])


@query("overlay_global", views="sites", oracle=f"select site_id, round({overlay_sql()}, 7) + 0e0 as score from sites")
def overlay_global(spark, sf):
    return view(spark, sf, "sites").select("site_id", (R(O.global_overlay(), 7) + 0.0).alias("score"))


@query("overlay_summary", views="sites", oracle=f"""
with s as (select region, {overlay_sql()} as score from sites)
select region, round(avg(score), 6) as mean, round(avg(case when score = 0 then 1e0 else 0e0 end)*100, 6) as excluded_pct, round(avg(case when score >= 70 then 1e0 else 0e0 end)*100, 6) as high_pct,
 round(avg(case when score >= 40 and score < 70 then 1e0 else 0e0 end)*100, 6) as medium_pct, count(*) as n from s group by region""")
def overlay_summary(spark, sf):
    scored = view(spark, sf, "sites").select("region", O.global_overlay().alias("score"))
    out = O.map_summary(scored, "score", ["region"])
    return out.select("region", *[R(c, 6).alias(c) for c in ("mean", "excluded_pct", "high_pct", "medium_pct")], "n")


@query("overlay_regional", views="sites", oracle=f"""
with d as (select *, nightlights as dist_substation_km, cloud_cover/10e0 as dist_road_km from sites)
select site_id, round(100*(0.3164e0*{clip_sql('(ghi-4.5e0)/1.3e0')} + 0.1983e0*coalesce(case when slope is null then null else 1-{clip_sql('slope/10e0')} end, 0.5e0)
 + 0.1983e0*{case_cover('worldcover')} + 0.1228e0*(1-{clip_sql('dist_substation_km/20e0')}) + 0.0510e0*(1-{clip_sql('dist_road_km/5e0')})
 + 0.0782e0*coalesce(case when ndvi is null then null else 1-{clip_sql('(ndvi-0.1e0)/0.5e0')} end, 0.5e0) + 0.0350e0*(1-{clip_sql('(temperature-25)/10e0')}))
 * (case when worldcover in (50,70,80,90,95) or coalesce(slope > 15, false) then 0 else 1 end), 7) + 0e0 as cover_score,
 round(100*(0.3164e0*{clip_sql('(ghi-4.5e0)/1.3e0')} + 0.1983e0*coalesce(case when slope is null then null else 1-{clip_sql('slope/10e0')} end, 0.5e0)
 + 0.1983e0*{case_igbp('landcover_pre')} + 0.1228e0*(1-{clip_sql('dist_substation_km/20e0')}) + 0.0510e0*(1-{clip_sql('dist_road_km/5e0')})
 + 0.0782e0*coalesce(case when ndvi_pre is null then null else 1-{clip_sql('(ndvi_pre-0.1e0)/0.5e0')} end, 0.5e0) + 0.0350e0*(1-{clip_sql('(temperature-25)/10e0')}))
 * (case when coalesce(landcover_pre in (11,13,15,17), false) or coalesce(slope > 15, false) then 0 else 1 end), 7) + 0e0 as igbp_score from d""")
def overlay_regional(spark, sf):
    d = view(spark, sf, "sites").withColumns({"dist_substation_km": F.col("nightlights"), "dist_road_km": F.col("cloud_cover") / 10})
    return d.select("site_id", (R(O.regional_overlay(), 7) + 0.0).alias("cover_score"),
                    (R(O.regional_overlay("igbp", "landcover_pre", "ndvi_pre"), 7) + 0.0).alias("igbp_score"))


@query("plausibility", views="sites", oracle=f"select site_id, round({_PLAUS}, 6) + 0e0 as plausibility from sites")
def plausibility(spark, sf):
    return view(spark, sf, "sites").select("site_id", (R(O.plausibility("pre"), 6) + 0.0).alias("plausibility"))


@query("reliable_negatives", views="sites", oracle=f"""
with p as (select label, {_PLAUS} as p from sites)
select cast(sum(case when label = 0 and p < 60 then 1 else 0 end) as bigint) as n_reliable, cast(sum(case when label = 0 and p >= 60 then 1 else 0 end) as bigint) as n_unlabelled,
 cast(sum(case when label = 1 or p < 60 then 1 else 0 end) as bigint) as n_training from p""")
def reliable_negatives(spark, sf):
    s = view(spark, sf, "sites").select("label", O.plausibility("pre").alias("plaus"))
    marked = O.reliable_negatives(s, "label", "plaus")
    return marked.agg(F.count_if("reliable").alias("n_reliable"), F.count_if((F.col("label") == 0) & ~F.col("reliable")).alias("n_unlabelled"),
                      F.count_if("in_training").alias("n_training"))


@query("balanced_weights", views="sites", oracle="""
with c as (select coalesce(region, 'Other') as r, label, count(*) as c from sites group by 1, 2), n as (select sum(c) as n, count(*) as k from c),
w as (select site_id, region, sites.label, n.n, n.n*1e0/n.k/c.c as w from sites join c on c.r = region and c.label = sites.label, n),
m as (select median(w)*10 as cap from w), x as (select site_id, n, least(w, cap) as w from w, m)
select site_id, round(w*n/(select sum(w) from x), 9) as weight from x""")
def balanced_weights(spark, sf):
    s = view(spark, sf, "sites").select("site_id", "region", "label")
    return M.balanced_weights(s, "region", "label").select("site_id", R("weight").alias("weight"))


def judgements(spark, sf):
    """One judgement per order: the expert is a group of customers, the pair and ratio follow from the keys."""
    pairs = WT.pair_list(K.GLOBAL_CRITERIA)
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    orders = table(spark, sf, "orders")
    j = orders.select((F.col("o_custkey") % 40).alias("expert"), "o_orderkey").select(
        "expert", F.element_at(names, (F.col("o_orderkey") % len(pairs) + 1).cast("int")).alias("p"),
        (1.0 + F.col("o_orderkey") * 7 % 5).alias("ratio"))
    return j.select("expert", "p.a", "p.b", "ratio")


@query("group_judgement", oracle=f"""
with p as (select * from (values {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(WT.pair_list(K.GLOBAL_CRITERIA)))}) v(i, a, b)),
j as (select a, b, 1e0 + o_orderkey*7 % 5 as ratio from orders join p on i = o_orderkey % 15)
select least(a, b) as a, greatest(a, b) as b, round(exp(avg(case when a > b then -ln(ratio) else ln(ratio) end)), 9) as ratio, count(*) as n from j group by 1, 2""")
def group_judgement(spark, sf):
    return WT.group_judgement(judgements(spark, sf)).select("a", "b", R("ratio").alias("ratio"), "n")


@query("expert_weights")
def expert_weights(spark, sf):
    out = WT.expert_weights(judgements(spark, sf), "expert", K.GLOBAL_CRITERIA)
    return out.select("expert", *[R(F.col("weights")[i], 9).alias(f"w{i}") for i in range(len(K.GLOBAL_CRITERIA))],
                      R("lambda_max", 9).alias("lambda_max"), R("cr", 9).alias("cr"))


_W = ", ".join(f"w{i}" for i in range(6))


@query("pairwise_weights", oracle=f"""
with recursive p as (select * from (values {', '.join(f"({i}, {K.GLOBAL_CRITERIA.index(a)}, {K.GLOBAL_CRITERIA.index(b)})" for i, (a, b) in enumerate(WT.pair_list(K.GLOBAL_CRITERIA)))}) v(i, a, b)),
j as (select a, b, exp(avg(ln(1e0 + o_orderkey*7 % 5))) as ratio from orders join p on i = o_orderkey % 15 group by a, b),
mat as (select a, b, ratio as v from j union all select b, a, 1/ratio from j union all select i, i, 1e0 from range(6) t(i)),
m as (select a, list(v order by b) as v from mat group by a), l as (select list(v order by a) as m from m),
it as (select 0 as k, m, [1e0/6, 1e0/6, 1e0/6, 1e0/6, 1e0/6, 1e0/6] as w from l
 union all select k + 1, m, list_transform(list_transform(m, lambda r: list_dot_product(r, w)), lambda x: x / list_sum(list_transform(m, lambda r: list_dot_product(r, w)))) from it where k < 60)
select round(w[1], 9) as w0, round(w[2], 9) as w1, round(w[3], 9) as w2, round(w[4], 9) as w3, round(w[5], 9) as w4, round(w[6], 9) as w5,
 round(list_sum(list_transform(m, lambda r: list_dot_product(r, w))), 8) as lambda_max from it where k = 60""")
def pairwise_weights(spark, sf):
    """Weights of the group judgement of all experts."""
    group = WT.group_judgement(judgements(spark, sf)).withColumn("team", F.lit(1))
    out = WT.expert_weights(group, "team", K.GLOBAL_CRITERIA)
    return out.select(*[R(F.col("weights")[i], 9).alias(f"w{i}") for i in range(6)], R("lambda_max", 8).alias("lambda_max"))


# ---------------------------------------------------------------- descriptive statistics

PROFILE = ["ghi", "temperature", "cloud_cover", "elevation", "slope", "accessibility", "ndvi", "ndvi_pre", "ndbi", "ndbi_pre", "lst", "lst_pre",
           "nightlights", "nightlights_pre", "population", "population_pre"]


@query("region_class_counts", views="sites", oracle="select region, label, count(*) as n from sites group by region, label")
def region_class_counts(spark, sf):
    return view(spark, sf, "sites").groupBy("region", "label").agg(F.count("*").alias("n"))


@query("crosstab_margins", views="sites", oracle="""
select coalesce(region, 'All') as region, cast(sum(case when label = 0 then 1 else 0 end) as bigint) as c0, cast(sum(label) as bigint) as c1, count(*) as total from sites group by rollup(region)""")
def crosstab_margins(spark, sf):
    return PR.crosstab(view(spark, sf, "sites"), "region", "label", [0, 1]).withColumnsRenamed({"0": "c0", "1": "c1"})


@query("group_keep_null", views="sites", oracle="select label, landcover, count(*) as n from sites group by label, landcover")
def group_keep_null(spark, sf):
    return view(spark, sf, "sites").groupBy("label", "landcover").agg(F.count("*").alias("n"))


def _shares_sql(col, names):
    case = f"case {col} {' '.join(f'when {k} then {chr(39)}{v}{chr(39)}' for k, v in names.items())} end"
    return f"select name, n, round(n*100e0/(select count(*) from sites where label = 1 and {col} is not null), 7) as share from (select {case} as name, count(*) as n from sites where label = 1 and {col} is not null group by 1 order by n desc, name limit 8) t"


@query("class_shares", views="sites", oracle=f"select 'before' as epoch, * from ({_shares_sql('landcover_pre', K.IGBP_NAMES)}) a union all select 'now', * from ({_shares_sql('worldcover', K.WORLDCOVER_NAMES)}) b")
def class_shares(spark, sf):
    pos = view(spark, sf, "sites").where("label = 1")
    one = lambda col, names, epoch: PR.class_shares(pos.select(FT.landcover_name(F.col(col), names).alias("name")), "name").select(
        F.lit(epoch).alias("epoch"), "name", "n", R("share", 7).alias("share"))
    return one("landcover_pre", K.IGBP_NAMES, "before").unionByName(one("worldcover", K.WORLDCOVER_NAMES, "now"))


@query("label_medians", views="sites", oracle=" union all ".join(
    f"select '{f}' as feature, round(median(case when label = 0 then {f} end), 9) as negative, round(median(case when label = 1 then {f} end), 9) as positive from sites" for f in PROFILE))
def label_medians(spark, sf):
    out = PR.label_medians(view(spark, sf, "sites"), PROFILE, "label")
    return out.select("feature", R("negative").alias("negative"), R("positive").alias("positive"))


@query("quantiles", views="sites", oracle=" union all ".join(
    f"select '{f}' as feature, round(quantile_cont({f}, 0.01), 9) as lo, round(quantile_cont({f}, 0.99), 9) as hi from sites" for f in PROFILE))
def quantiles(spark, sf):
    return PR.quantile_limits(view(spark, sf, "sites"), PROFILE).select("feature", R("lo").alias("lo"), R("hi").alias("hi"))


@query("describe_features", views="sites", oracle=" union all ".join(
    f"select '{f}' as feature, count({f}) as count, round(avg({f}), 6) as mean, round(stddev_samp({f}), 6) as std, min({f}) as min, max({f}) as max, round(quantile_cont({f}, 0.25), 9) as q25, round(quantile_cont({f}, 0.5), 9) as q50, round(quantile_cont({f}, 0.75), 9) as q75 from sites" for f in PROFILE))
def describe_features(spark, sf):
    out = PR.describe(view(spark, sf, "sites"), PROFILE)
    return out.select("feature", "count", R("mean", 6).alias("mean"), R("std", 6).alias("std"), "min", "max", *[R(c).alias(c) for c in ("q25", "q50", "q75")])


@query("missing_pct", views="sites", oracle="select * from (" + " union all ".join(
    f"select '{f}' as feature, round(avg(case when {f} is null then 1e0 else 0e0 end)*100, 7) as pct, cast(sum(case when {f} is null then 1 else 0 end) as bigint) as n_missing from sites"
    for f in PROFILE + ["aspect", "landcover"]) + ") t where pct > 0")
def missing_pct(spark, sf):
    return PR.missing_pct(view(spark, sf, "sites"), PROFILE + ["aspect", "landcover"]).select("feature", R("pct", 7).alias("pct"), "n_missing")


HISTOGRAMS = ["ghi", "temperature", "slope", "elevation", "ndvi_pre", "lst_pre"]


def _histogram_sql(f):
    return f"""
select * from (with l as (select quantile_cont({f}, 0.01) as lo, quantile_cont({f}, 0.99) as hi from sites),
b as (select label, cast(least(floor((least(greatest({f}, lo), hi) - lo)/((hi-lo)/39)), 38) as int) as bin, (hi-lo)/39 as width from sites, l where {f} is not null),
n as (select label, bin, count(*) as n, any_value(width) as width from b group by label, bin)
select '{f}' as feature, label, bin, n, round(n/(sum(n) over (partition by label)*width), 7) as density from n) t_{f}"""


@query("class_histogram", views="sites", oracle=" union all ".join(_histogram_sql(f) for f in HISTOGRAMS))
def class_histogram(spark, sf):
    return PR.class_histogram(view(spark, sf, "sites"), HISTOGRAMS, "label").select("feature", "label", "bin", "n", R("density", 7).alias("density"))


_SP = ["ghi", "slope", "ndvi_pre", "lst_pre"]


@query("spearman_matrix", views="sites", oracle="with c as (select " + ", ".join(_SP) + " from sites where " + " and ".join(f"{f} is not null" for f in _SP) + "), r as (select "
       + ", ".join(f"rank() over (order by {f}) + (count(*) over (partition by {f}) - 1)/2e0 as {f}" for f in _SP) + " from c) "
       + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 8) as rho from r" for i, a in enumerate(_SP) for b in _SP[i + 1:]))
def spearman_matrix(spark, sf):
    return PR.spearman(view(spark, sf, "sites"), _SP, "site_id").select("a", "b", R("rho", 8).alias("rho"))


@query("leakage_change", views="sites", oracle=" union all ".join(
    f"select '{f}' as \"index\", label, round(median({f}_pre), 9) as before, round(median({f}), 9) as now, round(median({f}) - median({f}_pre), 9) as change from sites group by label" for f in ("ndvi", "ndbi", "lst")))
def leakage_change(spark, sf):
    out = PR.epoch_change(view(spark, sf, "sites"), ["ndvi", "ndbi", "lst"], "label")
    return out.select("index", "label", *[R(c).alias(c) for c in ("before", "now", "change")])


# ---------------------------------------------------------------- evaluation

AUC_SQL = "(sum(case when label = 1 then rk end) - sum(label)*(sum(label)+1)/2e0)/nullif(sum(label)*sum(1-label), 0)"


def scored(spark, sf):
    return view(spark, sf, "sites").select("site_id", "region", "label", F.bround("cloud_cover", 0).alias("p100"), (F.bround("cloud_cover", 0) / 100).alias("p"))


SCORED = "s as (select site_id, region, label, round_even(cloud_cover, 0)/100 as p from sites)"


@query("roc_auc", views="sites", oracle=f"""
with {SCORED}, r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1)/2e0 as rk from s) select round({AUC_SQL}, 9) as auc from r""")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf), "label", "p").select(R("auc").alias("auc"))


@query("roc_auc_by_region", views="sites", oracle=f"""
with {SCORED}, t as (select * from s where region <> 'ASIA' or label = 1), r as (select *, rank() over (partition by region order by p) + (count(*) over (partition by region, p) - 1)/2e0 as rk from t)
select region, round({AUC_SQL}, 9) as auc from r group by region""")
def roc_auc_by_region(spark, sf):
    one_class = scored(spark, sf).where("region <> 'ASIA' or label = 1")
    return M.roc_auc(one_class, "label", "p", ["region"]).select("region", R("auc").alias("auc"))


@query("roc_curve", views="sites", oracle=f"""
with {SCORED}, g as (select p, sum(label) as pos, sum(1-label) as neg from s group by p)
select p as threshold, round(sum(neg) over (order by p desc)/(select sum(neg) from g), 9) as fpr, round(sum(pos) over (order by p desc)/(select sum(pos) from g), 9) as tpr from g""")
def roc_curve(spark, sf):
    return M.roc_curve(scored(spark, sf), "label", "p").select("threshold", R("fpr").alias("fpr"), R("tpr").alias("tpr"))


CONFUSION = """cast(sum(case when p >= 0.5e0 and label = 1 then 1 else 0 end) as bigint) as tp, cast(sum(case when p >= 0.5e0 and label = 0 then 1 else 0 end) as bigint) as fp,
 cast(sum(case when p < 0.5e0 and label = 1 then 1 else 0 end) as bigint) as fn, cast(sum(case when p < 0.5e0 and label = 0 then 1 else 0 end) as bigint) as tn"""
RATES = """round((tp+tn)*1e0/(tp+fp+fn+tn), 9) as accuracy, round(coalesce(tp*1e0/nullif(tp+fp, 0), 0), 9) as "precision", round(coalesce(tp*1e0/nullif(tp+fn, 0), 0), 9) as recall,
 round(coalesce(2e0*tp/nullif(2*tp+fp+fn, 0), 0), 9) as f1"""
RATE_COLUMNS = ("accuracy", "precision", "recall", "f1")


@query("classification_metrics", views="sites", oracle=f"with {SCORED}, c as (select {CONFUSION} from s) select tp, fp, fn, tn, tp+fp+fn+tn as n, tp+fn as n_pos, {RATES} from c")
def classification_metrics(spark, sf):
    out = M.classification(scored(spark, sf), "label", "p")
    return out.select("tp", "fp", "fn", "tn", "n", "n_pos", *[R(c).alias(c) for c in RATE_COLUMNS])


@query("metrics_by_region", views="sites", oracle=f"""
with {SCORED}, r as (select *, rank() over (partition by region order by p) + (count(*) over (partition by region, p) - 1)/2e0 as rk from s),
c as (select region, {CONFUSION}, round({AUC_SQL}, 9) as auc, cast(sum(case when site_id % 5 = 0 then 1 else 0 end) as bigint) as n_test from r group by region)
select region, tp+fp+fn+tn as n, tp+fn as n_pos, {RATES}, auc, n_test, tp+fn < 150 as low_sample,
 case when tp+fn < 150 then concat(tp+fn, ' plants only: the figures of this region vary widely') else '' end as note from c""")
def metrics_by_region(spark, sf):
    s = scored(spark, sf).withColumn("is_test", F.col("site_id") % 5 == 0)
    return M.by_region(s, "label", "p").select("region", "n", "n_pos", *[R(c).alias(c) for c in RATE_COLUMNS + ("auc",)], "n_test", "low_sample", "note")


@query("region_mean_auc", views="sites", oracle=f"""
with {SCORED}, t as (select * from s where region <> 'ASIA' or label = 1), r as (select *, rank() over (partition by region order by p) + (count(*) over (partition by region, p) - 1)/2e0 as rk from t),
a as (select region, {AUC_SQL} as auc from r group by region) select round(avg(auc), 9) as auc from a""")
def region_mean_auc(spark, sf):
    return M.region_mean_auc(scored(spark, sf).where("region <> 'ASIA' or label = 1"), "label", "p").select(R("auc").alias("auc"))


@query("map_summary", views="sites", oracle="""
select round(avg(cloud_cover), 6) as mean, round(avg(case when cloud_cover = 0 then 1e0 else 0e0 end)*100, 6) as excluded_pct, round(avg(case when cloud_cover >= 70 then 1e0 else 0e0 end)*100, 6) as high_pct,
 round(avg(case when cloud_cover >= 40 and cloud_cover < 70 then 1e0 else 0e0 end)*100, 6) as medium_pct, count(*) as n from sites""")
def map_summary(spark, sf):
    return O.map_summary(view(spark, sf, "sites"), "cloud_cover").select(*[R(c, 6).alias(c) for c in ("mean", "excluded_pct", "high_pct", "medium_pct")], "n")


@query("mean_by_region", views="sites", oracle="select region, round_even(avg(cloud_cover), 1) as mean from sites group by region")
def mean_by_region(spark, sf):
    return view(spark, sf, "sites").groupBy("region").agg(F.bround(F.avg("cloud_cover"), 1).alias("mean"))


FOLDS = "f as (select site_id % 5 as fold, label, p, rank() over (partition by site_id % 5 order by p) + (count(*) over (partition by site_id % 5, p) - 1)/2e0 as rk from s)"


@query("cv_summary", views="sites", oracle=f"with {SCORED}, {FOLDS}, a as (select fold, {AUC_SQL} as auc from f group by fold) select round(avg(auc), 9) as mean, round(stddev_pop(auc), 9) as std, count(auc) as folds from a")
def cv_summary(spark, sf):
    folds = M.roc_auc(scored(spark, sf).withColumn("fold", F.col("site_id") % 5), "label", "p", ["fold"])
    return M.fold_summary(folds).select(R("mean").alias("mean"), R("std").alias("std"), "folds")


@query("best_variant", views="sites", oracle="""
with v as (select 'ghi' as name, round(avg(ghi), 9) as s, 0 as i from sites union all select 'ghi_again', round(avg(ghi), 9), 1 from sites union all select 'ndvi', round(avg(ndvi), 9), 2 from sites) select arg_max(name, (s, -i)) as best from v""")
def best_variant(spark, sf):
    row = view(spark, sf, "sites").agg(R(F.avg("ghi")).alias("ghi"), R(F.avg("ndvi")).alias("ndvi"))
    variants = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("s"), F.lit(i).alias("i"))
                                              for i, (n, c) in enumerate((("ghi", "ghi"), ("ghi_again", "ghi"), ("ndvi", "ndvi")))])).alias("v")).select("v.*")
    return M.best_variant(variants, "name", "s", "i")


@query("score_vs_label", views="sites", oracle=f"""
with o as (select label, {overlay_sql('_pre')} as p from sites), r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1)/2e0 as rk from (select label, round(p, 9) + 0e0 as p from o) t)
select round(avg(case when label = 1 then p end), 6) as plants, round(avg(case when label = 0 then p end), 6) as others, round({AUC_SQL}, 8) as auc from r""")
def score_vs_label(spark, sf):
    s = view(spark, sf, "sites").select("label", F.coalesce(R(O.global_overlay("pre")) + 0.0, F.lit(0.0)).alias("p"), F.lit(1).alias("k"))
    means = s.groupBy("k").agg(R(F.avg(F.when(F.col("label") == 1, F.col("p"))), 6).alias("plants"), R(F.avg(F.when(F.col("label") == 0, F.col("p"))), 6).alias("others"))
    return means.join(M.roc_auc(s, "label", "p", ["k"]), "k").select("plants", "others", R("auc", 8).alias("auc"))


@query("overlay_as_classifier", views="sites", oracle=f"""
with s as (select label, round({overlay_sql('_pre')}, 9)/100 + 0e0 as p from sites), r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1)/2e0 as rk from s),
c as (select {CONFUSION}, round({AUC_SQL}, 8) as auc from r) select tp, fp, fn, tn, {RATES}, auc from c""")
def overlay_as_classifier(spark, sf):
    s = view(spark, sf, "sites").select("label", (F.coalesce(R(O.global_overlay("pre")), F.lit(0.0)) / 100 + 0.0).alias("p"))
    return M.evaluate(s, "label", "p").select("tp", "fp", "fn", "tn", *[R(c).alias(c) for c in RATE_COLUMNS], R("auc", 8).alias("auc"))


@query("metrics_document", views="sites", oracle=f"""
with {SCORED}, c as (select {CONFUSION}, avg(p) as mean_p from s) select round_even((tp+tn)*1e0/(tp+fp+fn+tn), 4) as accuracy, round_even(mean_p, 4) as mean_p, cast(null as double) as undefined, tp+fp+fn+tn as n from c""")
def metrics_document(spark, sf):
    s = scored(spark, sf)
    m = M.classification(s.withColumn("k", F.lit(1)), "label", "p", ["k"]).join(s.groupBy(F.lit(1).alias("k")).agg(F.avg("p").alias("mean_p")), "k")
    # four decimals; NaN becomes null
    tidy = lambda c: F.bround(F.nanvl(c, F.lit(None).cast("double")), 4)
    doc = m.select(F.to_json(F.struct(F.struct(tidy(F.col("accuracy")).alias("accuracy"), tidy(F.col("mean_p")).alias("mean_p"),
                                               tidy(F.col("mean_p") * float("nan")).alias("undefined")).alias("test"), F.col("n"))).alias("document"))
    d = doc.select(F.from_json("document", "test struct<accuracy double, mean_p double, undefined double>, n bigint").alias("d"))
    return d.select("d.test.*", "d.n")
