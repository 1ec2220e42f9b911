"""Queries of forecasts, metrics, noise estimators and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.seed import keyed_order
from panelloom.operators import boosting, forecast, scores
from panelloom.operators import tabulate as B
from panelloom.operators import windows as X
from panelloom.plans.panel_queries import _LAG, _USABLE, SURVIVAL_SQL
from panelloom.plans.tables import SCORED_SQL, Register, Tables, panel_sql

register = Register()
queries, oracle_sql = register.queries, register.oracle_sql

_S = f"with s as ({SCORED_SQL}) "
_FOLD = "cast(('0x' || substr(md5('7:' || entity_id), 1, 8)) as bigint) % 5"
_RATES = panel_sql(f"{_LAG}, n as (select entity_id, obs_id, post, {_FOLD} as fold, ln(v / pv) as y, (t - pt) / 365.25 as dt_yr, pv, v from q where {_USABLE} and t > pt)")


def _pairs(t: Tables) -> DataFrame:
    rows = X.consecutive(t.panel(), ["t", "v", "absent"]).where("not coalesce(crossed, false) and not absent and not prev_absent and v > 0 and prev_v > 0 and t > prev_t")
    return rows.select("entity_id", "obs_id", "post", (keyed_order("7", F.col("entity_id")) % 5).cast("int").alias("fold"), F.log(F.col("v") / F.col("prev_v")).alias("y"), ((F.col("t") - F.col("prev_t")) / 365.25).alias("dt_yr"), F.col("prev_v"), F.col("v"))


def _by_entity(rows: DataFrame) -> DataFrame:
    """Adds inner: five inner folds that keep all rows of an entity together."""
    return rows.withColumn("inner", (keyed_order("100", F.col("fold"), F.col("entity_id")) % 5).cast("int"))


def _survival(t: Tables) -> DataFrame:
    return X.survival(X.initial_run(t.panel()), 0.2)


@register("f04_pooled_rate", _RATES + ", f as (select fold, sum(y / dt_yr) as s, count(*) as n from n group by fold) select fold::int as fold, round((sum(s) over () - s) / (sum(n) over () - n), 6) as train_mean from f")
def f04(t: Tables) -> DataFrame:
    rows = _pairs(t).withColumn("rate", F.col("y") / F.col("dt_yr"))
    return forecast.held_out_mean(rows, "rate").select("fold", F.round("train_mean", 6).alias("train_mean"))


@register("f05_train_median", _RATES + " select f.fold::int as test_fold, round(median(y), 6) as train_median from n, (values (0), (1), (2), (3), (4)) f(fold) where n.fold <> f.fold group by f.fold")
def f05(t: Tables) -> DataFrame:
    return forecast.held_out_median(_pairs(t), "y", 5).select("test_fold", F.round("train_median", 6).alias("train_median"))


@register("f06_shrunk_trend", _RATES + """, z as (select fold, cast(('0x' || substr(md5('100:' || fold || ':' || entity_id), 1, 8)) as bigint) % 5 as inr, y, lag(y / dt_yr) over (partition by entity_id order by obs_id) * dt_yr as x from n),
g as (select f.fold as test_fold, a.alpha, inr, avg(abs(y - a.alpha * x)) as mae from z, (values (0), (1), (2), (3), (4)) f(fold), (values (0.0), (0.25), (0.5), (1.0)) a(alpha) where z.fold <> f.fold and x is not null group by all),
m as (select test_fold, alpha, round(avg(mae), 9) as score from g group by all)
select test_fold::int as test_fold, first(alpha order by score, alpha)::double as alpha from m group by test_fold""")
def f06(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = _by_entity(_pairs(t))
    rows = rows.withColumn("x", F.lag(F.col("y") / F.col("dt_yr")).over(Window.partitionBy("entity_id").orderBy("obs_id")) * F.col("dt_yr")).where("x is not null")
    return forecast.shrunk_trend(rows, [0.0, 0.25, 0.5, 1.0], 5).select("test_fold", "alpha")


@register("f07_ridge_one_feature", _RATES + """, f as (select fold, count(*) n, sum(dt_yr) sx, sum(y) sy, sum(dt_yr * dt_yr) sxx, sum(dt_yr * y) sxy from n group by fold),
t as (select fold, sum(n) over () - n as n, sum(sx) over () - sx as sx, sum(sy) over () - sy as sy, sum(sxx) over () - sxx as sxx, sum(sxy) over () - sxy as sxy from f),
b as (select fold, sx / n as mx, sy / n as my, sqrt(sxx / n - (sx / n) * (sx / n)) + 1e-9 as sd, (sxy / n - sx / n * sy / n) as cxy, sxx / n - (sx / n) * (sx / n) as cxx, n from t),
c as (select fold, mx, my, (cxy / sd * n) / (cxx / (sd * sd) * n + 10) / sd as beta from b)
select n.obs_id, n.fold::int as fold, round(my + beta * (dt_yr - mx), 5) as pred from n join c using (fold)""")
def f07(t: Tables) -> DataFrame:
    return forecast.ridge_out_of_fold(_pairs(t), ["dt_yr"], "y", 10.0).select("obs_id", "fold", F.round("pred", 5).alias("pred"))


@register("f08_ridge_inner_cv")
def f08(t: Tables) -> DataFrame:
    rows = _by_entity(_pairs(t)).withColumn("lv", F.log("prev_v")).withColumn("p", F.col("post").cast("double"))
    out = forecast.ridge_with_inner_cv(rows, ["dt_yr", "lv", "p"], "y", [0.1, 1.0, 10.0, 100.0])
    return out.groupBy("fold", "penalty").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("y"))), 5).alias("mae"))


@register("f10_mixed_model")
def f10(t: Tables) -> DataFrame:
    run = X.initial_run(t.panel(), stop_at_post=False)
    points = run.select("entity_id", ((F.col("t") - F.first("t").over(X.SO_FAR())) / 365.25).alias("x"), F.log("v").alias("y"))
    par, sums = forecast.mixed_model(points)
    return forecast.blup(sums, par).select("entity_id", F.round("u0", 6).alias("u0"), F.round("u1", 6).alias("u1"), F.lit(bool(par["converged"])).alias("converged"))


@register("f12_gradient_boosting")
def f12(t: Tables) -> DataFrame:
    rows = _by_entity(_pairs(t)).withColumn("lv", F.log("prev_v"))
    out = boosting.boosted_out_of_fold(rows, ["dt_yr", "lv"], "y", "obs_id")
    return out.groupBy("fold", "depth", "rate", "trees").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("y"))), 4).alias("mae"))


@register("f18_cox")
def f18(t: Tables) -> DataFrame:
    rows = _survival(t).withColumn("n", F.col("n_obs").cast("double"))
    fit = [(c, *(round(x, 6) for x in found)) for c, *found in forecast.cox(rows, ["log_v0", "n"])]
    return t.spark.createDataFrame(fit, "covariate string, coefficient double, standard_error double, hazard_ratio double, p_value double")


_AUC = "per as (select {by} p, sum(y) as pos, sum(1 - y) as neg from s group by {by} p), r as (select *, coalesce(sum(neg) over (partition by {part} order by p rows between unbounded preceding and 1 preceding), 0) as below from per)"


@register("g01_auc", _S + ", " + _AUC.format(by="", part="1") + " select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from r")
def g01(t: Tables) -> DataFrame:
    return scores.auc(t.scored()).select(F.round("auc", 6).alias("auc"))


@register("g02_g03_probability_scores", _S + "select fold, count(*)::bigint as n, round(avg((p - y) * (p - y)), 6) as brier, round(-avg(case when y = 1 then ln(p) else ln(1 - p) end), 6) as log_loss from s group by fold")
def g02(t: Tables) -> DataFrame:
    return scores.probability_scores(t.scored(), ["fold"]).select("fold", "n", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@register("g05_calibration_error", _S + ", e as (select quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) as e from s), b as (select len(list_filter(e.e, lambda x: x <= p)) as bin, count(*) as n, abs(avg(p) - avg(y)) as gap from s, e group by 1) select round(sum(n * gap) / sum(n), 6) as ece from b")
def g05(t: Tables) -> DataFrame:
    return scores.calibration_error(t.scored()).select(F.round("ece", 6).alias("ece"))


@register("g06_fold_auc", _S + ", " + _AUC.format(by="fold,", part="fold") + ", a as (select fold, case when sum(pos) * sum(neg) > 0 then sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) end as auc from r group by fold) select round(avg(auc), 6) as mean_auc, round(stddev_samp(auc), 6) as sd_auc from a")
def g06(t: Tables) -> DataFrame:
    return scores.auc(t.scored(), ["fold"]).agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_samp("auc"), 6).alias("sd_auc"))


_KM = SURVIVAL_SQL + """, per as (select time_yr, count(*) as n, sum(event) as events from sv group by time_yr),
kr as (select *, sum(n) over (order by time_yr desc) as at_risk from per),
km as (select time_yr, at_risk::bigint as at_risk, events::bigint as events, case when max((events = at_risk)::int) over w = 1 then 0.0 else exp(sum(case when events < at_risk then ln(1 - events / at_risk) else 0 end) over w) end as survival from kr window w as (order by time_yr rows unbounded preceding))"""


@register("g07_kaplan_meier", panel_sql(_KM + " select round(time_yr, 6) as time_yr, at_risk, events, round(survival, 6) as survival from km"))
def g07(t: Tables) -> DataFrame:
    return scores.kaplan_meier(_survival(t)).select(F.round("time_yr", 6).alias("time_yr"), "at_risk", "events", F.round("survival", 6).alias("survival"))


@register("g07_survival_at_years", panel_sql(_KM + " select y.year::double as year, round(coalesce(arg_max(survival, time_yr) filter (time_yr <= y.year), 1.0), 6) as survival from km, (values (1), (2), (3), (5)) y(year) group by y.year"))
def g07b(t: Tables) -> DataFrame:
    return scores.survival_at(scores.kaplan_meier(_survival(t)), [1, 2, 3, 5]).select("year", F.round("survival", 6).alias("survival"))


@register("g09_concordance", panel_sql(SURVIVAL_SQL + f", cc as (select {_FOLD} as fold, time_yr as time, event, round(log_v0, 3) as risk from sv) select a.fold, round(sum(case when a.risk > b.risk then 1.0 when a.risk = b.risk then 0.5 else 0 end) / count(*), 6) as c_index from cc a join cc b on a.fold = b.fold and a.time < b.time and a.event = 1 group by a.fold"))
def g09(t: Tables) -> DataFrame:
    rows = _survival(t).select((keyed_order("7", F.col("entity_id")) % 5).alias("fold"), F.col("time_yr").alias("time"), "event", F.round("log_v0", 3).alias("risk"))
    return scores.concordance(rows, "fold").select("fold", F.round("c_index", 6).alias("c_index"))


@register("g10_agreement", _S + "select (p >= 0.5)::int as event, y, count(*)::bigint as n from s group by all")
def g10(t: Tables) -> DataFrame:
    return B.agreement(t.scored(), (F.col("p") >= 0.5).cast("int"), "y")


@register("g12_g13_soft_dice", _S + "select entity_id as class, round(sum(p * y), 4) as tp, round(sum(p * (1 - y)), 4) as fp, round(sum((1 - p) * y), 4) as fn, round(sum((1 - p) * (1 - y)), 4) as tn, round((2 * sum(p * y) + 1e-6) / (2 * sum(p * y) + sum(p * (1 - y)) + sum((1 - p) * y) + 1e-6), 6) as dice from s group by entity_id")
def g12(t: Tables) -> DataFrame:
    sums = B.soft_confusion(t.scored().withColumnRenamed("entity_id", "class"), "y", "p", "class")
    return sums.select("class", *[F.round(c, 4).alias(c) for c in ("tp", "fp", "fn", "tn")], F.round("dice", 6).alias("dice"))


@register("e06_finite_summary", "with r as (select l_linenumber, case when l_discount = 0 then 'nan'::double else l_tax / l_discount end as ratio, l_quantity as quantity from lineitem), m as (select l_linenumber, 'ratio' as metric, ratio as x from r union all select l_linenumber, 'quantity', quantity from r) select l_linenumber, metric, count(*) filter (isfinite(x))::bigint as n_finite, count(*) filter (not isfinite(x))::bigint as n_nonfinite, round(avg(x) filter (isfinite(x)), 6) as mean, round(stddev_samp(x) filter (isfinite(x)), 6) as std, round(median(x) filter (isfinite(x)), 6) as median from m group by l_linenumber, metric")
def e06(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linenumber", F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount"))).alias("ratio"), F.col("l_quantity").alias("quantity"))
    out = scores.finite_summary(rows, ["ratio", "quantity"], ["l_linenumber"])
    return out.select("l_linenumber", "metric", "n_finite", "n_nonfinite", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


@register("e09_two_stage_mean", "select round(avg(m), 3) as mean from (select o_custkey, avg(o_totalprice) as m from orders group by 1)")
def e09(t: Tables) -> DataFrame:
    return B.two_stage_mean(t.orders, "o_totalprice", "o_custkey").select(F.round("mean", 3).alias("mean"))


@register("e10_fold_means", _RATES + ", f as (select fold, avg(abs(y)) as m, count(*) as n from n group by fold) select round(avg(m), 6) as mean, round(stddev_samp(m), 6) as std, sum(n)::bigint as n from f")
def e10(t: Tables) -> DataFrame:
    return B.fold_means(_pairs(t).withColumn("a", F.abs("y")), "a").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@register("e11_top_fifth", _RATES + ", c as (select quantile_cont(abs(y), 0.8) as cut from n) select obs_id, round(abs(y), 6) as change from n, c where abs(y) >= cut")
def e11(t: Tables) -> DataFrame:
    return scores.top_share(_pairs(t).withColumn("change", F.abs("y")), "change", 0.2).select("obs_id", F.round("change", 6).alias("change"))


@register("e12_e22_subsets", _RATES + ", s as (select 'all' as subset, * from n union all select 'long', * from n where dt_yr > 1 union all select 'small', * from n where pv < 100000 union all select 'post', * from n where post) select subset, count(*)::bigint as n, round(median(abs(y)), 6) as median_abs, round(avg((abs(v - pv) / pv > 0.2)::int), 6) as share_20 from s group by subset")
def e12(t: Tables) -> DataFrame:
    rows = scores.subset_fan_out(_pairs(t), {"all": F.lit(True), "long": F.col("dt_yr") > 1, "small": F.col("prev_v") < 100000, "post": F.col("post")})
    rows = rows.withColumn("a", F.abs("y"))
    flat = rows.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.abs(F.col("v") - F.col("prev_v")) / F.col("prev_v") > 0.2).cast("int")), 6).alias("share_20"))
    return scores.with_quantiles(flat, rows, ["subset"], "a", {"median_abs": 0.5}).withColumn("median_abs", F.round("median_abs", 6))


@register("e14_spearman", "with r as (select o_totalprice as x, round(o_totalprice / 1000) * 7 % 100 as y from orders), k as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from r) select round(corr(rx, ry), 6) as rho from k")
def e14(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_totalprice").alias("x"), (F.round(F.col("o_totalprice") / 1000) * 7 % 100).alias("y"))
    return scores.spearman(rows, "x", "y").select(F.round("rho", 6).alias("rho"))


def draws_sql(source: str, seed: str, replicates: int, by: str = "") -> str:
    """CTEs ent (by, entity_id, k, n) and drawn (by, entity_id, r, times): n draws with replacement a replicate."""
    part, comma, same = (f"partition by {by} ", f"{by}, ", " and ".join(f"ent.{c.strip()} = pick.{c.strip()}" for c in by.split(",")) + " and ") if by else ("", "", "")
    return f"""ent as (select {comma}entity_id, row_number() over ({part}order by entity_id) - 1 as k, count(*) over ({part.strip()}) as n from (select distinct {comma}entity_id from {source})),
pick as (select {comma}r, floor(cast(('0x' || substr(md5('{seed}:' || r || ':' || k), 1, 13)) as bigint) / 4503599627370496.0::double * n) as k, count(*) as times from ent, generate_series(1, {replicates}) g(r) group by all),
drawn as (select {", ".join(f"ent.{c.strip()}" for c in by.split(",")) + ", " if by else ""}ent.entity_id, r, times from ent join pick on {same}ent.k = pick.k)"""


@register("e15_cluster_bootstrap", _RATES + ", s as (select entity_id, sum(abs(y)) as s, count(*) as n from n group by 1), " + draws_sql("n", "boot", 200) + ", m as (select r, sum(times * s) / sum(times * s.n) as m from s join drawn using (entity_id) group by r) select (select round(sum(s) / sum(n), 6) from s) as mean, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi from m")
def e15(t: Tables) -> DataFrame:
    out = scores.cluster_bootstrap(_pairs(t).withColumn("a", F.abs("y")), "a", 200, "boot")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@register("e18_e19_paired_difference", _RATES + " select round(avg(abs(y - 0.1 * dt_yr) - abs(y)), 6) as mean_difference, round(avg((abs(y - 0.1 * dt_yr) < abs(y))::int), 6) as better, round(1 - sum((y - 0.1 * dt_yr) * (y - 0.1 * dt_yr)) / sum(y * y), 6) as r2_zero, round(1 - sum((y - 0.1 * dt_yr) * (y - 0.1 * dt_yr)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) as r2 from n")
def e18(t: Tables) -> DataFrame:
    out = B.fit_scores(_pairs(t), F.col("y"), 0.1 * F.col("dt_yr"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_difference", "better", "r2_zero", "r2")])


@register("h01_robust_sd", _RATES + ", m as (select post, median(y) as m from n group by post) select n.post, count(*)::bigint as n, round(1.4826 * median(abs(y - m)), 6) as sd from n join m on n.post = m.post group by n.post")
def h01(t: Tables) -> DataFrame:
    return scores.robust_sd(_pairs(t), "y", ["post"]).select("post", "n", F.round("sd", 6).alias("sd"))


@register("h02_zero_interval", _RATES + """, e as (select quantile_cont(dt_yr, [0.2, 0.4, 0.6, 0.8]) as e from n), b as (select len(list_filter(e.e, lambda x: x <= dt_yr)) as bin, y, dt_yr from n, e),
m as (select bin, median(y) as m from b group by bin), z as (select b.bin, count(*) as n, pow(1.4826 * median(abs(y - m)), 2) as v, avg(dt_yr * dt_yr) as x from b join m on b.bin = m.bin group by b.bin having count(*) >= 5),
s as (select sum(n) w, sum(n * x) wx, sum(n * v) wy, sum(n * x * x) wxx, sum(n * x * v) wxy from z)
select round(greatest((wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w, 0), 6) as variance from s""")
def h02(t: Tables) -> DataFrame:
    return scores.zero_interval(_pairs(t)).select(F.round("variance", 6).alias("variance"))


@register("h03_h08_shrinkage", _RATES + ", z as (select -y as z from n where y < 0) select count(*)::bigint as n, round(sqrt(avg(z * z)), 6) as rms, round(median(z) / 0.6745, 6) as median_sigma, round(quantile_cont(z, 0.5), 6) as p50, round(quantile_cont(z, 0.9), 6) as p90, round(quantile_cont(z, 0.95), 6) as p95 from z")
def h03(t: Tables) -> DataFrame:
    return scores.shrinkage(_pairs(t)).select("n", *[F.round(c, 6).alias(c) for c in ("rms", "median_sigma", "p50", "p90", "p95")])


@register("i01_balanced_folds", "with r as (select o_custkey as entity_id, cast(('0x' || substr(md5('100:' || o_custkey), 1, 8)) as bigint) as o from (select distinct o_custkey from orders)) select entity_id, ((row_number() over (order by o, entity_id) - 1) % 5)::int as fold from r")
def i01(t: Tables) -> DataFrame:
    return scores.balanced_folds(t.orders.select(F.col("o_custkey").alias("entity_id")), 5, "100")


@register("i03_rotation", "with r as (select o_custkey as entity_id, cast(('0x' || substr(md5('100:' || o_custkey), 1, 8)) as bigint) as o from (select distinct o_custkey from orders)), f as (select entity_id, ((row_number() over (order by o, entity_id) - 1) % 5)::int as fold from r) select t.f::int as test_fold, case when fold = t.f then 'test' when fold = (t.f + 1) % 5 then 'validation' else 'train' end as role, count(*)::bigint as n from f, (values (0), (1), (2), (3), (4)) t(f) group by all")
def i03(t: Tables) -> DataFrame:
    folds = scores.balanced_folds(t.orders.select(F.col("o_custkey").alias("entity_id")), 5, "100")
    return scores.rotation(folds, 5).groupBy("test_fold", "role").agg(F.count(F.lit(1)).alias("n"))


@register("i04_inner_folds", "with o as (select distinct o_custkey as entity_id from orders) select entity_id, f.f::int as outer_fold, (cast(('0x' || substr(md5('100:' || f.f || ':' || entity_id), 1, 8)) as bigint) % 5)::int as inner_fold from o, (values (0), (1), (2)) f(f)")
def i04(t: Tables) -> DataFrame:
    return B.inner_folds(t.orders.select(F.col("o_custkey").alias("entity_id")), "entity_id", 3, 5, "100")


@register("i05_m02_complete_and_disjoint", "with f as (select distinct o_custkey % 5 as fold, o_custkey from orders) select count(distinct fold)::bigint as folds, (select count(*) from (select o_custkey from f where fold = 0 intersect select o_custkey from f where fold <> 0))::bigint as shared from f")
def i05(t: Tables) -> DataFrame:
    return B.fold_overlap(t.orders.select((F.col("o_custkey") % 5).alias("fold"), "o_custkey"), "fold", "o_custkey", 0)