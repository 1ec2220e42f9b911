"""Queries of manifests, checked joins, paired and clustered summaries, model inputs and irregular masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import boosting, forecast, intake, scores, summaries
from panelloom.operators import voxel as V
from panelloom.operators import windows as X
from panelloom.plans.panel_queries import _W
from panelloom.plans.score_queries import _KM, _RATES, _by_entity, _pairs, _survival, draws_sql
from panelloom.plans.tables import Register, Tables, panel_sql
from panelloom.plans.voxel_queries import _GRID, _dense
from panelloom.sources import tables as T

register = Register()
queries, oracle_sql = register.queries, register.oracle_sql


@register("a01_manifest_scan", "select o_custkey::varchar as patient_id, count(*)::bigint as n, max(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) * 1000.0 + o_orderkey % 1000)::double as last_day, count(*) filter (o_orderpriority = '1-URGENT')::bigint as crossed from (select *, row_number() over (partition by o_custkey, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) * 1000.0 + o_orderkey % 1000 order by o_orderkey) as again from orders) where again = 1 group by 1")
def a01(t: Tables) -> DataFrame:
    """Orders written as a manifest file and loaded through its checks."""
    folder = T.scratch(t.spark)
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) * 1000.0 + F.col("o_orderkey") % 1000
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "no")
    rows = t.orders.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("timepoint_id"), day.alias("study_days"), F.lit("image").alias("image_path"), F.lit("mask").alias("mask_path"), flag.alias("intervened_since_previous"), F.lit("false").alias("no_residual_vs"))
    rows.groupBy("patient_id", "study_days").agg(*[F.min_by(c, "timepoint_id").alias(c) for c in ("timepoint_id", "image_path", "mask_path", "intervened_since_previous", "no_residual_vs")]).select(rows.columns).write.csv(folder, header=True)
    manifest = intake.load_manifest(t.spark, folder)
    return manifest.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.max("study_days").alias("last_day"), F.count_if("intervened_since_previous").alias("crossed"))


@register("b05_manifest_faults", panel_sql(f", q as (select *, lag(t) over ({_W}) as pt, row_number() over (partition by entity_id, obs_id order by t) as again from p) select entity_id, obs_id, 'not_increasing' as fault from q where t <= pt union all select entity_id, obs_id, 'repeated' from q where again > 1 union all select entity_id, obs_id, 'missing' from q where entity_id is null or obs_id is null or t is null or crossed is null"))
def b05(t: Tables) -> DataFrame:
    return intake.manifest_faults(t.panel(), "entity_id", "obs_id", "t", ("crossed",)).select("entity_id", "obs_id", "fault")


@register("b09_quality_flag", "select o_orderkey from orders where lower(trim(case o_orderkey % 4 when 0 then ' True ' when 1 then 'TRUE' when 2 then 'no' end)) = 'true'")
def b09(t: Tables) -> DataFrame:
    m = F.col("o_orderkey") % 4
    rows = t.orders.withColumn("qc", F.when(m == 0, " True ").when(m == 1, "TRUE").when(m == 2, "no"))
    return intake.quality_passed(rows, "qc").select("o_orderkey")


@register("c01_c02_one_to_one", "with a as (select l_orderkey as k, sum(l_quantity) as quantity from lineitem group by 1) select o_orderkey as k, o_orderstatus as status, round(quantity, 2) as quantity from orders join a on a.k = o_orderkey")
def c01(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("quantity"))
    return intake.one_to_one(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), lines, ["k"]).select("k", "status", F.round("quantity", 2).alias("quantity"))


@register("c03_unmatched", "select c_custkey as o_custkey, count(*)::bigint as n from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') group by 1")
def c03(t: Tables) -> DataFrame:
    return intake.unmatched(t.customer.select(F.col("c_custkey").alias("o_custkey")), t.orders.where("o_orderstatus = 'F'"), "o_custkey")


@register("c03_c04_many_to_one", "select o.o_orderkey, c.c_mktsegment as segment, n.n_name as nation from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey where n.n_regionkey = 1")
def c04(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.col("c_mktsegment").alias("segment"))
    nations = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = intake.many_to_one(t.orders.select("o_orderkey", "o_custkey"), customers, "o_custkey")
    return intake.many_to_one(rows, nations, "c_nationkey", how="inner").select("o_orderkey", "segment", "nation")


@register("c05_c06_mapped_merge", "with s as (select l_orderkey, max(l_shipdate) as ship, case when max(l_discount) > 0.05 then 'X' end as status from lineitem where l_quantity > 30 group by 1) select o_orderkey, coalesce(s.status, o_orderstatus) as o_orderstatus, cast(s.ship as date) as shipped, s.l_orderkey is not null as matched from orders left join s on s.l_orderkey = o_orderkey")
def c06(t: Tables) -> DataFrame:
    source = t.lineitem.where("l_quantity > 30").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("ship"), F.when(F.max("l_discount") > 0.05, "X").alias("status"))
    return intake.mapped_merge(t.orders.select("o_orderkey", "o_orderstatus"), source, {"o_orderkey": "l_orderkey"}, {"o_orderstatus": "status", "shipped": "ship"})


@register("c10_e18_paired", _RATES + """, d as (select 'drift' as model, entity_id, obs_id, abs(y - 0.1 * dt_yr) - abs(y) as difference from n union all select 'half', entity_id, obs_id, abs(y - 0.5 * dt_yr) - abs(y) from n),
s as (select model, entity_id, sum(difference) as s, count(*) as n from d group by all),
""" + draws_sql("d", "9", 100, "model") + """,
m as (select s.model, r, sum(times * s) / sum(times * s.n) as m from s join drawn on s.model = drawn.model and s.entity_id = drawn.entity_id group by all),
c as (select model, count(m) as replicates, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by model)
select d.model, count(*)::bigint as n, round(avg((difference < 0)::int), 6) as better, any_value(c.replicates)::bigint as replicates, round(avg(difference), 6) as mean, round(any_value(c.lo), 6) as lo, round(any_value(c.hi), 6) as hi from d join c on c.model = d.model group by d.model""")
def c10(t: Tables) -> DataFrame:
    error = lambda c: F.abs(F.col("y") - c * F.col("dt_yr"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), error(c).alias("error")) for m, c in (("persistence", 0.0), ("drift", 0.1), ("half", 0.5))]))
    results = _pairs(t).select("entity_id", F.col("obs_id").alias("instance_id"), each.alias("e")).select("entity_id", "instance_id", "e.*")
    out = summaries.paired_summary(results, "persistence", "entity_id", 100, "9")
    return out.select("model", "n", F.round("better", 6).alias("better"), "replicates", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@register("e08_metric_summary", _RATES + ", g as (select post, count(*) as n, avg(y) as mean, stddev_samp(y) as std, median(y) as median from n group by post), e as (select post, avg(m) as entity_mean from (select post, entity_id, avg(y) as m from n group by all) group by post) select g.post, g.n::bigint as n, round(mean, 6) as mean, round(std, 6) as std, round(median, 6) as median, round(entity_mean, 6) as entity_mean from g join e on e.post = g.post")
def e08(t: Tables) -> DataFrame:
    return summaries.metric_summary(_pairs(t), "y", "entity_id", ["post"]).select("post", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "entity_mean")])


@register("e23_group_median", "select c_mktsegment, count(c_acctbal)::bigint as n, round(median(c_acctbal), 6) as median from customer group by 1")
def e23(t: Tables) -> DataFrame:
    return summaries.group_median(t.customer, "c_acctbal", "c_mktsegment").withColumn("median", F.round("median", 6))


@register("e26_list_counts", "with x as (select list_filter([value, value - 50, case when event_id % 5 = 0 then 0.0 end], lambda v: v is not null) as v from events), u as (select unnest(v) as v from x) select (select count(*) from x)::bigint as lists, count(*)::bigint as values, count(*) filter (v < 10)::bigint as below, count(*) filter (v = 0)::bigint as zero from u")
def e26(t: Tables) -> DataFrame:
    text = F.concat(F.lit("["), F.concat_ws(",", F.col("value").cast("string"), (F.col("value") - 50).cast("string"), F.when(F.col("event_id") % 5 == 0, "0").otherwise("\"none\"")), F.lit("]"))
    return summaries.list_counts(t.events, text, 10.0)


_TRIPLES = f""", k as (
  select entity_id, obs_id, v as v1, lead(v) over w as v2, lead(v, 2) over w as v3, lead(t) over w - t as dt1, lead(t, 2) over w - lead(t) over w as dt2,
         coalesce(lead(crossed) over w, false) or coalesce(lead(crossed, 2) over w, false) or absent or lead(absent) over w or lead(absent, 2) over w as out
  from p window w as ({_W})
), e as (select * from k where v3 is not null and not out and dt1 > 0 and v1 > 0 and v2 > 0 and v3 > 0)"""


def _triples(t: Tables) -> DataFrame:
    return X.tuple_table(t.panel()).where("dt1 > 0 and v1 > 0 and v2 > 0 and v3 > 0")


_FORECASTS = _TRIPLES + """, f as (
  select 'persistence' as method, entity_id, v2 as pred, v2, v3 from e
  union all select 'linear', entity_id, greatest(v2 + (v2 - v1) / dt1 * dt2, 0), v2, v3 from e
  union all select 'log_linear', entity_id, least(v2 * exp(least(ln(v2 / v1) / dt1 * dt2, 50.0)), 1e12), v2, v3 from e
)"""


def _forecasts(t: Tables) -> DataFrame:
    return forecast.error_columns(forecast.trajectory_forecasts(_triples(t)))


@register("e08_case_summary", panel_sql(_FORECASTS + """, x as (
  select method, entity_id, 'abs_rvd' as metric, abs(pred - v3) / v3 as x from f
  union all select method, entity_id, 'abs_log_ratio', abs(ln(greatest(pred, 1) / v3)) from f
), i as (select * from x where metric = 'abs_rvd'), """ + draws_sql("i", "21", 60, "method, metric") + """,
s as (select method, metric, entity_id, sum(x) as s, count(x) as c from i group by all),
m as (select s.method, s.metric, r, sum(times * s) / sum(times * c) as m from s join drawn on s.method = drawn.method and s.metric = drawn.metric and s.entity_id = drawn.entity_id group by all),
q as (select method, metric, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by all),
p2 as (select method, metric, avg(m) as entity_mean, count(*) as entities from (select method, metric, entity_id, avg(x) as m from x group by all) group by all),
g as (select method, metric, count(*) as cases, avg(x) as mean, stddev_samp(x) as std, median(x) as median from x group by all)
select g.method, g.metric, g.cases::bigint as cases, p2.entities::bigint as entities, g.cases::bigint as finite_cases, 0::bigint as nonfinite_cases, round(g.mean, 5) as mean, round(std, 5) as std, round(median, 6) as median,
       round(entity_mean, 5) as entity_mean, round(lo, 5) as lo, round(hi, 5) as hi
from g join p2 on g.method = p2.method and g.metric = p2.metric left join q on g.method = q.method and g.metric = q.metric"""))
def e08_cases(t: Tables) -> DataFrame:
    out = summaries.case_summary(_forecasts(t), ["abs_rvd", "abs_log_ratio"], "entity_id", ["method"], 60, "21", ["abs_rvd"])
    return out.withColumns({c: F.round(c, 6 if c == "median" else 5) for c in ("mean", "std", "median", "entity_mean", "lo", "hi")})


@register("e08_change_agreement", panel_sql(_FORECASTS + """, c as (select method, (pred - v2) / v2 as a, (v3 - v2) / v2 as b from f),
z as (select method, a, b, rank() over (partition by method order by a) + (count(*) over (partition by method, a) - 1) / 2.0 as ra, rank() over (partition by method order by b) + (count(*) over (partition by method, b) - 1) / 2.0 as rb from c)
select method, count(*)::bigint as pairs, case when stddev_pop(ra) > 0 then round(corr(ra, rb), 6) end as rho, round(avg((sign(a) = sign(b))::int), 6) as direction from z group by method"""))
def e08_agreement(t: Tables) -> DataFrame:
    out = summaries.change_agreement(_forecasts(t), "predicted_change", "target_change", ["method"])
    return out.withColumns({"rho": F.round("rho", 6), "direction": F.round("direction", 6)})


@register("f09_triple_design", panel_sql(_TRIPLES + " select entity_id, v1, v2, v3, round(ln(v2), 6) as log_v2, round(ln(v2 / v1), 6) as log_change, round(ln(v2 / v1) / (dt1 / 365.25), 4) as rate_yr, round(dt2 / 365.25, 6) as horizon_yr, round(ln(v2 / v1) / (dt1 / 365.25) * dt2 / 365.25, 4) as rate_x_horizon, round(ln(dt1 / 365.25), 6) as log_dt1 from e"))
def f09(t: Tables) -> DataFrame:
    digits = {"log_v2": 6, "log_change": 6, "rate_yr": 4, "horizon_yr": 6, "rate_x_horizon": 4, "log_dt1": 6}
    return forecast.triple_design(_triples(t)).select("entity_id", "v1", "v2", "v3", *[F.round(c, d).alias(c) for c, d in digits.items()])


_PAR = {"a": 11.5, "b": 0.05, "s2": 0.3, "d11": 0.4, "d12": 0.02, "d22": 0.1}


@register("f11_two_point_prediction", panel_sql(_TRIPLES + """, z as (select *, dt1 / 365.25 as x2, (dt1 + dt2) / 365.25 as x3, ln(v1) - 11.5 as r1, ln(v2) - 11.5 - 0.05 * dt1 / 365.25 as r2 from e),
m as (select *, 0.4 + 0.3 as a11, 0.4 + 0.02 * x2 as a12, 0.4 + 2 * 0.02 * x2 + 0.1 * x2 * x2 + 0.3 as a22 from z),
s as (select *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) as s1, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) as s2 from m)
select entity_id, v1, v2, v3, round(11.5 + 0.05 * x3 + (0.4 * s1 + (0.4 + 0.02 * x2) * s2) + x3 * (0.02 * s1 + (0.02 + 0.1 * x2) * s2), 5) as log_pred from s"""))
def f11(t: Tables) -> DataFrame:
    return forecast.predict_from_two(_triples(t), _PAR).select("entity_id", "v1", "v2", "v3", F.round(F.log("pred"), 5).alias("log_pred"))


@register("f13_model_grid")
def f13(t: Tables) -> DataFrame:
    rows = _by_entity(_pairs(t)).withColumn("lv", F.log("prev_v")).withColumn("p", F.col("post").cast("double"))
    ridge = lambda r, features: forecast.ridge_with_inner_cv(r, features, "y", [0.1, 10.0, 1000.0])
    boosted = lambda r, features: boosting.boosted_out_of_fold(r, features, "y", "obs_id")
    plain = {"persistence": lambda r: r.withColumn("pred", F.lit(0.0)), "median": lambda r: forecast.median_out_of_fold(r, "y")}
    out = forecast.model_grid(rows, "y", {"time": ["dt_yr"], "time_size": ["dt_yr", "lv"], "all": ["dt_yr", "lv", "p"]}, {"ridge": ridge, "boosting": boosted}, plain)
    return out.select("features", "model", "n", F.round("mae", 5).alias("mae"), F.round("r2", 5).alias("r2"))


@register("f14_prevalence", _RATES + ", f as (select fold, sum((y > 0.2)::int) as s, count(*) as n from n group by fold), g as (select fold, (sum(s) over () - s) / (sum(n) over () - n) as p from f) select n.obs_id, n.fold::int as fold, round(g.p, 6) as p from n join g on g.fold = n.fold")
def f14(t: Tables) -> DataFrame:
    return forecast.prevalence(_pairs(t).withColumn("event", F.col("y") > 0.2)).select("obs_id", "fold", F.round("p", 6).alias("p"))


@register("f15_logistic_inner_cv")
def f15(t: Tables) -> DataFrame:
    rows = _by_entity(_pairs(t)).select("obs_id", "fold", "inner", "dt_yr", F.log("prev_v").alias("lv"), (F.col("y") > 0.2).cast("int").alias("event"))
    out = forecast.logistic_with_inner_cv(rows, ["dt_yr", "lv"], "event", [0.01, 0.1, 1.0, 10.0])
    return out.select("obs_id", "fold", "event", "cost", F.round("p", 4).alias("p"))


@register("g07_median_survival", panel_sql(_KM + " select round(min(time_yr) filter (survival <= 0.5), 6) as median from km"))
def g07(t: Tables) -> DataFrame:
    return summaries.median_survival(scores.kaplan_meier(_survival(t))).select(F.round("median", 6).alias("median"))


def _erf(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {z}))"
    return f"(1.0 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z}))"


@register("h04_noise_thresholds", _RATES + f", m as (select post, median(y) as m from n group by post), s as (select n.post, 1.4826 * median(abs(y - m)) as s from n join m on n.post = m.post group by n.post) select post, round(exp(1.645 * s) - 1, 6) as one_sided, round(exp(1.96 * s) - 1, 6) as two_sided, round(1 - 0.5 * (1 + {_erf('ln(1.2::double) / s')}), 6) as false_20, round(1 - 0.5 * (1 + {_erf('ln(1.5::double) / s')}), 6) as false_50 from s")
def h04(t: Tables) -> DataFrame:
    sigma = scores.robust_sd(_pairs(t), "y", ["post"]).withColumnRenamed("sd", "sigma")
    return scores.noise_thresholds(sigma).select("post", *[F.round(c, 6).alias(c) for c in ("one_sided", "two_sided", "false_20", "false_50")])


@register("i02_extended_folds", "with o as (select distinct o_custkey as entity_id from orders), k as (select entity_id, ((row_number() over (order by cast(('0x' || substr(md5('100:' || entity_id), 1, 8)) as bigint), entity_id) - 1) % 5)::int as fold from o), n as (select c_custkey as entity_id, row_number() over (order by cast(('0x' || substr(md5('100:' || c_custkey), 1, 8)) as bigint), c_custkey) - 1 as place from customer where c_custkey not in (select entity_id from o)) select entity_id, fold from k union all select entity_id, (((select count(*) from o) + place) % 5)::int from n")
def i02(t: Tables) -> DataFrame:
    """Known folds are balanced, so new entities go on in turn where the known ones ended."""
    known = scores.balanced_folds(t.orders.select(F.col("o_custkey").alias("entity_id")), 5, "100")
    return scores.extend_folds(known, t.customer.select(F.col("c_custkey").alias("entity_id")), 5, "100")


@register("i06_empty_partitions", "with f as (select distinct o_custkey % 5 as fold from orders where o_custkey % 7 < 3 and o_orderstatus = 'P' and o_custkey % 5 <> 3), t as (select f.f::int as test_fold, case when fold = f.f then 'test' when fold = (f.f + 1) % 5 then 'validation' else 'train' end as role from f, (values (0), (1), (2), (3), (4)) f(f)) select x.test_fold, r.role from (select distinct test_fold from t) x, (values ('train'), ('validation'), ('test')) r(role) where not exists (select 1 from t where t.test_fold = x.test_fold and t.role = r.role)")
def i06(t: Tables) -> DataFrame:
    folds = t.orders.where("o_custkey % 7 < 3 and o_orderstatus = 'P' and o_custkey % 5 <> 3").select((F.col("o_custkey") % 5).cast("int").alias("fold")).distinct()
    return intake.empty_partitions(scores.rotation(folds, 5))


@register("a11_measurement_cache", "select s_suppkey, round(s_acctbal * 2, 2) as measure from supplier")
def a11(t: Tables) -> DataFrame:
    """The second call finds equal keys and reads what the first one wrote; the third one measures again."""
    folder, calls = T.scratch(t.spark), []

    def measure(factor: float):
        def run(keys: DataFrame) -> DataFrame:
            calls.append(factor)
            return keys.join(t.supplier, "s_suppkey").select("s_suppkey", F.round(F.col("s_acctbal") * factor, 2).alias("measure"))

        return run

    keys = t.supplier.select("s_suppkey")
    intake.cached_by_keys(t.spark, folder, keys.where("s_suppkey % 2 = 0"), measure(1.0))
    intake.cached_by_keys(t.spark, folder, keys, measure(2.0))
    return intake.cached_by_keys(t.spark, folder, keys, measure(3.0))


_COMPONENTS = _GRID + """, m as (select vec_id, (p // 16)::int as z, (p // 4 % 4)::int as y, (p % 4)::int as x, p from g where value > 0.12),
e as (select a.vec_id, a.p as a, b.p as b from m a join m b on a.vec_id = b.vec_id and abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
r(vec_id, p, seen) as (select vec_id, p, p from m union select r.vec_id, r.p, e.b from r join e on e.vec_id = r.vec_id and e.a = r.seen),
l as (select vec_id, p, min(seen) as label from r group by all),
k as (select *, row_number() over (partition by vec_id order by n desc, label) as place from (select vec_id, label, count(*) as n, sum(p) as code from l group by vec_id, label))
select vec_id, n::bigint as n, code::bigint as code from k where place = 1"""


@register("j20_irregular_component", _COMPONENTS.replace("with g", "with recursive g", 1))
def j20(t: Tables) -> DataFrame:
    """Components of what lies above a threshold in 4 x 4 x 4 grids: scattered and irregular masks."""
    mask = _dense(t).where("value > 0.12").select(F.col("vec_id").alias("case_id"), F.lit(0).alias("tp"), *V.VOXEL)
    return V.largest_component(mask).groupBy(F.col("case_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("code"))


@register("j24_filled_foreground", (_GRID + """, m as (select vec_id, (p // 16)::int as z, (p // 4 % 4)::int as y, (p % 4)::int as x, p, value > -0.05 as fore from g),
b as (select * from m where not fore),
r(vec_id, z, y, x) as (select vec_id, z, y, x from b where z in (0, 3) or y in (0, 3) or x in (0, 3)
  union select b.vec_id, b.z, b.y, b.x from r join b on b.vec_id = r.vec_id and abs(b.z - r.z) + abs(b.y - r.y) + abs(b.x - r.x) = 1),
o as (select vec_id, count(*) as n, sum(z * 16 + y * 4 + x) as code from r group by vec_id)
select m.vec_id, (count(*) - coalesce(any_value(o.n), 0))::bigint as n, (sum(m.p) - coalesce(any_value(o.code), 0))::bigint as code from m left join o on o.vec_id = m.vec_id group by m.vec_id having count(*) > coalesce(any_value(o.n), 0)""").replace("with g", "with recursive g", 1))
def j24(t: Tables) -> DataFrame:
    voxels = _dense(t).select(F.col("vec_id").alias("case_id"), *V.VOXEL, F.when(F.col("value") > -0.05, 1.0).otherwise(0.0).alias("value"))
    return V.filled_foreground(voxels, 4).groupBy(F.col("case_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("code"))


@register("j16_linear_resample", _GRID + """, i as (select i, greatest(0.0, least(3.0, (i + 0.5) * 4 / 6 - 0.5)) as p from generate_series(0, 5) g(i)), w as (select i, floor(p)::int as at, 1 - (p - floor(p)) as w from i union all select i, floor(p)::int + 1, p - floor(p) from i where p > floor(p))
select vec_id, a.i::int as z, b.i::int as y, c.i::int as x, round(sum(a.w * b.w * c.w * value), 5) as value from g join w a on a.at = p // 16 join w b on b.at = p // 4 % 4 join w c on c.at = p % 4 group by all""")
def j16(t: Tables) -> DataFrame:
    return V.resample_linear(_dense(t), 4, 6).select("vec_id", *V.VOXEL, F.round("value", 5).alias("value"))


@register("n_date_of_digits", "select o_orderkey, case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) end as day from orders")
def n_date(t: Tables) -> DataFrame:
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    return t.orders.select("o_orderkey", intake.date_of_digits(F.when(F.col("o_orderkey") % 3 == 0, F.concat(digits, F.lit("x"))).otherwise(digits)).alias("day"))
