"""Queries of the longitudinal window and label operators, over orders as a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import labels as L
from panelloom.operators import windows as X
from panelloom.plans.tables import Register, Tables, panel_sql

register = Register()
queries, oracle_sql = register.queries, register.oracle_sql

_W = "partition by entity_id order by t, obs_id"
#: The panel with its predecessor, as SQL.
_LAG = f", q as (select *, lag(t) over w as pt, lag(v) over w as pv, lag(post) over w as ppost, lag(absent) over w as pabsent, lag(cls) over w as pcls, lag(obs_id) over w as pobs, row_number() over w as rn from p window w as ({_W}))"
_USABLE = "pobs is not null and not coalesce(crossed, false) and not absent and not pabsent and v > 0 and pv > 0"


def _prefix(post: bool) -> str:
    rule = " or post" if post else ""
    return (
        f", b as (select *, (coalesce(crossed, false) and row_number() over w > 1) or absent or v <= 0{rule} as broken from p window w as ({_W})),"
        f" c as (select *, max(broken::int) over ({_W} rows unbounded preceding) as stopped from b),"
        " r as (select *, count(*) over (partition by entity_id) as n from c where stopped = 0), run as (select * from r where n >= 2)"
    )


@register("triple_forecast", panel_sql(f""", k as (
  select entity_id, v as v1, lead(v) over w as v2, lead(v, 2) over w as v3, lead(t) over w - t as dt1, lead(t, 2) over w - lead(t) over w as dt2,
         coalesce(lead(crossed) over w, false) or coalesce(lead(crossed, 2) over w, false) or absent or lead(absent) over w or lead(absent, 2) over w as out
  from p window w as ({_W})
), e as (select * from k where v3 is not null and not out and dt1 > 0 and v1 > 0 and v2 > 0 and v3 > 0),
f as (
  select 'persistence' as method, v2 as pred, v2, v3 from e
  union all select 'linear', greatest(v2 + (v2 - v1) / dt1 * dt2, 0), v2, v3 from e
  union all select 'log_linear', least(v2 * exp(least(ln(v2 / v1) / dt1 * dt2, 50.0)), 1e12), v2, v3 from e
)
select method, count(*)::bigint as n, round(avg(abs(ln(greatest(pred, 1) / v3))), 6) as mean_abs_log_ratio,
       round(median(abs(pred - v3) / v3), 6) as median_abs_rvd, round(avg(case when sign(pred - v2) = sign(v3 - v2) then 1.0 else 0.0 end), 6) as direction
from f group by method"""))
def triple_forecast(t: Tables) -> DataFrame:
    """Rolling triples: persistence, linear and log-linear forecasts, their errors and a summary by method."""
    from panelloom.operators import forecast

    rows = X.tuple_table(t.panel()).where("dt1 > 0 and v1 > 0 and v2 > 0 and v3 > 0")
    errors = forecast.error_columns(forecast.trajectory_forecasts(rows))
    return errors.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("abs_log_ratio"), 6).alias("mean_abs_log_ratio"), F.round(F.median("abs_rvd"), 6).alias("median_abs_rvd"), F.round(F.avg((F.signum(F.col("pred") - F.col("v2")) == F.signum(F.col("v3") - F.col("v2"))).cast("double")), 6).alias("direction"))


@register("d01_ordinal", panel_sql(f"select entity_id, obs_id, row_number() over ({_W}) - 1 as ord, row_number() over ({_W}) = 1 as is_first from p"))
def d01(t: Tables) -> DataFrame:
    return X.ordinal(t.panel()).select("entity_id", "obs_id", F.col("ord").cast("long").alias("ord"), "is_first")


@register("d02_cumulative_time", panel_sql(f", g as (select entity_id, obs_id, t, t - lag(t) over ({_W}) as gap, row_number() over ({_W}) as rn from p) select entity_id, obs_id, sum(coalesce(gap, 0)) over ({_W} rows unbounded preceding) as elapsed, rn > 1 and (gap is null or gap <= 0) as bad_gap from g"))
def d02(t: Tables) -> DataFrame:
    return X.cumulative_time(X.with_gap(t.panel())).select("entity_id", "obs_id", "elapsed", "bad_gap")


@register("d03_since_baseline", panel_sql("select entity_id, obs_id, t - min(t) over (partition by entity_id) as since from p"))
def d03(t: Tables) -> DataFrame:
    return X.since_baseline(t.panel()).select("entity_id", "obs_id", "since")


@register("d04_transition", panel_sql(f", q as (select *, v - 150000 as x, lag(v - 150000) over ({_W}) as px, lag(post) over ({_W}) as ppost from p) select entity_id, obs_id, coalesce(px < 0 and x >= 0, false) or coalesce(not ppost and post, false) as switched from q"))
def d04(t: Tables) -> DataFrame:
    return X.transition(t.panel().withColumn("x", F.col("v") - 150000), "x", "post").select("entity_id", "obs_id", "switched")


@register("d05_noise_pairs", panel_sql(f"{_LAG} select entity_id, obs_id, post, round((t - pt) / 365.25, 6) as dt_yr, round(ln(v / pv), 6) as y, round(sqrt(v * pv), 3) as gm, cls <> pcls as cls_switch from q where {_USABLE} and post = ppost"))
def d05(t: Tables) -> DataFrame:
    return X.noise_pairs(t.panel()).select("entity_id", "obs_id", "post", F.round("dt_yr", 6).alias("dt_yr"), F.round("y", 6).alias("y"), F.round("gm", 3).alias("gm"), "cls_switch")


@register("d06_rate_pairs", panel_sql(f"{_LAG} select entity_id, obs_id, round(case when t - pt > 0 then ln(v / pv) / (t - pt) end, 8) as log_rate from q where {_USABLE}"))
def d06(t: Tables) -> DataFrame:
    return X.rate_pairs(t.panel()).select("entity_id", "obs_id", F.round("log_rate", 8).alias("log_rate"))


@register("d07_natural_pairs", panel_sql(f"{_LAG} select entity_id, obs_id, round((v - pv) / pv, 6) as rel, round(case when t > pt then ln(v / pv) / ((t - pt) / 365.25) end, 6) as rate_yr from q where {_USABLE} and not post and not ppost"))
def d07(t: Tables) -> DataFrame:
    return X.natural_pairs(t.panel()).select("entity_id", "obs_id", F.round("rel", 6).alias("rel"), F.round("rate_yr", 6).alias("rate_yr"))


@register("d08_rolling_tuples", panel_sql(f", k as (select entity_id, obs_id || '__' || lead(obs_id) over w || '__' || lead(obs_id, 2) over w as tuple_id, lead(crossed) over w is null or lead(crossed, 2) over w is null as unknown from p window w as ({_W})) select * from k where tuple_id is not null"))
def d08(t: Tables) -> DataFrame:
    return X.exclusion_reasons(X.rolling_tuples(t.panel())).select("entity_id", "tuple_id", "unknown")


_REASONS = f""", k as (
  select entity_id, obs_id || '__' || lead(obs_id) over w || '__' || lead(obs_id, 2) over w as tuple_id,
         concat_ws(';', case when coalesce(lead(crossed) over w, false) or coalesce(lead(crossed, 2) over w, false) then 'intervention' end,
                        case when absent or lead(absent) over w or lead(absent, 2) over w then 'absent' end) as reasons
  from p window w as ({_W})
), x as (select * from k where tuple_id is not null)"""


@register("d09_exclusion_reasons", panel_sql(_REASONS + " select * from x"))
def d09(t: Tables) -> DataFrame:
    return X.exclusion_reasons(X.rolling_tuples(t.panel())).select("entity_id", "tuple_id", F.concat_ws(";", "reasons").alias("reasons"))


@register("e20_reason_counts", panel_sql(_REASONS + " select reason, count(*)::bigint as n from (select unnest(string_split(reasons, ';')) as reason from x where reasons <> '') group by reason"))
def e20(t: Tables) -> DataFrame:
    rows = X.exclusion_reasons(X.rolling_tuples(t.panel()))
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_TABLE = f""", k as (
  select entity_id, v as v1, lead(v) over w as v2, lead(v, 2) over w as v3, lead(t) over w - t as dt1, lead(t, 2) over w - lead(t) over w as dt2,
         post::int + (lead(post) over w)::int + (lead(post, 2) over w)::int as n_post, lead(crossed) over w is null or lead(crossed, 2) over w is null as unknown,
         coalesce(lead(crossed) over w, false) or coalesce(lead(crossed, 2) over w, false) or absent or lead(absent) over w or lead(absent, 2) over w as out
  from p window w as ({_W})
), x as (select *, case n_post when 0 then 'all_pre' when 3 then 'all_post' else 'mixed' end as state from k where v3 is not null and not out)"""


@register("d10_tuple_table", panel_sql(_TABLE + " select entity_id, v1, v2, v3, dt1, dt2, state, unknown from x"))
def d10(t: Tables) -> DataFrame:
    return X.tuple_table(t.panel()).drop("tuple_id")


@register("e25_composition", panel_sql(_TABLE + " select state, count(*)::bigint as tuples, count(distinct entity_id)::bigint as entities from x group by state"))
def e25(t: Tables) -> DataFrame:
    return X.tuple_table(t.panel()).groupBy("state").agg(F.count(F.lit(1)).alias("tuples"), F.countDistinct("entity_id").alias("entities"))


@register("d11_initial_run", panel_sql(_prefix(True) + " select entity_id, obs_id, n::bigint as run_length from run"))
def d11(t: Tables) -> DataFrame:
    return X.initial_run(t.panel()).select("entity_id", "obs_id", "run_length")


@register("d12_eligible_points", panel_sql(_prefix(False) + f" select entity_id, obs_id, round((t - first_value(t) over ({_W})) / 365.25, 6) as t_years, round(ln(v), 6) as log_v from run"))
def d12(t: Tables) -> DataFrame:
    run = X.initial_run(t.panel(), stop_at_post=False)
    return run.select("entity_id", "obs_id", F.round((F.col("t") - F.first("t").over(X.SO_FAR())) / 365.25, 6).alias("t_years"), F.round(F.log("v"), 6).alias("log_v"))


@register("d13_usable_samples", panel_sql(_prefix(True) + ", l as (select distinct entity_id, n from r) select k::int as k, count(*)::bigint as entities, sum(n - k + 1)::bigint as samples from l, (values (2), (3), (4)) v(k) where n >= k group by k"))
def d13(t: Tables) -> DataFrame:
    return X.usable_samples(X.initial_run(t.panel(), at_least=1).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")))


_RUNS = f", u as (select *, not absent and v > 0 as usable, sum((coalesce(crossed, false) or absent or v <= 0)::int) over ({_W} rows unbounded preceding) as run_id from p), s as (select * from u where usable)"


@register("d14_restartable_runs", panel_sql(_RUNS + " select entity_id, obs_id, run_id::bigint as run_id from s"))
def d14(t: Tables) -> DataFrame:
    return X.restartable_runs(t.panel()).select("entity_id", "obs_id", "run_id")


@register("d15_history_features", panel_sql(_RUNS + """, h as (
  select entity_id, obs_id, row_number() over w - 1 as n_prior, row_number() over w > 1 as has_prev,
         coalesce(case when t > lag(t) over w then ln(v / lag(v) over w) / ((t - lag(t) over w) / 365.25) end, 0) as last_rate,
         (t - first_value(t) over w) / 365.25 as span, (lead(t) over w - t) / 365.25 as horizon, ln(lead(v) over w / v) as y
  from s window w as (partition by entity_id, run_id order by t, obs_id)
) select entity_id, obs_id, n_prior::int as n_prior, has_prev, round(last_rate, 5) as last_rate_yr, round(span, 6) as t_run_yr, round(horizon, 6) as horizon_yr, round(last_rate * horizon, 5) as last_rate_x_horizon, round(y, 6) as y
from h where y is not null and horizon > 0"""))
def d15(t: Tables) -> DataFrame:
    rows = X.history_features(X.restartable_runs(t.panel()))
    return rows.select("entity_id", "obs_id", "n_prior", "has_prev", F.round("last_rate_yr", 5).alias("last_rate_yr"), F.round("t_run_yr", 6).alias("t_run_yr"), F.round("horizon_yr", 6).alias("horizon_yr"), F.round("last_rate_x_horizon", 5).alias("last_rate_x_horizon"), F.round("y", 6).alias("y"))


@register("d16_expanding_slope", panel_sql(_RUNS + """, h as (
  select entity_id, run_id, obs_id, t, (t - first_value(t) over w) / 365.25 as x, ln(v) as l, lead(t) over w - t as horizon from s window w as (partition by entity_id, run_id order by t, obs_id)
), z as (select *, regr_slope(l, x) over (partition by entity_id, run_id order by t, obs_id rows unbounded preceding) as slope from h)
select entity_id, obs_id, round(coalesce(case when isfinite(slope) then slope end, 0), 4) as run_rate_yr from z where horizon > 0"""))
def d16(t: Tables) -> DataFrame:
    rows = X.history_features(X.restartable_runs(t.panel()))
    return rows.select("entity_id", "obs_id", F.round("run_rate_yr", 4).alias("run_rate_yr"))


_EVENTS = _prefix(True) + f""", i as (
  select entity_id, obs_id, t, v, lead(v) over w as vn, lead(t) over w - t as horizon_days from run window w as ({_W})
), j as (select *, (vn - v) / v >= 0.2 and vn - v >= 1000 as event, (v - vn) / vn >= 0.2 and v - vn >= 1000 as shrink from i),
ev as (select *, coalesce(max(event::int) over ({_W} rows between unbounded preceding and 1 preceding), 0) = 1 as prior_growth from j)"""


@register("d17_event_intervals", panel_sql(_EVENTS + " select entity_id, obs_id, horizon_days, event, shrink as mirrored_shrink, prior_growth from ev where vn is not null"))
def d17(t: Tables) -> DataFrame:
    return X.event_intervals(X.initial_run(t.panel()), 0.2, 1000.0).select("entity_id", "obs_id", "horizon_days", "event", "mirrored_shrink", "prior_growth")


@register("g11_purity", panel_sql(_EVENTS + " select sum(event::int)::bigint as events, sum(shrink::int)::bigint as shrinks, round(sum(shrink::int) / greatest(sum(event::int), 1)::double, 6) as ratio from ev where vn is not null"))
def g11(t: Tables) -> DataFrame:
    rows = X.event_intervals(X.initial_run(t.panel()), 0.2, 1000.0)
    n, s = F.sum(F.col("event").cast("int")), F.sum(F.col("mirrored_shrink").cast("int"))
    return rows.agg(n.alias("events"), s.alias("shrinks"), F.round(s / F.greatest(n, F.lit(1)), 6).alias("ratio"))


SURVIVAL_SQL = _prefix(True) + f""", f as (select *, (t - first_value(t) over ({_W})) / 365.25 as years, first_value(v) over ({_W}) as v0 from run),
sv as (
  select entity_id, greatest(coalesce(min(years) filter ((v - v0) / v0 >= 0.2 and v - v0 >= 0), max(years)), 1e-3) as time_yr,
         (count(*) filter ((v - v0) / v0 >= 0.2 and v - v0 >= 0) > 0)::int as event, ln(max(v0)) as log_v0, count(*)::bigint as n_obs
  from f group by entity_id
)"""


@register("d18_survival", panel_sql(SURVIVAL_SQL + " select entity_id, round(time_yr, 6) as time_yr, event, round(log_v0, 6) as log_v0, n_obs from sv"))
def d18(t: Tables) -> DataFrame:
    return X.survival(X.initial_run(t.panel()), 0.2).select("entity_id", F.round("time_yr", 6).alias("time_yr"), "event", F.round("log_v0", 6).alias("log_v0"), "n_obs")


@register("d19_first_rows", panel_sql(f"select entity_id, obs_id, v from (select *, row_number() over ({_W}) as rn from p where not post) where rn = 1"))
def d19(t: Tables) -> DataFrame:
    return X.first_rows(t.panel().where("not post")).select("entity_id", "obs_id", "v")


@register("d20_month_fraction", f"""with o as (select o_custkey as entity_id, o_orderkey as obs_id, cast(o_orderdate as date) as d from orders),
f as (select *, first_value(d) over (partition by entity_id order by d, obs_id) as s from o)
select entity_id, obs_id, round(least((year(d) - year(s)) * 12 + month(d) - month(s) + (day(d) - day(s)) / 30.0, 95.0), 6) as months from f""")
def d20(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("obs_id"), F.to_date("o_orderdate").alias("t"))
    return X.month_fraction(rows, "t").select("entity_id", "obs_id", F.round("months", 6).alias("months"))


@register("d21_interval_ratio", panel_sql(_TABLE + " select entity_id, v1, v2, v3, round(case when dt1 > 0 then dt2 / dt1 end, 6) as ratio from x"))
def d21(t: Tables) -> DataFrame:
    return X.tuple_table(t.panel()).select("entity_id", "v1", "v2", "v3", F.round(F.when(F.col("dt1") > 0, F.col("dt2") / F.col("dt1")), 6).alias("ratio"))


@register("d22_temporal_encoding", panel_sql(_LAG + ", e as (select entity_id, obs_id, pi() * (t - pt) / 365.0 as w from q where pobs is not null) select entity_id, obs_id, round(sin(w), 6) as s0, round(cos(w), 6) as c0, round(sin(2 * w), 6) as s1, round(cos(2 * w), 6) as c1 from e"))
def d22(t: Tables) -> DataFrame:
    rows = X.consecutive(t.panel(), ["t"]).withColumn("e", X.temporal_encoding(F.col("t") - F.col("prev_t"), 2, 365.0))
    return rows.select("entity_id", "obs_id", *[F.round(F.get("e", i), 6).alias(n) for i, n in enumerate(("s0", "c0", "s1", "c1"))])


@register("d23_anchored_tuples", panel_sql(f", o as (select entity_id, obs_id, row_number() over ({_W}) - 1 as ord from p) select c.entity_id, a.obs_id as a, b.obs_id as b, c.obs_id as c from o c join o a on a.entity_id = c.entity_id and a.ord = 0 join o b on b.entity_id = c.entity_id and b.ord = 1 where c.ord >= 2"))
def d23a(t: Tables) -> DataFrame:
    return X.anchored_tuples(t.panel())


@register("d23_ordered_combinations", f"with o as (select conv_id as entity_id, turn as obs_id, row_number() over (partition by conv_id order by turn) - 1 as ord from conversations) select a.entity_id, a.obs_id as a, b.obs_id as b, c.obs_id as c from o a join o b on a.entity_id = b.entity_id and a.ord < b.ord join o c on b.entity_id = c.entity_id and b.ord < c.ord")
def d23b(t: Tables) -> DataFrame:
    return X.ordered_combinations(t.conversations.select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("obs_id"), F.col("turn").alias("t")))


# Labels


@register("b21_interval_class", panel_sql(_LAG + " select entity_id, obs_id, case when v < 100000 and pv < 100000 then 'both_small' when v >= 100000 and pv >= 100000 then 'both_large' else 'mixed' end as size_class from q where pobs is not null"))
def b21(t: Tables) -> DataFrame:
    rows = X.consecutive(t.panel(), ["v"])
    return rows.select("entity_id", "obs_id", L.both_ends("v", "prev_v", 100000.0).alias("size_class"))


@register("b22_cut", panel_sql("select case when v > 0 and v <= 50000 then 'low' when v > 50000 and v <= 150000 then 'mid' when v > 150000 and v <= 300000 then 'high' else 'nan' end as bin, count(*)::bigint as n from p group by 1"))
def b22(t: Tables) -> DataFrame:
    return t.panel().groupBy(F.coalesce(L.cut(F.col("v"), [0, 50000, 150000, 300000], ["low", "mid", "high"]), F.lit("nan")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("b23_qcut", panel_sql(", e as (select quantile_cont(v, 1/3.0) as a, quantile_cont(v, 2/3.0) as b from p) select case when v <= a then 'small' when v <= b then 'medium' else 'large' end as bin, count(*)::bigint as n, min(v) as lo, max(v) as hi from p, e group by 1"))
def b23(t: Tables) -> DataFrame:
    return L.qcut(t.panel(), "v", ["small", "medium", "large"], "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


_GRID = "(values ('rel20', 0.2, 0.2, 0.0), ('rel20_abs', 0.2, 0.2, 5000.0), ('rel50', 0.5, 0.5, 0.0), ('stratified', 0.8, 0.2, 0.0)) g(name, below, above, flr)"


@register("b25_threshold_grid", panel_sql(_LAG + f", n as (select * from q where {_USABLE} and not post and not ppost) select name, count(*)::bigint as n, sum(((v - pv) / pv >= (case when pv < 100000 then below else above end) and v - pv >= flr)::int)::bigint as events from n, {_GRID} group by name"))
def b25(t: Tables) -> DataFrame:
    pairs = X.consecutive(t.panel(), ["t", "v", "absent", "post"]).where("not coalesce(crossed, false) and not absent and not prev_absent and v > 0 and prev_v > 0 and not post and not prev_post")
    grid = [("rel20", 0.2, 0.2, 0.0), ("rel20_abs", 0.2, 0.2, 5000.0), ("rel50", 0.5, 0.5, 0.0), ("stratified", 0.8, 0.2, 0.0)]
    return L.threshold_grid(pairs, grid, 100000.0).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("int")).alias("events"))


@register("b26_annualised", panel_sql(_LAG + f", n as (select *, (t - pt) / 365.25 as yr from q where {_USABLE} and t > pt) select sum(((v - pv) / yr >= 50000)::int)::bigint as abs_50k, sum(((v - pv) / yr >= 100000)::int)::bigint as abs_100k, sum((pow(v / pv, 1 / yr) - 1 >= 0.1)::int)::bigint as rel_10, sum((pow(v / pv, 1 / yr) - 1 >= 0.3)::int)::bigint as rel_30 from n"))
def b26(t: Tables) -> DataFrame:
    pairs = X.consecutive(t.panel(), ["t", "v", "absent"]).where("not coalesce(crossed, false) and not absent and not prev_absent and v > 0 and prev_v > 0 and t > prev_t")
    ends = L.annualised(pairs, absolute={"abs_50k": 50000.0, "abs_100k": 100000.0}, relative={"rel_10": 0.1, "rel_30": 0.3})
    return ends.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("abs_50k", "abs_100k", "rel_10", "rel_30")])


@register("b27_change_class", panel_sql(_LAG + " select case when (v - pv) / pv > 0.2 then 'growing' when (v - pv) / pv < -0.2 then 'shrinking' else 'stable' end as change, count(*)::bigint as n from q where pobs is not null and pv > 0 group by 1"))
def b27(t: Tables) -> DataFrame:
    rows = X.consecutive(t.panel(), ["v"]).where("prev_v > 0")
    return rows.groupBy(L.change_class((F.col("v") - F.col("prev_v")) / F.col("prev_v"), 0.2).alias("change")).agg(F.count(F.lit(1)).alias("n"))


@register("b28_anomaly", panel_sql(_LAG + " select sum((abs(ln(v / pv)) > ln(8))::int)::bigint as anomalies, sum(((v - pv) / pv > 5 or (v - pv) / pv < -0.9)::int)::bigint as extremes from q where pobs is not null and pv > 0 and v > 0"))
def b28(t: Tables) -> DataFrame:
    rows = X.consecutive(t.panel(), ["v"]).where("prev_v > 0 and v > 0")
    return rows.agg(F.sum(L.anomalous(F.log(F.col("v") / F.col("prev_v"))).cast("int")).alias("anomalies"), F.sum(L.extreme((F.col("v") - F.col("prev_v")) / F.col("prev_v")).cast("int")).alias("extremes"))


@register("b29_b30_b31_rows", f"with o as (select l_orderkey, l_linenumber, greatest(l_quantity, l_extendedprice / 1000) as widest, case when l_discount <> 0 then (l_tax - l_discount) / l_discount else 'nan'::double end as rel from lineitem where l_quantity is not null and l_extendedprice is not null) select l_linenumber, count(*)::bigint as n, round(max(widest), 6) as widest, count(*) filter (isnan(rel))::bigint as undefined, round(avg(rel) filter (not isnan(rel)), 6) as mean_rel from o group by l_linenumber")
def b29(t: Tables) -> DataFrame:
    rows = t.lineitem.na.drop(subset=["l_quantity", "l_extendedprice"])
    rows = rows.select("l_linenumber", F.greatest("l_quantity", F.col("l_extendedprice") / 1000).alias("widest"), L.relative_change("l_discount", "l_tax").alias("rel"))
    return rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("widest"), 6).alias("widest"), F.count_if(F.isnan("rel")).alias("undefined"), F.round(F.avg(F.when(~F.isnan("rel"), F.col("rel"))), 6).alias("mean_rel"))
