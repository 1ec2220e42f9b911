"""Queries of scans and sinks, row checks, cohort and review tables, intervals, padded grids and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.seed import keyed_order
from panelloom.operators import estimates as E
from panelloom.operators import review as R
from panelloom.operators import voxel as V
from panelloom.plans.panel_queries import SURVIVAL_SQL
from panelloom.plans.score_queries import _RATES, _S, _pairs, _survival, draws_sql
from panelloom.plans.tables import Register, Tables, panel_sql
from panelloom.plans.voxel_queries import _M, _OVERLAP
from panelloom.sources import tables as T
from panelloom.streaming import incremental

register = Register()
queries, oracle_sql = register.queries, register.oracle_sql


@register("a02_attribute_table", "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def a02(t: Tables) -> DataFrame:
    folder = T.scratch(t.spark)
    t.customer.select("c_custkey", "c_name", "c_mktsegment").write.csv(folder, header=True, sep="\t")
    return T.read_attributes(t.spark, folder, tab_separated=True)


@register("a03_file_index")
def a03(t: Tables) -> DataFrame:
    table = F.regexp_extract("path", r"([a-z]+)\.parquet", 1)
    return T.file_index(t.spark, t.folder, "*.parquet").groupBy(table.alias("table")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@register("a04_layout", "with x as (select regexp_extract(url, '^https?://([^/]+)/', 1) as host, try_cast(regexp_extract(url, '/(\\d+)(?:$|[?#])', 1) as bigint) as number from pages) select nullif(host, '') as host, count(*)::bigint as files, count(number)::bigint as numbered, count(*) filter (number % 2 = 0)::bigint as even from x group by 1")
def a04(t: Tables) -> DataFrame:
    rows = T.layout(t.pages.select("url"), "url", {"host": r"^https?://([^/]+)/", "number": r"/(\d+)(?:$|[?#])"})
    number = F.col("number").cast("long")
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("files"), F.count(number).alias("numbered"), F.count_if(number % 2 == 0).alias("even"))


@register("a06_a12_fold_results", "select o_orderkey, round(o_totalprice, 2) as score, (o_custkey % 5)::int as fold from orders")
def a06(t: Tables) -> DataFrame:
    folder = T.scratch(t.spark)
    T.write_folds(t.orders.select("o_orderkey", F.round("o_totalprice", 2).alias("score"), (F.col("o_custkey") % 5).cast("int").alias("fold")), folder)
    return T.read_folds(t.spark, folder, "o_orderkey long, score double")


@register("a14_summary_lines", "select printf('%s: n=%d, priorities=%d', o_orderstatus, count(*), count(distinct o_orderpriority)) as line from orders group by o_orderstatus")
def a14(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("k"))
    return per.select(T.summary_line("%s: n=%d, priorities=%d", F.col("o_orderstatus"), F.col("n"), F.col("k")).alias("line"))


@register("a15_public_table", "select c_mktsegment, c_nationkey, round(c_acctbal, 2) as c_acctbal from customer")
def a15(t: Tables) -> DataFrame:
    return T.public_columns(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal")), ["c_custkey", "c_name"])


@register("a16_status_tables", "select case when o_totalprice < 1000 then 'failed' when o_orderpriority = '5-LOW' then 'excluded' else 'done' end as status, count(*)::bigint as n, min(o_orderkey) as first_key from orders group by 1")
def a16(t: Tables) -> DataFrame:
    folder = T.scratch(t.spark)
    status = F.when(F.col("o_totalprice") < 1000, "failed").when(F.col("o_orderpriority") == "5-LOW", "excluded").otherwise("done")
    T.write_by_status(t.orders.select("o_orderkey", status.alias("status")), folder)
    return t.spark.read.parquet(folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@register("a18_role_lists", "select c_custkey::varchar as entity_id, case when c_custkey % 5 = 0 then 'test' when c_custkey % 5 = 1 then 'validation' else 'train' end as role from customer")
def a18(t: Tables) -> DataFrame:
    folder = T.scratch(t.spark)
    m = F.col("c_custkey") % 5
    T.write_roles(t.customer.select(F.col("c_custkey").alias("entity_id"), F.when(m == 0, "test").when(m == 1, "validation").otherwise("train").alias("role")), folder)
    return T.read_roles(t.spark, folder)


@register("b08_required_flag", "select o_orderkey, o_orderstatus = 'F' as closed from orders")
def b08(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.required_flag(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no")).alias("closed"))


@register("b13_resolve_path", "with x as (select page_id, case when page_id % 2 = 0 then '/' else '' end || regexp_replace(url, '^https?://', '') as path from pages) select page_id, case when path like '/%' then path else '/data/' || path end as path from x")
def b13(t: Tables) -> DataFrame:
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/").otherwise(""), F.regexp_replace("url", "^https?://", ""))
    return t.pages.select("page_id", R.resolve_path(path, "/data").alias("path"))


@register("b14_absent_files", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def b14(t: Tables) -> DataFrame:
    return R.absent_files(t.part.select("p_partkey"), t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@register("b16_b17_pair_counters", panel_sql(", l as (select l_orderkey as obs_id, count(*) filter (l_returnflag = 'R') as voxels, max(l_linenumber) = count(*) as same from lineitem group by 1), x as (select coalesce(voxels, 0) as voxels, coalesce(absent, false) as absent, coalesce(same, false) as same from p left join l using (obs_id)) select count(*)::bigint as pairs, count(*) filter (absent)::bigint as declared_absent, count(*) filter (voxels = 0)::bigint as empty, count(*) filter (voxels = 0 and not absent)::bigint as undeclared_empty, count(*) filter (not same)::bigint as size_errors from x"))
def b16(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("obs_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("voxels"), (F.max("l_linenumber") == F.count(F.lit(1))).alias("size_matches"))
    return R.pair_counters(t.panel().withColumnRenamed("absent", "declared_absent").join(lines, "obs_id", "left"))


@register("b19_case_gate", "with x as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings) select vec_id, concat_ws(';', case when e[1] < -0.1 or e[3] < -0.1 then 'overlap' end, case when e[4] > 0.2 or e[5] > 0.2 then 'border' end) as reasons from x")
def b19(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    return t.embeddings.select("vec_id", F.concat_ws(";", R.case_gate(F.slice(e, 1, 3), F.transform(F.slice(e, 4, 2), lambda v: v > 0.2), -0.1)).alias("reasons"))


@register("b20_row_flags", "with x as (select event_id, value, event_type from events) select event_id, case when event_id % 7 = 0 then null else round(least(value, value + 2), 6) end as overlap, case when event_id % 3 = 0 then array_to_string(list_sort(list_distinct([event_type, 'late'])), ';') else event_type end as flags from x")
def b20(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.to_json(F.array(F.col("value") + 2, F.lit(-9.0), F.col("value"))))
    least = R.least_overlap(text)
    flags = R.merged_flags(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("late;"), "event_type")))
    return t.events.select("event_id", F.when(least < float("inf"), F.round(least, 6)).alias("overlap"), F.concat_ws(";", flags).alias("flags"))


@register("e16_e17_bootstrap_auc", _S + """, b as (select doc_id % 40 as entity_id, y, p from s),
""" + draws_sql("b", "5", 100) + """,
g as (select r as replicate, p, sum(times * y) as pos, sum(times * (1 - y)) as neg from b join drawn using (entity_id) group by all),
r as (select *, coalesce(sum(neg) over (partition by replicate order by p rows between unbounded preceding and 1 preceding), 0) as below from g),
a as (select replicate, sum(pos * (below + neg / 2.0::double)) / (sum(pos) * sum(neg)) as auc from r group by replicate having sum(pos) * sum(neg) > 0)
select count(*)::bigint as replicates, round(case when count(*) > 50 then quantile_cont(auc, 0.025) end, 6) as lo, round(case when count(*) > 50 then quantile_cont(auc, 0.975) end, 6) as hi from a""")
def e16(t: Tables) -> DataFrame:
    cases = t.scored().withColumn("block", F.col("doc_id") % 40)
    return E.bootstrap_auc(cases, "block", 100, "5").select("replicates", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("f19_fold_diagnostics", _RATES + ", f as (select fold, count(*) as n, sum(y) as s from n group by fold) select fold::int as fold, (sum(n) over () - n)::bigint as n_train, n::bigint as n_test, round((sum(s) over () - s) / (sum(n) over () - n), 6) as train_mean from f")
def f19(t: Tables) -> DataFrame:
    return R.fold_diagnostics(_pairs(t), "y").select("fold", "n_train", "n_test", F.round("train_mean", 6).alias("train_mean"))


@register("g04_calibration_line")
def g04(t: Tables) -> DataFrame:
    return E.calibration_line(t.scored()).select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@register("g08_survival_by_tertile", panel_sql(SURVIVAL_SQL + """, e as (select quantile_cont(v0, 1 / 3.0::double) as a, quantile_cont(v0, 2 / 3.0::double) as b from (select round(log_v0, 6) as v0 from sv)),
x as (select time_yr, event, (round(log_v0, 6) > e.a)::int + (round(log_v0, 6) > e.b)::int as stratum from sv, e), per as (select stratum, time_yr, count(*) as n, sum(event) as events from x group by all),
kr as (select *, sum(n) over (partition by stratum order by time_yr desc) as at_risk from per),
km as (select stratum, time_yr, case when max((events = at_risk)::int) over w = 1 then 0.0 else exp(sum(case when events < at_risk then ln(1 - events / at_risk) else 0 end) over w) end as survival from kr window w as (partition by stratum order by time_yr rows unbounded preceding))
select stratum, y.year::double as year, round(coalesce(arg_max(survival, time_yr) filter (time_yr <= y.year), 1.0), 6) as survival from km, (values (1), (3)) y(year) group by all"""))
def g08(t: Tables) -> DataFrame:
    rows = _survival(t).withColumn("log_v0", F.round("log_v0", 6))
    return E.survival_by_quantile(rows, "log_v0", 3, [1, 3]).select("stratum", "year", F.round("survival", 6).alias("survival"))


@register("h05_consensus", "with s as (select l_returnflag, stddev_samp(l_discount) as a, stddev_samp(l_tax) as b, stddev_samp(l_quantity / 100) as c from lineitem group by 1), m as (select l_returnflag, list_sort([a, b, c])[2] as m from s) select l_returnflag, round(m, 6) as pair_sigma, round(m / sqrt(2), 6) as single_sigma, round(100 * sqrt(exp(m * m / 2) - 1), 4) as variation from m")
def h05(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_returnflag").agg(F.stddev_samp("l_discount").alias("a"), F.stddev_samp("l_tax").alias("b"), F.stddev_samp(F.col("l_quantity") / 100).alias("c")).withColumn("m", E.consensus(F.col("a"), F.col("b"), F.col("c")))
    single = E.single_measure(F.col("m"))
    return rows.select("l_returnflag", F.round("m", 6).alias("pair_sigma"), F.round(single, 6).alias("single_sigma"), F.round(E.variation_percent(single), 4).alias("variation"))


@register("h06_stratified_noise", _RATES + """, x as (select 'state' as label, case when post then 'post' else 'pre' end as stratum, entity_id, y from n union all select 'interval', case when dt_yr < 1 then 'short' else 'long' end, entity_id, y from n),
m as (select label, stratum, median(y) as m from x group by all)
select label, stratum, count(*)::bigint as n, count(distinct entity_id)::bigint as entities, round(1.4826 * median(abs(y - m)), 6) as sd from x join m using (label, stratum) group by all having count(distinct entity_id) >= 10""")
def h06(t: Tables) -> DataFrame:
    strata = {"state": F.when(F.col("post"), "post").otherwise("pre"), "interval": F.when(F.col("dt_yr") < 1, "short").otherwise("long")}
    return E.stratified_noise(_pairs(t), "y", strata).select("label", "stratum", "n", "entities", F.round("sd", 6).alias("sd"))


@register("h07_resampling", _M + """, r as (select i, floor((i + 0.5) * 12 / 8)::int as s from generate_series(0, 7) g(i)),
a as (select case_id, tp, count(*) as n from m group by all), b as (select m.case_id, m.tp, count(*) * 3.375::double as n from m join r rz on rz.s = m.z join r ry on ry.s = m.y join r rx on rx.s = m.x group by all),
l as (select ln(b.n / a.n) as r from a join b using (case_id, tp))
select count(*)::bigint as n, round(avg(r), 6) as mean, round(stddev_samp(r), 6) as sd, round(quantile_cont(r, 0.05), 6) as p05, round(quantile_cont(r, 0.95), 6) as p95 from l having count(*) >= 10""")
def h07(t: Tables) -> DataFrame:
    m = t.spheres()
    native = V.volumes(m, 1.0).select("case_id", "tp", F.col("volume").alias("native"))
    resampled = V.volumes(V.resample_nearest(m, 12, 8), 1.5**3).select("case_id", "tp", F.col("volume").alias("resampled"))
    out = E.log_ratio_summary(native.join(resampled, ["case_id", "tp"]), F.col("resampled"), F.col("native"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p05", "p95")])


@register("j10b_pad", _M + "select case_id, tp, 16 as size, count(*)::bigint as voxels, min(z + 2)::int as first_z, max(x + 2)::int as last_x from m group by all")
def j10b(t: Tables) -> DataFrame:
    return E.pad(t.spheres(), 12, 9, 8).groupBy("case_id", "tp", "size").agg(F.count(F.lit(1)).alias("voxels"), F.min("z").alias("first_z"), F.max("x").alias("last_x"))


@register("j14_evaluate", f"select 'first' as method, * from ({_OVERLAP.format(a=0, b=2)}) union all select 'stable' as method, * from ({_OVERLAP.format(a=1, b=2)})")
def j14(t: Tables) -> DataFrame:
    m = t.spheres()
    rows = E.evaluate({"first": m.where("tp = 0"), "stable": m.where("tp = 1")}, m.where("tp = 2"))
    return rows.select("method", "case_id", "n_a", "n_b", F.round("dice", 6).alias("dice"), F.round("signed_rvd", 6).alias("signed_rvd"))


@register("j21b_merge_tiles", """with g as (select vec_id, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as place from embeddings),
x as (select vec_id, place, value + s.s as value, exp(-0.5 * pow((place - s.s - 8) / 2.0::double, 2)) as w from g, (select unnest(generate_series(0, 48, 8)) as s) s where place between s.s and s.s + 15)
select vec_id, place::int as place, round(sum(w * value) / sum(w), 6) as value from x group by all""")
def j21b(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("place", "v")).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(8)))).withColumn("offset", F.col("place") - F.col("start"))
    tiles = rows.where("offset between 0 and 15").withColumn("value", F.col("v").cast("double") + F.col("start"))
    return E.merge_tiles(tiles, "vec_id", 16).select("vec_id", "place", F.round("value", 6).alias("value"))


@register("k01_freeze", _S + "select (cast(('0x' || substr(md5('9:' || entity_id), 1, 8)) as bigint) % 5)::int as fold, count(*)::bigint as cases, count(distinct entity_id)::bigint as entities from s where y = 1 group by 1")
def k01(t: Tables) -> DataFrame:
    cases = t.scored().drop("fold").dropDuplicates(["doc_id"])
    folds = cases.select("entity_id").distinct().withColumn("fold", (keyed_order("9", F.col("entity_id")) % 5).cast("int"))
    return R.fold_counts(R.freeze(cases, folds, F.col("y") == 1, "doc_id", 5))


@register("k03_decisions", "select case when o_orderpriority = '5-LOW' then 'blank' when o_orderstatus in ('F', 'O') then o_orderstatus else 'invalid' end as decision, count(*)::bigint as n from orders group by 1")
def k03(t: Tables) -> DataFrame:
    rows = t.orders.select(F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderstatus")).alias("d"))
    return R.decision_counts(rows, "d", ["F", "O"])


@register("k05_opaque_ids", "select 'qc-' || substr(sha256('{\"view\": \"mid\"}'), 1, 8) || '-' || lpad(row_number() over (order by c_acctbal desc, c_custkey)::varchar, 3, '0') as opaque_id, c_mktsegment from customer order by c_acctbal desc, c_custkey limit 100")
def k05(t: Tables) -> DataFrame:
    chosen = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).withColumn("worst", -F.col("c_acctbal"))
    return T.public_columns(R.opaque_ids(chosen, ["worst", "c_custkey"], {"view": "mid"}).select("opaque_id", "c_custkey", "c_mktsegment"), ["c_custkey"])


@register("k07_reconcile", "select count(*) filter (o_orderstatus = 'F')::bigint as selected, count(*) filter (o_orderstatus = 'O')::bigint as failed, count(*) filter (o_orderstatus in ('F', 'O'))::bigint as reviewed, true as balanced from orders")
def k07(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return R.reconcile(t.orders, s == "F", s == "O", s.isin("F", "O"))


@register("k08_run_record")
def k08(t: Tables) -> DataFrame:
    return R.run_record(t.spark, {"seed": 100, "folds": 5}, {"nation": t.nation, "supplier": t.supplier})


@register("l07_natural_order", "select c_custkey, 'v' || lpad((c_custkey % 1000)::varchar, 20, '0') || '-' || lpad(c_nationkey::varchar, 20, '0') || 'x' as natural from customer")
def l07(t: Tables) -> DataFrame:
    name = F.concat(F.lit("v"), (F.col("c_custkey") % 1000).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("x"))
    return t.customer.select("c_custkey", R.natural_key(name).alias("natural"))


@register("o01_process_new", "select o_orderkey, round(o_totalprice / 2, 4) as half from orders where o_orderstatus = 'F'")
def o01(t: Tables) -> DataFrame:
    folder = T.scratch(t.spark)
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(f"{folder}/in")
    halve = lambda df: df.where("o_orderstatus = 'F'").select("o_orderkey", F.round(F.col("o_totalprice") / 2, 4).alias("half"))
    return incremental.process_new(t.spark, f"{folder}/in", "o_orderkey long, o_orderstatus string, o_totalprice double", halve, f"{folder}/out", f"{folder}/progress")


@register("o02_completed_keys", "select user_id % 7 as cohort, count(distinct user_id)::bigint as completed from events group by 1")
def o02(t: Tables) -> DataFrame:
    folder = T.scratch(t.spark)
    t.events.select("user_id", (F.col("user_id") % 7).alias("cohort")).write.parquet(f"{folder}/in")
    return incremental.completed_keys(t.spark, f"{folder}/in", "user_id long, cohort long", "user_id", "cohort", f"{folder}/out", f"{folder}/progress")
