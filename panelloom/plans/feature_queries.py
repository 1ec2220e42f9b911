"""Queries of stem pairing, review selection, checked folds, streamed runs, mergeable sketches and three-axis tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import estimates, sketches, tabulate, tiles
from panelloom.operators import review as R
from panelloom.plans.panel_queries import _RUNS
from panelloom.plans.score_queries import _RATES, _pairs
from panelloom.plans.tables import Register, Tables, panel_sql
from panelloom.plans.voxel_queries import _GRID, _M, _SURFACE, _dense
from panelloom.sources import pairing
from panelloom.sources import tables as T
from panelloom.streaming import runs

register = Register()
queries, oracle_sql = register.queries, register.oracle_sql

#: Files of the examination made of a page, by page_id % 7; @ stands for the examination.
_FILES = (
    "@_t1post.nii.gz,@_seg_t1post.nii.gz,notes.txt",
    "@_t1postIAC.nii.gz,@_seg_t1postIAC.nii.gz",
    "@_t1post.nii.gz,@_t1postIAC.nii.gz,@_seg_t1postIAC.nii.gz",
    "@_t1post.nii,@_seg_t1post.nii,@_t1postIAC.nii,@_seg_t1postIAC.nii",
    "@_seg_t1post.nii.gz,@_t1postIAC.nii.gz",
    "@_T1POST.NII,@_t1post.nii.gz,@_SEG_t1post.nii.gz",
    "@_flair.nii.gz",
)
_FILES_SQL = "case page_id % 7 " + " ".join(f"when {i} then '{names}'" for i, names in enumerate(_FILES)) + " end"


@register("a03_stem_pairs", f"""with e as (select 'VS_' || lpad((page_id // 3 % 10000)::varchar, 4, '0') || '_0' || (page_id % 3 + 1) as exam, {_FILES_SQL} as names from pages),
p as (select exam, 'cohort/' || exam as folder, 'cohort/' || exam || '/' || unnest(string_split(replace(names, '@', exam), ',')) as path from e),
f as (select exam, folder, path, lower(regexp_replace(regexp_extract(path, '[^/]+$'), '(?i)\\.nii(\\.gz)?$', '')) as stem from p where regexp_matches(lower(path), '\\.nii(\\.gz)?$')),
g as (select exam, folder, max(path) filter (stem = lower(exam) || '_t1postiac') as i1, max(path) filter (stem = lower(exam) || '_seg_t1postiac') as m1,
      max(path) filter (stem = lower(exam) || '_t1post') as i2, max(path) filter (stem = lower(exam) || '_seg_t1post') as m2 from f group by all),
c as (select *, i1 is not null and m1 is not null as a, i2 is not null and m2 is not null as b from g)
select exam, folder, a::int + b::int as pairs, case when a <> b then 'resolved' else 'ambiguous' end as status, exam[1:7] as entity_id,
       case when a <> b then case when a then 't1postiac' else 't1post' end end as reference,
       case when a <> b then case when a then i1 else i2 end end as image_path, case when a <> b then case when a then m1 else m2 end end as mask_path from c""")
def a03_pairs(t: Tables) -> DataFrame:
    number = F.lpad((F.floor(F.col("page_id") / 3) % 10000).cast("string"), 4, "0")
    exam = F.concat(F.lit("VS_"), number, F.lit("_0"), (F.col("page_id") % 3 + 1).cast("string"))
    names = F.get(F.array(*[F.lit(x) for x in _FILES]), (F.col("page_id") % 7).cast("int"))
    rows = t.pages.select(exam.alias("exam"), names.alias("names")).select("exam", F.explode(F.split(F.replace("names", F.lit("@"), F.col("exam")), ",")).alias("name"))
    return pairing.pair_stems(rows.select(F.concat(F.lit("cohort/"), "exam", F.lit("/"), "name").alias("path")))


@register("b01_required_columns", "select o_orderstatus, count(*)::bigint as n from orders group by 1")
def b01(t: Tables) -> DataFrame:
    return R.require_columns(t.orders, ["o_orderkey", "o_orderstatus"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("k04_review_selection", """with o as (select o_orderkey, (o_orderkey * 7919 % 1000) / 1000.0::double as overlap from orders),
a as (select o_orderkey, overlap from o where overlap < 0.02), b as (select * from o where overlap >= 0.02),
s as (select *, ntile(16) over (order by overlap, o_orderkey) as stratum from b), n as (select stratum, count(*) as n from s group by 1),
r as (select *, row_number() over (partition by stratum order by overlap, o_orderkey) - 1 as place from s),
p as (select o_orderkey, overlap from r join n using (stratum) where place = cast(('0x' || substr(sha256('3:' || stratum), 1, 8)) as bigint) % n.n),
u as (select o_orderkey, overlap, 'flagged' as kind from a union all select o_orderkey, overlap, 'passed' from p)
select o_orderkey, overlap, kind, (row_number() over (order by kind = 'passed', case when kind = 'flagged' then overlap else 0 end, o_orderkey) - 1)::bigint as place from u""")
def k04(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("overlap"))
    return R.review_selection(rows, "o_orderkey", "overlap", F.col("overlap") >= 0.02, 16, "3")


@register("f17_checked_folds", _RATES + ", f as (select fold, count(*) as n, count(distinct entity_id) as e from n group by fold) select fold::int as fold, n::bigint as n_test, (sum(n) over () - n)::bigint as n_train, e::bigint as test_entities from f")
def f17(t: Tables) -> DataFrame:
    rows = R.checked_folds(_pairs(t))
    per = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.countDistinct("entity_id").alias("test_entities"))
    total = per.agg(F.sum("n_test").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("fold", "n_test", (F.col("all") - F.col("n_test")).alias("n_train"), "test_entities")


@register("d14_stream_runs", panel_sql(_RUNS + " select entity_id, obs_id, run_id::bigint as run_id from s"))
def d14_stream(t: Tables) -> DataFrame:
    """The panel arrives in three parts by time, with a restart after each; an entity's rows of a part lie in one file, as a batch
    takes some files of a part only."""
    folder = T.scratch(t.spark)
    panel = t.panel().select("entity_id", "obs_id", "t", "v", "crossed", "absent")
    out = panel
    for part in (F.col("t") < 800, (F.col("t") >= 800) & (F.col("t") < 1600), F.col("t") >= 1600):
        panel.where(part).repartition("entity_id").write.mode("append").parquet(f"{folder}/in")
        out = runs.restartable_runs(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress")
    return out.where("status = 'new'").select("entity_id", "obs_id", "run_id")


_SHARES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


@register("e04_e24_sketches", "select event_type, count(value)::bigint as n, true as ranks_close, true as distinct_close from events group by 1")
def e04_sketches(t: Tables) -> DataFrame:
    """States per day and type, merged by type: ranks within two percent, distinct users within five."""
    rows = t.events.withColumn("day", F.to_date("ts"))
    merged = sketches.read_sketches(sketches.merge_sketches(sketches.sketch_table(rows, ["event_type", "day"], "value", "user_id"), ["event_type"]), ["event_type"], _SHARES)
    users = rows.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    checked = merged.join(sketches.rank_errors(rows, merged, ["event_type"], "value", _SHARES), "event_type").join(users, "event_type")
    return checked.select("event_type", "n", (F.col("error") <= 0.02).alias("ranks_close"), (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users")).alias("distinct_close"))


@register("j21b_tiles_3d", _GRID + """, c as (select vec_id, p // 16 as z, p // 4 % 4 as y, p % 4 as x, value from g),
s as (select a.a as z0, b.a as y0, c.a as x0 from (values (0), (1)) a(a), (values (0), (1)) b(a), (values (0), (1)) c(a)),
t as (select vec_id, z, y, x, value + z0 + 2 * y0 + 3 * x0 as value, exp(-0.5 * (pow((z - z0 - 1) / 0.375::double, 2) + pow((y - y0 - 1) / 0.375::double, 2) + pow((x - x0 - 1) / 0.375::double, 2))) as w
      from c, s where z between z0 and z0 + 2 and y between y0 and y0 + 2 and x between x0 and x0 + 2)
select vec_id, z::int as z, y::int as y, x::int as x, round(sum(w * value) / sum(w), 5) as value from t group by all""")
def j21b(t: Tables) -> DataFrame:
    """Tiles of three a side at two places an axis, each with a value of its own added."""
    cut = tiles.cut_tiles_3d(_dense(t), "vec_id", 3, [0, 1])
    moved = cut.withColumn("values", F.transform("values", lambda v: v + F.col("z0") + 2 * F.col("y0") + 3 * F.col("x0")))
    return tiles.merge_tiles_3d(moved, "vec_id", 3, block=2).withColumn("value", F.round("value", 5))


def _hd95_sql(a: int) -> str:
    near = "select p.case_id, sqrt(min(pow(p.z - r.z, 2) + pow(p.y - r.y, 2) + pow(p.x - r.x, 2))) * 0.58 as d from (select * from f where tp = {0}) p join (select * from f where tp = {1}) r on p.case_id = r.case_id group by p.case_id, p.z, p.y, p.x"
    return f"select case_id, quantile_cont(d, 0.95) as hd95 from ({near.format(a, 2)} union all {near.format(2, a)}) group by case_id"


_SCORES = "select coalesce(a.case_id, b.case_id) as case_id, count(a.z) as n_a, count(b.z) as n_b, count(*) filter (a.z is not null and b.z is not null) as n_both from (select * from m where tp = {0}) a full join (select * from m where tp = 2) b on a.case_id = b.case_id and a.z = b.z and a.y = b.y and a.x = b.x group by 1"


@register("j14_evaluate_surfaces", _M + _SURFACE + ", u as (" + " union all ".join(f"select '{name}' as method, o.*, h.hd95 from ({_SCORES.format(a)}) o left join ({_hd95_sql(a)}) h using (case_id)" for name, a in (("first", 0), ("stable", 1))) + ") select method, case_id, round(2 * n_both / (n_a + n_b), 6) as dice, round(hd95, 5) as hd95, round(abs(n_a - n_b) / n_b, 6) as abs_rvd from u")
def j14(t: Tables) -> DataFrame:
    m = t.spheres()
    rows = estimates.evaluate({"first": m.where("tp = 0"), "stable": m.where("tp = 1")}, m.where("tp = 2"), (0.58, 0.58, 0.58))
    return rows.select("method", "case_id", F.round("dice", 6).alias("dice"), F.round("hd95", 5).alias("hd95"), F.round("abs_rvd", 6).alias("abs_rvd"))


_DIGEST = " || ".join(f"'\"{c}\":\"' || {c} || '\"'" + (" || ','" if c != "w" else "") for c in ("l", "o", "q", "r", "w"))


@register("k02_projected_digest", f"""with p as (select l_linenumber::varchar as l, l_orderkey::varchar as o, l_quantity::bigint::varchar as q, l_returnflag as r, strftime(l_shipdate, '%Y-%m-%d') as w from lineitem),
h as (select sha256('{{' || {_DIGEST} || '}}') as h from p)
select count(*)::bigint as rows, sha256({" || ':' || ".join(f"sum(('0x' || h[{8 * i + 1}:{8 * i + 8}])::bigint)::varchar" for i in range(8))}) as digest from h""")
def k02(t: Tables) -> DataFrame:
    from panelloom.operators import checks

    rows = t.lineitem.select(F.col("l_linenumber").cast("string").alias("l"), F.col("l_orderkey").cast("string").alias("o"), F.col("l_quantity").cast("long").cast("string").alias("q"), F.col("l_returnflag").alias("r"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("w"))
    return checks.table_digest(rows)


@register("l01_numbered_rows", "select o_orderkey, (row_number() over (order by o_orderstatus, o_totalprice desc, o_orderkey) - 1)::bigint as place from orders")
def l01(t: Tables) -> DataFrame:
    return tabulate.numbered(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), [F.col("o_orderstatus"), -F.col("o_totalprice")], ["o_orderkey"]).select("o_orderkey", "place")


@register("m03_set_relation", "with a as (select distinct l_suppkey as k from lineitem where l_quantity > 49), b as (select s_suppkey as k from supplier where s_suppkey % 3 > 0), j as (select a.k as x, b.k as y from a full join b on a.k = b.k) select count(*) filter (y is null)::bigint as only_a, count(*) filter (x is null)::bigint as only_b, count(*) filter (x is not null and y is not null)::bigint as both, count(*) filter (x is null or y is null) = 0 as equal from j")
def m03(t: Tables) -> DataFrame:
    a, b = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("k")), t.supplier.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("k"))
    return tabulate.set_relation(a, b, "k")
