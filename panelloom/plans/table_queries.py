"""Queries of validation, joins, summaries, selection, set operations and review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import checks as C
from panelloom.operators import summaries
from panelloom.operators import tabulate as B
from panelloom.plans.tables import Register, Tables, panel_sql

register = Register()
queries, oracle_sql = register.queries, register.oracle_sql

_W = "partition by entity_id order by t, obs_id"


@register("a01_contract", panel_sql(f", q as (select *, lag(t) over ({_W}) as pt from p) select count(*)::bigint as n, count(*) filter (entity_id is null or obs_id is null or t is null)::bigint as missing, (select count(*) from (select entity_id, obs_id from p group by all having count(*) > 1))::bigint as repeated, count(*) filter (t <= pt)::bigint as not_increasing from q"))
def a01(t: Tables) -> DataFrame:
    return C.contract(t.panel())


@register("a05_pair_resolution", "with f as (select l_orderkey as k, count(*) filter (l_returnflag = 'A') as images, count(*) filter (l_returnflag = 'R') as masks from lineitem group by 1) select k, images::bigint as images, masks::bigint as masks, images = 1 and masks = 1 as resolved from f")
def a05(t: Tables) -> DataFrame:
    return C.resolve_pairs(t.lineitem, "l_orderkey", F.col("l_returnflag") == "A", F.col("l_returnflag") == "R").withColumnRenamed("l_orderkey", "k")


@register("a07_minimal_file_list", "select unnest([c_name || '/image_' || (case when c_acctbal > 5000 then 'late' else 'early' end), c_name || '/mask_' || (case when c_acctbal > 5000 then 'late' else 'early' end)]) as path from customer")
def a07(t: Tables) -> DataFrame:
    return B.minimal_files(t.customer, "c_name", F.when(F.col("c_acctbal") > 5000, "late").otherwise("early"))


@register("a08_path_validation", "with u as (select page_id, regexp_replace(url, '^https?://', '') as path from pages) select page_id, not (path like '/%' or path like '%..%' or not regexp_matches(path, '^[A-Za-z0-9_./?=&#-]+$')) as safe, count(*) over (partition by path) > 1 as repeated from u")
def a08(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    many = rows.groupBy("path").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return rows.join(many, "path").select("page_id", C.safe_path(F.col("path")).alias("safe"), "repeated")


@register("a09_a10_resume", "select o_orderkey as k, o_orderkey in (select l_orderkey from lineitem where l_quantity > 40) as done from orders")
def a09(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("k"))
    return C.membership(t.orders.select(F.col("o_orderkey").alias("k")), done, "k", "done")


@register("a13_strict_json", "select l_orderkey, l_linenumber, case when l_discount = 0 then null else round(l_tax / l_discount, 4) end as ratio, (l_discount = 0)::int as nonfinite from lineitem")
def a13(t: Tables) -> DataFrame:
    from panelloom.functions.numbers import finite, finite_or_null

    ratio = F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", ratio.alias("r"))
    parsed = F.from_json(F.to_json(F.struct(finite_or_null(F.col("r")).alias("ratio"))), "ratio double")
    return rows.select("l_orderkey", "l_linenumber", F.round(parsed["ratio"], 4).alias("ratio"), (~finite(F.col("r"))).cast("int").alias("nonfinite"))


@register("b02_coercion", "select count(*)::bigint as n, count(*) filter (try_cast(json_extract_string(props, '$.k') as double) is null)::bigint as bad, round(avg(try_cast(json_extract_string(props, '$.k') as double)), 6) as mean from events")
def b02(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.count_if(k.isNull()).alias("bad"), F.round(F.avg(k), 6).alias("mean"))


@register("b04_duplicates", "select o_custkey, o_orderdate, count(*)::bigint as n from orders group by all having count(*) > 1")
def b04(t: Tables) -> DataFrame:
    return C.duplicates(t.orders, ["o_custkey", "o_orderdate"])


@register("b06_b07_flags", "with x as (select event_id, case event_id % 6 when 0 then '' when 1 then 'yes' when 2 then '0' when 3 then 'True' when 4 then 'n' else null end as s from events) select event_id, case when lower(trim(s)) in ('1', 'true', 'yes', 'y') then true when lower(trim(s)) in ('0', 'false', 'no', 'n') then false end as strict, case lower(trim(s)) when 'true' then true when 'false' then false end as lenient from x")
def b06(t: Tables) -> DataFrame:
    m = F.col("event_id") % 6
    s = F.when(m == 0, "").when(m == 1, "yes").when(m == 2, "0").when(m == 3, "True").when(m == 4, "n")
    return t.events.select("event_id", C.strict_flag(s).alias("strict"), C.lenient_flag(s).alias("lenient"))


@register("b10_b12_names", "select c_custkey, try_cast(regexp_extract(c_name, '(\\d+)$', 1) as bigint) as number, regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9_.-]+', '_', 'g') as safe, coalesce(nullif(lower(trim(c_mktsegment)), ''), 'Missing') as segment from customer")
def b10(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("long").alias("number"), C.safe_name(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("safe"), C.category(F.lower(F.trim("c_mktsegment"))).alias("segment"))


@register("b15_array_close", "select a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: case when abs(z[1]::double - z[2]::double) <= 1e-4 + 0.5 * abs(z[2]::double) then 0 else 1 end)) = 0 as near from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def b15(t: Tables) -> DataFrame:
    e = t.embeddings
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", C.all_close(F.col("embedding"), F.col("other"), 0.5, 1e-4).alias("near"))


@register("b18_failure_category", "select doc_id, case when lower(text) like '%token%' then 'secret' when lower(text) like '%license%' then 'license' when lower(text) like '%@%' then 'contact' else 'other' end as category from documents")
def b18(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.first_match(F.col("text"), [("token", "secret"), ("license", "license"), ("@", "contact")], "other").alias("category"))


@register("c01_c05_joins", "with a as (select l_orderkey, avg(l_discount) as d, count(*) as n from lineitem group by 1) select o_orderkey, round(coalesce(a.d, -1), 6) as discount, coalesce(a.n, 0)::bigint as lines, c.c_mktsegment as segment from orders o left join a on a.l_orderkey = o.o_orderkey left join customer c on c.c_custkey = o.o_custkey")
def c01(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    rows = t.orders.join(lines, "o_orderkey", "left").join(customers, "o_custkey", "left")
    return rows.select("o_orderkey", F.round(F.coalesce("d", F.lit(-1.0)), 6).alias("discount"), F.coalesce("n", F.lit(0)).alias("lines"), "segment")


@register("c07_c08_semi_anti", "select (select count(*) from customer where c_custkey in (select o_custkey from orders))::bigint as with_orders, (select count(*) from customer where c_custkey not in (select o_custkey from orders))::bigint as without")
def c07(t: Tables) -> DataFrame:
    keys, buyers = t.customer.select(F.col("c_custkey").alias("o_custkey")), t.orders.select("o_custkey")
    some = keys.join(buyers, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("with_orders"))
    return some.crossJoin(keys.join(buyers, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("without")))


@register("e01_profile", panel_sql("select entity_id, count(*)::bigint as n, max(t) as last_t, arg_min(v, t * 100000000 + obs_id) filter (v > 100000) as first_large, bool_or(post) as any_post from p group by entity_id"))
def e01(t: Tables) -> DataFrame:
    first = F.min(F.when(F.col("v") > 100000, F.struct("t", "obs_id", "v")))["v"]
    return t.panel().groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"), first.alias("first_large"), F.bool_or("post").alias("any_post"))


@register("e02_value_counts", "select coalesce(nullif(event_type, ''), 'Missing') as value, count(*)::bigint as n from events group by 1 order by n desc, value limit 3")
def e02(t: Tables) -> DataFrame:
    return C.value_counts(t.events, "event_type", 3)


@register("e03_count_histogram", "select n::bigint as n, count(*)::bigint as entities from (select o_custkey, count(*) as n from orders group by 1) group by n")
def e03(t: Tables) -> DataFrame:
    return B.count_histogram(t.orders, "o_custkey")


@register("e04_quartiles", "select event_type, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75, min(value) as lo, max(value) as hi from events group by 1")
def e04(t: Tables) -> DataFrame:
    rows = summaries.five_numbers(t.events, "value", ["event_type"])
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "lo", "hi")


@register("e05_crosstab", "select o_orderpriority, count(*) filter (o_orderstatus = 'F')::bigint as F, count(*) filter (o_orderstatus = 'O')::bigint as O, count(*) filter (o_orderstatus = 'P')::bigint as P from orders group by 1")
def e05(t: Tables) -> DataFrame:
    return B.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@register("e21_cohort_flow", panel_sql(" select 'all' as gate, count(*)::bigint as n, count(distinct entity_id)::bigint as entities from p union all select 'present', count(*), count(distinct entity_id) from p where not absent union all select 'untreated', count(*), count(distinct entity_id) from p where not absent and not post"))
def e21(t: Tables) -> DataFrame:
    return C.cohort_flow(t.panel(), {"all": F.lit(True), "present": ~F.col("absent"), "untreated": ~F.col("absent") & ~F.col("post")})


@register("e24_e27_e28_entities", panel_sql(" select count(distinct entity_id)::bigint as entities, (select count(*) from (select entity_id from p where post group by 1 having count(*) >= 2))::bigint as two_post, (select count(*) from (select distinct entity_id from p where entity_id not in (select entity_id from p where post)))::bigint as no_post from p"))
def e24(t: Tables) -> DataFrame:
    per = t.panel().groupBy("entity_id").agg(F.count_if("post").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") >= 2).alias("two_post"), F.count_if(F.col("n") == 0).alias("no_post"))


@register("k02_table_digest")
def k02(t: Tables) -> DataFrame:
    return C.table_digest(t.lineitem)


@register("k04_k06_stratified_sample", "with s as (select o_orderkey, ntile(16) over (order by o_totalprice, o_orderkey) as stratum from orders), n as (select stratum, count(*) as n from s group by 1), r as (select s.*, row_number() over (partition by s.stratum order by o.o_totalprice, s.o_orderkey) - 1 as place from s join orders o using (o_orderkey)) select r.stratum::int as stratum, r.o_orderkey from r join n using (stratum) where place = cast(('0x' || substr(sha256('3:' || r.stratum), 1, 8)) as bigint) % n.n")
def k04(t: Tables) -> DataFrame:
    return C.stratified_pick(t.orders, "o_totalprice", "o_orderkey", 16, "3").select("stratum", "o_orderkey")


@register("l02_l04_first_rows", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1 order by o_custkey limit 100")
def l02(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey")
    return B.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).orderBy("o_custkey").select("o_custkey", "o_orderkey").limit(100)


@register("m01_m03_m04_sets", "with a as (select distinct o_custkey as k from orders), b as (select c_custkey as k from customer) select (select count(*) from (select k from a except select k from b))::bigint as only_a, (select count(*) from (select k from b except select k from a))::bigint as only_b, (select count(*) from (select k from a union all select k from b))::bigint as rows_of_both")
def m01(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    rows = a.distinct().unionByName(b).agg(F.count(F.lit(1)).alias("rows_of_both"))
    return B.set_relation(a, b, "k").select("only_a", "only_b").crossJoin(F.broadcast(rows))