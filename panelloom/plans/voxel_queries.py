"""Queries of the voxel operators: spheres derived from supplier keys, embeddings as 4 x 4 x 4 grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.seed import keyed_order
from panelloom.operators import voxel as V
from panelloom.plans.tables import SPHERES_SQL, Register, Tables

register = Register()
queries, oracle_sql = register.queries, register.oracle_sql

_M = f"with m as ({SPHERES_SQL}) "
_GRID = "with g as (select vec_id, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as p from embeddings) "


def _dense(t: Tables) -> DataFrame:
    return V.dense(t.embeddings, "vec_id", "embedding", (4, 4, 4))


@register("j02_volumes", _M + "select case_id, tp, count(*)::bigint as voxels, round(count(*) * 0.195112::double, 6) as volume from m group by case_id, tp")
def j02(t: Tables) -> DataFrame:
    return V.volumes(t.spheres(), 0.195112).select("case_id", "tp", "voxels", F.round("volume", 6).alias("volume"))


_OVERLAP = _M + ", o as (select coalesce(a.case_id, b.case_id) as case_id, count(a.z) as n_a, count(b.z) as n_b, count(*) filter (a.z is not null and b.z is not null) as n_both from (select * from m where tp = {a}) a full join (select * from m where tp = {b}) b on a.case_id = b.case_id and a.z = b.z and a.y = b.y and a.x = b.x group by 1) select case_id, n_a::bigint as n_a, n_b::bigint as n_b, round(2 * n_both / (n_a + n_b), 6) as dice, round((n_a - n_b) / n_b, 6) as signed_rvd from o"


@register("j03_j04_j12_stable_mask", _OVERLAP.format(a=1, b=2))
def j03(t: Tables) -> DataFrame:
    m = t.spheres()
    return V.overlap(m.where("tp = 1"), m.where("tp = 2")).select("case_id", "n_a", "n_b", F.round("dice", 6).alias("dice"), F.round("signed_rvd", 6).alias("signed_rvd"))


@register("j15_registration_overlap", _OVERLAP.format(a=0, b=1))
def j15(t: Tables) -> DataFrame:
    m = t.spheres()
    return V.overlap(m.where("tp = 0"), m.where("tp = 1")).select("case_id", "n_a", "n_b", F.round("dice", 6).alias("dice"), F.round("signed_rvd", 6).alias("signed_rvd"))


_STEPS = "(values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) s(a, b, c)"
_SURFACE = f", h as (select m.case_id, m.tp, m.z, m.y, m.x, count(n.z) as held from m cross join {_STEPS} left join m n on n.case_id = m.case_id and n.tp = m.tp and n.z = m.z + s.a and n.y = m.y + s.b and n.x = m.x + s.c group by all), f as (select * from h where held < 6)"


@register("j05_surface", _M + _SURFACE + " select case_id, tp, count(*)::bigint as n, sum(z * 10000 + y * 100 + x)::bigint as code from f group by case_id, tp")
def j05(t: Tables) -> DataFrame:
    return V.surface(t.spheres()).groupBy("case_id", "tp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * 10000 + F.col("y") * 100 + F.col("x")).alias("code"))


@register("j06_hd95", _M + _SURFACE + ", p as (select * from f where tp = 1), r as (select * from f where tp = 2), d as (select p.case_id, sqrt(min(pow(p.z - r.z, 2) + pow(p.y - r.y, 2) + pow(p.x - r.x, 2))) * 0.58 as d from p join r on p.case_id = r.case_id group by p.case_id, p.z, p.y, p.x union all select p.case_id, sqrt(min(pow(p.z - r.z, 2) + pow(p.y - r.y, 2) + pow(p.x - r.x, 2))) * 0.58 from p join r on p.case_id = r.case_id group by p.case_id, r.z, r.y, r.x) select case_id, round(quantile_cont(d, 0.95), 5) as hd95 from d group by case_id")
def j06(t: Tables) -> DataFrame:
    m = t.spheres()
    return V.hd95(m.where("tp = 1"), m.where("tp = 2"), (0.58, 0.58, 0.58), size=12).select("case_id", F.round("hd95", 5).alias("hd95"))


@register("j07_centroid", _M + "select case_id, tp, round(avg(z), 6) as cz, round(avg(y), 6) as cy, round(avg(x), 6) as cx from m group by case_id, tp")
def j07(t: Tables) -> DataFrame:
    return V.centroid(t.spheres()).select("case_id", "tp", *[F.round(c, 6).alias(c) for c in ("cz", "cy", "cx")])


@register("j08_border", _M + "select case_id, tp, concat_ws(';', case when bool_or(z = 0) then 'z_low' end, case when bool_or(z = 11) then 'z_high' end, case when bool_or(y = 0) then 'y_low' end, case when bool_or(y = 11) then 'y_high' end, case when bool_or(x = 0) then 'x_low' end, case when bool_or(x = 11) then 'x_high' end) as faces from m group by case_id, tp")
def j08(t: Tables) -> DataFrame:
    return V.border_faces(t.spheres(), 12).select("case_id", "tp", F.concat_ws(";", "faces").alias("faces"))


_SDF = _M + """, b as (select case_id, tp, z.i as z, y.i as y, x.i as x from (select distinct case_id, tp from m) c, generate_series(0, 11) z(i), generate_series(0, 11) y(i), generate_series(0, 11) x(i)),
f as (select b.*, m.z is not null as inside from b left join m on b.case_id = m.case_id and b.tp = m.tp and b.z = m.z and b.y = m.y and b.x = m.x),
e1 as (select a.case_id, a.tp, a.inside as kind, g.i as z, a.y, a.x, min((a.z - g.i) * (a.z - g.i)) as d from f a, generate_series(0, 11) g(i) group by all),
e2 as (select a.case_id, a.tp, kind, a.z, g.i as y, a.x, min(d + (a.y - g.i) * (a.y - g.i)) as d from e1 a, generate_series(0, 11) g(i) group by all),
e3 as (select a.case_id, a.tp, kind, a.z, a.y, g.i as x, min(d + (a.x - g.i) * (a.x - g.i)) as d from e2 a, generate_series(0, 11) g(i) group by all),
s as (select case_id, tp, z, y, x, least(5.0, greatest(-5.0, sqrt(max(d) filter (kind)) - sqrt(coalesce(max(d) filter (not kind), 0)))) / 5.0 as sdf from e3 group by all)"""


@register("j09_signed_distance", _SDF + " select case_id, tp, count(*)::bigint as n, round(sum(sdf), 4) as total, round(min(sdf), 6) as least, count(*) filter (sdf < 0)::bigint as inside from s group by case_id, tp")
def j09(t: Tables) -> DataFrame:
    s = V.signed_distance(t.spheres(), 12, (1.0, 1.0, 1.0), 5.0)
    return s.groupBy("case_id", "tp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sdf"), 4).alias("total"), F.round(F.min("sdf"), 6).alias("least"), F.count_if(F.col("sdf") < 0).alias("inside"))


@register("j13_linear_sdf", _SDF + " select a.case_id, count(*) filter (b.sdf + 1.0 * (b.sdf - a.sdf) < 0)::bigint as predicted from s a join s b on a.case_id = b.case_id and a.z = b.z and a.y = b.y and a.x = b.x and a.tp = 0 and b.tp = 1 group by a.case_id")
def j13(t: Tables) -> DataFrame:
    s = V.signed_distance(t.spheres().where("tp < 2"), 12, (1.0, 1.0, 1.0), 5.0)
    pair = s.groupBy("case_id", "z", "y", "x").agg(F.max(F.when(F.col("tp") == 0, F.col("sdf"))).alias("s0"), F.max(F.when(F.col("tp") == 1, F.col("sdf"))).alias("s1"))
    return pair.groupBy("case_id").agg(F.count_if(F.col("s1") + 1.0 * (F.col("s1") - F.col("s0")) < 0).alias("predicted"))


@register("j10_crop", _M + ", c as (select case_id, tp, avg(z) as cz, avg(y) as cy, avg(x) as cx from m group by all), k as (select m.case_id, m.tp, m.z - round_even(cz - 3.0, 0) as z, m.y - round_even(cy - 3.0, 0) as y, m.x - round_even(cx - 3.0, 0) as x from m join c using (case_id, tp)) select case_id, tp, count(*)::bigint as n, sum(z * 100 + y * 10 + x)::bigint as code from k where z between 0 and 5 and y between 0 and 5 and x between 0 and 5 group by case_id, tp")
def j10(t: Tables) -> DataFrame:
    m = t.spheres()
    return V.crop(m, V.centroid(m), 6).groupBy("case_id", "tp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * 100 + F.col("y") * 10 + F.col("x")).alias("code"))


@register("j11_normalise", _GRID + ", q as (select vec_id, quantile_cont(value, 0.005) as a, quantile_cont(value, 0.995) as b from g where isfinite(value) and value <> 0 group by 1) select g.vec_id, round(sum(case when isfinite(value) and value <> 0 then 2 * (least(b, greatest(a, value)) - a) / greatest(b - a, 1e-6) - 1 else -1 end), 4) as total from g join q using (vec_id) group by g.vec_id")
def j11(t: Tables) -> DataFrame:
    return V.normalise(_dense(t), "vec_id").groupBy("vec_id").agg(F.round(F.sum("value"), 4).alias("total"))


@register("j17_intensity_range", _GRID + "select vec_id, count(*) filter (isfinite(value))::bigint as n, round(min(value), 6) as lo, round(quantile_cont(value, 0.01), 6) as p01, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as hi from g group by vec_id")
def j17(t: Tables) -> DataFrame:
    rows = V.intensity_range(_dense(t), "vec_id")
    return rows.select("vec_id", "n", *[F.round(c, 6).alias(n) for c, n in (("lo", "lo"), ("q_low", "p01"), ("q_high", "p99"), ("hi", "hi"))])


@register("a17_dense_rows", _GRID + "select vec_id, (p // 16)::int as z, (p // 4 % 4)::int as y, (p % 4)::int as x, round(value, 6) as value from g")
def a17(t: Tables) -> DataFrame:
    return _dense(t).select("vec_id", "z", "y", "x", F.round("value", 6).alias("value"))


@register("j16_resample", _M + ", r as (select i, floor((i + 0.5) * 12 / 18)::bigint as s from generate_series(0, 17) g(i)) select m.case_id, m.tp, count(*)::bigint as n from m join r a on a.s = m.z join r b on b.s = m.y join r c on c.s = m.x group by m.case_id, m.tp")
def j16(t: Tables) -> DataFrame:
    return V.resample_nearest(t.spheres(), 12, 18).groupBy("case_id", "tp").agg(F.count(F.lit(1)).alias("n"))


@register("j18_point_sample", _M + ", k as (select *, row_number() over (partition by case_id, tp order by cast(('0x' || substr(md5('5:' || case_id || ':' || tp || ':' || z || ':' || y || ':' || x), 1, 8)) as bigint), z, y, x) as n from m) select case_id, tp, round(2 * z / 11.0 - 1, 6) as nz, round(2 * y / 11.0 - 1, 6) as ny, round(2 * x / 11.0 - 1, 6) as nx from k where n <= 8")
def j18(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = keyed_order("5", *[F.col(c) for c in ("case_id", "tp", "z", "y", "x")])
    rank = F.row_number().over(Window.partitionBy("case_id", "tp").orderBy(order, "z", "y", "x"))
    rows = t.spheres().withColumn("n", rank).where("n <= 8")
    return rows.select("case_id", "tp", *[F.round(2 * F.col(c) / 11.0 - 1, 6).alias(f"n{c}") for c in V.VOXEL])


@register("j19_bounding_box", _M + "select case_id, tp, min(z)::int as z_min, max(z)::int + 1 as z_max, min(y)::int as y_min, max(y)::int + 1 as y_max, min(x)::int as x_min, max(x)::int + 1 as x_max from m group by case_id, tp")
def j19(t: Tables) -> DataFrame:
    return V.bounding_box(t.spheres())


@register("j20_largest_component", _M + "select case_id, tp, count(*)::bigint as n from m group by case_id, tp")
def j20(t: Tables) -> DataFrame:
    """Spheres are connected, so the largest component is the whole mask."""
    return V.largest_component(t.spheres()).groupBy("case_id", "tp").agg(F.count(F.lit(1)).alias("n"))


@register("j21_tile_starts", "with s as (select p_partkey, 20 + p_partkey % 50 as size from part), c as (select *, greatest(ceil((size - 16) / 8.0)::int + 1, 1) as n from s) select p_partkey, i::int as tile, round_even(case when n > 1 then (size - 16) / (n - 1)::double else 0 end * i, 0)::int as start from c, unnest(generate_series(0, n - 1)) u(i)")
def j21(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.posexplode(V.tile_starts((20 + F.col("p_partkey") % 50).cast("double"), F.lit(16.0), 0.5)).alias("tile", "start"))
    return rows


@register("j22_j23_gates", _GRID + "select vec_id, count(*) filter (value >= 0.1)::bigint as merged, round(sum(value * 2 - 1), 4) as shifted, case when count(*) filter (not isfinite(value)) > 0 then 'non_finite' when count(*) filter (value > 0) = 0 then 'empty' else 'ok' end as gate from g group by vec_id")
def j22(t: Tables) -> DataFrame:
    v = F.col("value")
    gate = F.when(F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))) > 0, "non_finite").when(F.count_if(v > 0) == 0, "empty").otherwise("ok")
    return _dense(t).groupBy("vec_id").agg(F.count_if(v >= 0.1).alias("merged"), F.round(F.sum(v * 2 - 1), 4).alias("shifted"), gate.alias("gate"))
