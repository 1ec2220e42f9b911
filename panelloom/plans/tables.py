"""Bindings of the test tables to the data model, and the register of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The orders table as a panel: entity, observation, time in days, value, class, tri-state intervention, two flags.
PANEL_SQL = """
select o_custkey as entity_id, o_orderkey as obs_id,
       date_diff('day', date '1992-01-01', cast(o_orderdate as date))::double as t, o_totalprice as v, o_orderstatus as cls,
       case when o_orderpriority = '4-NOT SPECIFIED' then null else o_orderpriority = '1-URGENT' end as crossed,
       o_orderstatus = 'F' as post, (o_orderpriority = '5-LOW' and o_totalprice < 50000) as absent
from orders
"""

#: Classification cases: documents with labels, a score in (0, 1) from the text length, and five folds by md5.
SCORED_SQL = """
select d.doc_id, d.lang as entity_id, l.quality as y, least(0.99, greatest(0.01, round(d.n_chars / 5000.0, 2))) as p,
       cast(('0x' || substr(md5('100:' || d.doc_id), 1, 8)) as bigint) % 5 as fold
from documents d join labels l on d.doc_id = l.doc_id where l.quality is not null
"""

#: Sphere masks from supplier keys at three times (see operators.voxel.spheres).
SPHERES_SQL = """
select s.s_suppkey as case_id, tp.tp as tp, z.i as z, y.i as y, x.i as x
from supplier s, (select unnest([0, 1, 2]) as tp) tp, generate_series(0, 11) z(i), generate_series(0, 11) y(i), generate_series(0, 11) x(i)
where (z.i - 5 - s.s_suppkey % 2) * (z.i - 5 - s.s_suppkey % 2) + (y.i - 5) * (y.i - 5) + (x.i - 6) * (x.i - 6)
      <= pow(2 + s.s_suppkey % 3 + (case s.s_suppkey % 3 when 0 then -0.4 when 1 then 0.0 else 0.5 end) * tp.tp, 2)
"""


class Tables:
    """Reads the tables of one folder; every query gets one of these."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def panel(self) -> DataFrame:
        day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
        return self.orders.select(
            F.col("o_custkey").alias("entity_id"),
            F.col("o_orderkey").alias("obs_id"),
            day.alias("t"),
            F.col("o_totalprice").alias("v"),
            F.col("o_orderstatus").alias("cls"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority") == "1-URGENT").alias("crossed"),
            (F.col("o_orderstatus") == "F").alias("post"),
            ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 50000)).alias("absent"),
        )

    def scored(self) -> DataFrame:
        from panelloom.functions.seed import keyed_order

        d, labels = self.documents, self.labels
        p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.round(F.col("n_chars") / 5000.0, 2)))
        return d.join(labels.where("quality is not null"), "doc_id").select("doc_id", F.col("lang").alias("entity_id"), F.col("quality").alias("y"), p.alias("p"), (keyed_order("100", F.col("doc_id")) % 5).alias("fold"))

    def spheres(self) -> DataFrame:
        from panelloom.operators.voxel import spheres

        return spheres(self.supplier.select(F.col("s_suppkey").alias("case_id")))


Builder = Callable[[Tables], DataFrame]


class Register:
    """Collects queries: @register("name", sql) on a function of Tables."""

    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Builder) -> Builder:
            self.builders[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, f in self.builders.items()}

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)


def panel_sql(rest: str) -> str:
    """SQL over the panel as p; rest begins with more CTEs (", x as ...") or with select."""
    return f"with p as ({PANEL_SQL}) {rest}"
