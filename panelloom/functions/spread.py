"""Global orders without a single task: checkpoints, running totals over ranges, exact quantiles."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many rows a quantile is taken in one aggregation.
SMALL = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, or spark.checkpoint.dir; a temporary folder only in local mode, where one machine
    has all tasks. A cluster without such a setting is an error: a folder of one machine would be missing on the others."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return known or tempfile.mkdtemp(prefix="spark-shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that meets the other one in a shuffle. Spark takes what comes out of explode() or a Python
    function for as small as what it was made of, and would collect it at the driver to broadcast it."""
    return df.hint("merge")


def by_ranges(rows: DataFrame, order: str, descending: bool = False) -> DataFrame:
    """The rows dealt by ranges of unique `order` values, with the number of the range as __r; written, so ranges stay as they
    are. Nulls of `order` come first, as Spark sorts them (last if descending)."""
    by = F.col(order).desc() if descending else F.col(order).asc()
    return checkpointed(rows.repartitionByRange(by).withColumn("__r", F.spark_partition_id()))


def range_totals(dealt: DataFrame, order: str, totals: dict[str, Column], descending: bool = False) -> DataFrame:
    """Running totals over rows dealt by_ranges(), which keep __r: several may follow each other on the same ranges."""
    by = F.col(order).desc() if descending else F.col(order).asc()
    before = Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("__r").agg(*[F.sum(c).alias(f"__{n}") for n, c in totals.items()])
    offsets = per.select(F.col("__r"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals])
    inside = Window.partitionBy("__r").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition of the range exchange: as few as there are shuffle partitions.
    joined = dealt.join(F.broadcast(offsets), "__r")
    return joined.withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()}).drop(*[f"__{n}" for n in totals])


def running_totals(rows: DataFrame, order: str, totals: dict[str, Column], descending: bool = False) -> DataFrame:
    """Adds, per name, the sum of an expression over all rows up to and with this one in the order of unique `order` values.

    The sums before a range come from one row per range.
    """
    return range_totals(by_ranges(rows, order, descending), order, totals, descending).drop("__r")


def quantiles(df: DataFrame, column: str | Column, shares: list[float]) -> list[float]:
    """Exact, linearly interpolated quantiles of the non-null values; NaN where there are none.

    While the rows are many, approximate quantiles bracket an order statistic and only what lies in the bracket goes on,
    a few thousandths of the rows at a time, so that no task ever holds the distinct values of a large column.
    """
    c = F.col(column) if isinstance(column, str) else column
    # Written once: the column may come out of windows, and it is read at least twice.
    rows = checkpointed(df.select(c.cast("double").alias("v")).where("v is not null"))
    n = rows.count()
    if n == 0:
        return [math.nan for _ in shares]
    if n <= SMALL:
        return list(rows.agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in shares]))).first()[0])
    out = []
    for q in shares:
        place = q * (n - 1)
        low, high = (_order_statistic(rows, n, math.floor(place)), _order_statistic(rows, n, math.ceil(place)))
        out.append(low + (high - low) * (place - math.floor(place)))
    return out


def _order_statistic(rows: DataFrame, n: int, rank: int) -> float:
    """The value of 0-based rank `rank` among n."""
    while n > SMALL:
        edge = 4 / 10_000
        a, b = rows.agg(F.percentile_approx("v", [max(0.0, rank / n - edge), min(1.0, rank / n + edge)], 10_000)).first()[0]
        below, inside = rows.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        if a == b and below <= rank < below + inside:
            return a
        if rank < below:
            rows, n = rows.where(F.col("v") < a), below
        elif rank >= below + inside:
            rows, n, rank = rows.where(F.col("v") > b), n - below - inside, rank - below - inside
        elif inside == n:
            # A bracket as wide as the rows holds few distinct values, or the last ones; they are counted by value.
            break
        else:
            rows, n, rank = rows.where(F.col("v").between(a, b)), inside, rank - below
    counts = running_totals(rows.groupBy("v").agg(F.count(F.lit(1)).alias("k")), "v", {"upto": F.col("k")})
    return counts.where(F.col("upto") > rank).agg(F.min("v")).first()[0]
