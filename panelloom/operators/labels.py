"""Threshold labels, bins and classes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.spread import quantiles


def both_ends(a: str, b: str, cut: float) -> Column:
    """both_small, both_large or mixed, by the two ends of an interval."""
    low_a, low_b = F.col(a) < cut, F.col(b) < cut
    return F.when(low_a & low_b, "both_small").when(~low_a & ~low_b, "both_large").otherwise("mixed")


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (a, b]; null outside all of them."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > low) & (x <= high), label).otherwise(out)
    return out


def qcut(df: DataFrame, column: str, labels: list[str], name: str) -> DataFrame:
    """Quantile bins by exact quantiles: right-closed, the lowest edge included; null for null."""
    k = len(labels)
    edges = quantiles(df, column, [i / k for i in range(1, k)])
    label = F.lit(labels[-1])
    for i in range(k - 2, -1, -1):
        label = F.when(F.col(column) <= edges[i], labels[i]).otherwise(label)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), label))


def threshold_grid(pairs: DataFrame, grid: list[tuple[str, float, float, float]], size_cut: float) -> DataFrame:
    """Every pair under every definition (name, relative threshold below and from size_cut on, absolute floor)."""
    table = pairs.sparkSession.createDataFrame(grid, "name string, below double, above double, floor double")
    change = F.col("v") - F.col("prev_v")
    needed = F.when(F.col("prev_v") < size_cut, F.col("below")).otherwise(F.col("above"))
    return pairs.crossJoin(F.broadcast(table)).withColumn("event", (change / F.col("prev_v") >= needed) & (change >= F.col("floor")))


def annualised(pairs: DataFrame, absolute: dict[str, float], relative: dict[str, float]) -> DataFrame:
    """Adds a flag per endpoint: growth per year in absolute terms, or as a compound rate."""
    years = (F.col("t") - F.col("prev_t")) / 365.25
    flags = {name: (F.col("v") - F.col("prev_v")) / years >= x for name, x in absolute.items()}
    flags |= {name: F.pow(F.col("v") / F.col("prev_v"), 1 / years) - 1 >= x for name, x in relative.items()}
    return pairs.withColumns(flags)


def change_class(change: Column, threshold: float) -> Column:
    """growing / shrinking beyond the threshold (strictly), else stable."""
    return F.when(change > threshold, "growing").when(change < -threshold, "shrinking").otherwise("stable")


def anomalous(log_ratio: Column) -> Column:
    return F.abs(log_ratio) > math.log(8)


def extreme(change: Column) -> Column:
    return (change > 5) | (change < -0.9)


def relative_change(before: str, after: str) -> Column:
    """(after - before) / before, NaN where before is 0."""
    return F.when(F.col(before) != 0, (F.col(after) - F.col(before)) / F.col(before)).otherwise(float("nan"))
