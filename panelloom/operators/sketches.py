"""Mergeable sketches: quantile (KLL) and distinct-count (HyperLogLog) states kept in a table and merged without a rescan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sketch_table(rows: DataFrame, by: list[str], value: str, key: str, k: int = 800, lg_k: int = 14) -> DataFrame:
    """(by..., n, quantile_state, distinct_state): one row of states per group, for instance per day and class.

    n counts the non-null values. k = 800 keeps ranks within half a percent with high probability, lg_k = 14 distinct
    counts within two percent. Partial states combine before the shuffle; a group without values has a null state.
    """
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("quantile_state"), F.hll_sketch_agg(F.col(key).cast("string"), F.lit(lg_k)).alias("distinct_state"))


def merge_sketches(states: DataFrame, by: list[str], k: int = 800) -> DataFrame:
    """The states of coarser groups from those of finer ones; rows that were counted are not read again."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantile_state", F.lit(k)).alias("quantile_state"), F.hll_union_agg("distinct_state").alias("distinct_state"))


def read_sketches(states: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., n, distinct, a column per share): estimates of a table of states."""
    quantiles = [F.kll_sketch_get_quantile_double("quantile_state", F.lit(float(q))).alias(name) for name, q in shares.items()]
    return states.select(*by, "n", F.hll_sketch_estimate("distinct_state").alias("distinct"), *quantiles)


def rank_errors(rows: DataFrame, estimates: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., error): the largest distance of a share to the true ranks of its estimate, in one pass over the rows."""
    met = rows.where(F.col(value).isNotNull()).join(F.broadcast(estimates.select(*by, *shares)), by)
    counts = [F.avg((F.col(value) < F.col(n)).cast("double")).alias(f"__lo_{n}") for n in shares] + [F.avg((F.col(value) <= F.col(n)).cast("double")).alias(f"__hi_{n}") for n in shares]
    off = [F.greatest(F.col(f"__lo_{n}") - q, q - F.col(f"__hi_{n}"), F.lit(0.0)) for n, q in shares.items()]
    return met.groupBy(*by).agg(*counts).select(*by, (F.greatest(*off) if len(off) > 1 else off[0]).alias("error"))
