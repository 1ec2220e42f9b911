"""Summaries with clustered uncertainty, paired differences, and counts over lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.groups import group_quantiles
from panelloom.functions.numbers import finite
from panelloom.functions.spread import checkpointed
from panelloom.operators.estimates import bootstrap_weights, interval
from panelloom.operators.scores import spearman, with_quantiles


def paired(results: DataFrame, reference: str, instance: str = "instance_id", model: str = "model", error: str = "error") -> DataFrame:
    """Rows of the other models with the reference's error on the same instance, and difference = error - reference_error.

    Instances that the reference lacks are left out.
    """
    base = results.where(F.col(model) == reference).select(instance, F.col(error).alias("reference_error"))
    return results.where(F.col(model) != reference).join(base, instance).withColumn("difference", F.col(error) - F.col("reference_error"))


def clustered_mean(rows: DataFrame, value: str, entity: str, replicates: int, seed: str, by: list[str]) -> DataFrame:
    """(by..., replicates, mean, lo, hi): a mean with its 95 % interval over entities drawn with replacement.

    A group draws as many entities as it has; sums per entity meet the replicates, not rows. The interval is null with 50
    finite replicates or fewer.
    """
    sums = checkpointed(rows.groupBy(*by, entity).agg(F.sum(value).alias("__s"), F.count(value).alias("__n_values")))
    means = sums.groupBy(*by).agg((F.sum("__s") / F.sum("__n_values")).alias("mean"))
    drawn = bootstrap_weights(sums, entity, replicates, seed, by, ["__s", "__n_values"])
    per = drawn.groupBy(*by, "replicate").agg((F.sum(F.col("times") * F.col("__s")) / F.sum(F.col("times") * F.col("__n_values"))).alias("__m"))
    q = F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975)))
    ends = per.groupBy(*by).agg(F.count("__m").alias("replicates"), q.alias("__q"))
    enough = F.col("replicates") > 50
    return ends.join(means, by).select(*by, "replicates", "mean", F.when(enough, F.get("__q", 0)).alias("lo"), F.when(enough, F.get("__q", 1)).alias("hi"))


def paired_summary(results: DataFrame, reference: str, entity: str, replicates: int, seed: str) -> DataFrame:
    """(model, n, better, replicates, mean, lo, hi): each model's paired difference to the reference, clustered by entity.

    better: the share of instances with the smaller error.
    """
    pairs = paired(results, reference)
    shares = pairs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("difference") < 0).cast("int")).alias("better"))
    return shares.join(clustered_mean(pairs, "difference", entity, replicates, seed, ["model"]), "model")


def metric_summary(rows: DataFrame, value: str, entity: str, by: list[str]) -> DataFrame:
    """(by..., n, mean, std, median, entity_mean): finite values only; std is null for a single value.

    entity_mean: the mean over entities of their own means.
    """
    good = rows.where(finite(F.col(value)))
    flat = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    flat = with_quantiles(flat, good, by, value, {"median": 0.5})
    entities = good.groupBy(*by, entity).agg(F.avg(value).alias("__m")).groupBy(*by).agg(F.avg("__m").alias("entity_mean"))
    return flat.join(entities, by)


def group_median(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, median): nulls of the value do not count; a null category is a category."""
    return group_quantiles(rows, [by], value, [0.5]).select(by, "n", F.get("q", 0).alias("median"))


def five_numbers(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., lo, q25, q50, q75, hi) of the non-null values."""
    flat = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return with_quantiles(flat, rows, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def case_summary(rows: DataFrame, metrics: list[str], entity: str, by: list[str], replicates: int, seed: str, intervals: list[str]) -> DataFrame:
    """(by..., metric, cases, entities, finite_cases, nonfinite_cases, mean, std, median, entity_mean, lo, hi) of all groups.

    All metrics are stacked and summarised together. Only finite values count, std is null for one value, entity_mean is
    the mean over entities of their means; lo and hi, for the metrics in `intervals`, are the 95 % interval of the mean when
    the group's entities are drawn with replacement (null with 50 replicates or fewer).
    """
    keys = [*by, "metric"]
    stacked = rows.select(*by, entity, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("s")).select(*by, entity, "s.metric", F.when(finite(F.col("s.x")), F.col("s.x")).alias("x"))
    stacked = checkpointed(stacked)
    per = stacked.groupBy(*keys, entity).agg(F.count(F.lit(1)).alias("cases"), F.count("x").alias("finite"), F.avg("x").alias("m"))
    entities = per.groupBy(*keys).agg(F.sum("cases").alias("cases"), F.count(F.lit(1)).alias("entities"), F.sum("finite").alias("finite_cases"), F.avg("m").alias("entity_mean"))
    flat = stacked.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    flat = with_quantiles(flat.join(entities, keys), stacked, keys, "x", {"median": 0.5})
    ends = clustered_mean(stacked.where(F.col("metric").isin(intervals)), "x", entity, replicates, seed, keys).select(*keys, "lo", "hi")
    return flat.join(ends, keys, "left").select(*keys, "cases", "entities", "finite_cases", (F.col("cases") - F.col("finite_cases")).alias("nonfinite_cases"), "mean", "std", "median", "entity_mean", "lo", "hi")


def change_agreement(rows: DataFrame, predicted: str, target: str, by: list[str], least: int = 3) -> DataFrame:
    """(by..., pairs, rho, direction): rank correlation (null below `least` pairs) and equal signs of finite changes."""
    good = checkpointed(rows.where(finite(F.col(predicted)) & finite(F.col(target))).select(*by, predicted, target))
    flat = good.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.signum(predicted) == F.signum(target)).cast("double")).alias("direction"))
    return flat.join(spearman(good, predicted, target, by), by, "left").select(*by, "pairs", F.when(F.col("pairs") >= least, F.col("rho")).alias("rho"), "direction")


def list_counts(rows: DataFrame, values_json: Column, below: float) -> DataFrame:
    """One row (lists, values, below, zero) over the numbers of JSON lists; what is no number does not count, a text that is
    no list is an empty list."""
    numbers = F.filter(F.transform(F.from_json(values_json, "array<string>"), lambda s: s.try_cast("double")), lambda v: v.isNotNull())
    each = rows.select(F.coalesce(numbers, F.array().cast("array<double>")).alias("v"))
    n = lambda keep: F.coalesce(F.sum(F.size(F.filter("v", keep))), F.lit(0))
    return each.agg(F.count(F.lit(1)).alias("lists"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values"), n(lambda v: v < below).alias("below"), n(lambda v: v == 0).alias("zero"))


def bootstrap(rows: DataFrame, entity: str, replicates: int, seed: str, estimator: Callable[[DataFrame, str], DataFrame] | None = None, function: Callable[[pd.DataFrame], float] | None = None) -> DataFrame:
    """(replicates, lo, hi) of any estimator over entities drawn with replacement (as many as there are).

    estimator(weighted rows with the columns replicate and times, "replicate") -> (replicate, estimate) stays in Spark. A
    function of a pandas frame gets one replicate's rows, each repeated as often as drawn; a replicate is one group there,
    so it must fit a task. The interval needs more than 50 finite estimates.
    """
    drawn = rows.join(bootstrap_weights(rows, entity, replicates, seed), entity)
    if estimator is not None:
        return interval(estimator(drawn, "replicate"), "estimate")
    if function is None:
        raise ValueError("an estimator or a function is needed")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        repeated = frame.loc[frame.index.repeat(frame["times"])]
        return pd.DataFrame({"replicate": [frame["replicate"].iloc[0]], "estimate": [float(function(repeated))]})

    return interval(drawn.groupBy("replicate").applyInPandas(one, "replicate int, estimate double"), "estimate")


def median_survival(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., median): the first time at which survival is at most one half; null where it never is."""
    return curve.groupBy(*(by or [])).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time_yr"))).alias("median"))
