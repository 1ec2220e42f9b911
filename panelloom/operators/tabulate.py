"""Counts, cross tables, fold means, confusion sums, first rows and set relations of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.seed import keyed_order
from panelloom.functions.spread import running_totals


def count_histogram(rows: DataFrame, entity: str, name: str = "entities") -> DataFrame:
    """(n, entities): how many entities have n rows; rows without an entity do not count."""
    return rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias(name))


def crosstab(rows: DataFrame, row: str, column: str, categories: list[str]) -> DataFrame:
    """One row per category of `row` and one count per listed category of `column`; other values do not count."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(c) for c in categories])


def two_stage_mean(rows: DataFrame, value: str, entity: str) -> DataFrame:
    """(mean): the mean over entities of their means; entities without a value do not count."""
    return rows.groupBy(entity).agg(F.avg(value).alias("__m")).agg(F.avg("__m").alias("mean"))


def fold_means(rows: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    """(mean, std, n): mean and deviation of the folds' means, and all values; std is null for one fold."""
    per = rows.groupBy(fold).agg(F.avg(value).alias("__m"), F.count(value).alias("__n"))
    return per.agg(F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("std"), F.sum("__n").alias("n"))


def fit_scores(rows: DataFrame, y: Column, pred: Column) -> DataFrame:
    """(mean_difference, better, r2_zero, r2): mean gain in absolute error over predicting 0, the share of rows where it is
    smaller, and R^2 against 0 and against the mean; null where the values do not vary."""
    e = y - pred
    gain = F.abs(e) - F.abs(y)
    zero, spread = F.sum(y * y), F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    share = lambda base: 1 - F.sum(e * e) / F.when(base > 0, base)
    return rows.agg(F.avg(gain).alias("mean_difference"), F.avg((gain < 0).cast("int")).alias("better"), share(zero).alias("r2_zero"), share(spread).alias("r2"))


def agreement(rows: DataFrame, event: Column, label: str) -> DataFrame:
    """(event, label, n): how often an event meets each label, nulls as they are."""
    return rows.groupBy(event.alias("event"), label).agg(F.count(F.lit(1)).alias("n"))


def soft_confusion(rows: DataFrame, y: str, p: str, by: str, smooth: float = 1e-6) -> DataFrame:
    """(by, tp, fp, fn, tn, dice): sums of p against y in [0, 1] and the smoothed overlap 2 tp / (2 tp + fp + fn)."""
    a, b = F.col(p), F.col(y)
    sums = rows.groupBy(by).agg(*[F.sum(c).alias(k) for k, c in (("tp", a * b), ("fp", a * (1 - b)), ("fn", (1 - a) * b), ("tn", (1 - a) * (1 - b)))])
    return sums.withColumn("dice", (2 * F.col("tp") + smooth) / (2 * F.col("tp") + F.col("fp") + F.col("fn") + smooth))


def minimal_files(rows: DataFrame, name: str, variant: Column, kinds: tuple[str, ...] = ("image_", "mask_")) -> DataFrame:
    """(path): per row one path <name>/<kind><variant> for every kind; rows without name or variant have none."""
    paths = F.array_compact(F.array(*[F.concat(F.col(name), F.lit(f"/{k}"), variant) for k in kinds]))
    return rows.select(F.explode(paths).alias("path"))


def inner_folds(entities: DataFrame, entity: str, outer: int, k: int, seed: str) -> DataFrame:
    """(entity, outer_fold, inner_fold): for every outer fold an inner fold by md5 of (seed, outer fold, entity)."""
    rows = entities.select(entity).distinct().withColumn("outer_fold", F.explode(F.array(*[F.lit(i) for i in range(outer)])))
    return rows.withColumn("inner_fold", (keyed_order(seed, F.col("outer_fold"), F.col(entity)) % k).cast("int"))


def fold_overlap(rows: DataFrame, fold: str, entity: str, held: int) -> DataFrame:
    """(folds, shared): the number of folds, and the entities of fold `held` that other folds have too."""
    keys = rows.select(fold, entity).distinct()
    shared = keys.groupBy(entity).agg(F.bool_or(F.col(fold) == held).alias("__in"), F.bool_or(F.col(fold) != held).alias("__out")).agg(F.count_if(F.col("__in") & F.col("__out")).alias("shared"))
    return keys.agg(F.countDistinct(fold).alias("folds")).crossJoin(F.broadcast(shared))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order, by one aggregation; ties go to the least of the other columns."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__r"))
    return first.select(*[c if c in keys else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def numbered(rows: DataFrame, order: list[Column], unique: list[str], name: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, in a stable order of several keys; `unique` columns break ties and are unique.

    Places are running counts over ranges of the order, so a sorted table of any size keeps them when it is written.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *unique)
    return running_totals(rows.withColumn("__at", key), "__at", {"__n": F.lit(1)}).withColumn(name, (F.col("__n") - 1).cast("long")).drop("__at", "__n")


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both, equal): sizes of the differences and the intersection of two key sets, in one exchange."""
    sides = a.select(key).distinct().withColumn("__s", F.lit(1)).unionByName(b.select(key).distinct().withColumn("__s", F.lit(2)))
    per = sides.groupBy(key).agg(F.sum("__s").alias("__s"))
    n = per.agg(*[F.count_if(F.col("__s") == s).alias(name) for name, s in (("only_a", 1), ("only_b", 2), ("both", 3))])
    return n.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
