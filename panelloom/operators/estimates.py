"""Bootstrap weights, calibration, survival strata, noise consensus, padded grids and overlapping tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.groups import group_quantiles, group_totals
from panelloom.functions.seed import keyed_fraction
from panelloom.functions.spread import checkpointed, quantiles, running_totals, shuffled
from panelloom.operators import scores, voxel


def bootstrap_weights(rows: DataFrame, entity: str, replicates: int, seed: str, by: list[str] | None = None, carried: list[str] | None = None) -> DataFrame:
    """(by..., entity, replicate, times, carried...): every replicate draws as many entities as there are, with replacement.

    Entities are numbered from 0 in their order (inside each group of `by`). Draw j of a replicate, one for each of the n
    entities, takes number floor(u n), where u comes from md5(seed:replicate:j): an exact multinomial draw whose times sum
    to n. Draws are made and counted in parallel, no replicate is a list; groups of as many entities have the same draws, so
    these are made once, and dealt once by the entity's number. Entities that a replicate leaves out have no row; null
    entities and null keys are left out. Columns of `carried` come along; rows has one row per group and entity then.
    """
    by, carried = by or [], carried or []
    known = (rows.select(*by, entity, *carried) if carried else rows.select(*by, entity).distinct()).na.drop(subset=[*by, entity])
    if by:
        numbered = group_totals(known, by, [entity], {"__k": F.lit(1)})
        sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        numbered = checkpointed(numbered.join(sizes, by))
    else:
        numbered = checkpointed(running_totals(known, entity, {"__k": F.lit(1)}))
        numbered = numbered.withColumn("__n", F.lit(numbered.count()).cast("long"))
    numbered = numbered.withColumn("__k", (F.col("__k") - 1).cast("long"))
    places = checkpointed(numbered.select("__n", "__k").distinct())
    # The entities are few rows in few partitions, the draws are not.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, places.count() * replicates // 2_000_000)
    draws = places.repartition(tasks).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    place = F.floor(keyed_fraction(seed, F.col("replicate"), F.col("__k")) * F.col("__n")).cast("long")
    times = draws.select("__n", place.alias("__k"), "replicate").repartition(tasks, "__n", "__k").groupBy("__n", "__k", "replicate").agg(F.count(F.lit(1)).alias("times"))
    return times.join(shuffled(numbered), ["__n", "__k"]).select(*by, entity, "replicate", "times", *carried)


def interval(estimates: DataFrame, column: str, least: int = 50) -> DataFrame:
    """(replicates, lo, hi): 95 % of the finite estimates, null unless there are more than `least`."""
    good = F.when(F.col(column).isNotNull() & ~F.isnan(column), F.col(column))
    q = F.percentile(good, F.array(F.lit(0.025), F.lit(0.975)))
    rows = estimates.agg(F.count(good).alias("replicates"), q.alias("q"))
    enough = F.col("replicates") > least
    return rows.select("replicates", F.when(enough, F.get("q", 0)).alias("lo"), F.when(enough, F.get("q", 1)).alias("hi"))


def bootstrap_auc(cases: DataFrame, entity: str, replicates: int, seed: str) -> DataFrame:
    """Cluster bootstrap interval of the AUC. Cases are counted per (entity, p, y) before they meet the replicates."""
    counts = cases.groupBy(entity, "p", "y").agg(F.count(F.lit(1)).alias("__n"))
    drawn = counts.join(bootstrap_weights(cases, entity, replicates, seed), entity)
    w = F.col("__n") * F.col("times")
    per = drawn.groupBy("replicate", "p").agg(F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg"))
    return interval(scores.area_of_counts(per, ["replicate"]), "auc")


def calibration_line(cases: DataFrame) -> DataFrame:
    """(slope, intercept) of a logistic regression of y on logit(p), unpenalised; p clipped to [1e-6, 1 - 1e-6]."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    counts = cases.where("p is not null and y is not null").groupBy(F.log(p / (1 - p)).alias("x"), F.col("y").cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(counts)
    fit = LogisticRegression(weightCol="w", regParam=0.0, maxIter=200, tol=1e-10).fit(rows)
    return cases.sparkSession.range(1).select(F.lit(float(fit.coefficients[0])).alias("slope"), F.lit(float(fit.intercept)).alias("intercept"))


def survival_by_quantile(survival: DataFrame, value: str, strata: int, years: list[float]) -> DataFrame:
    """(stratum, year, survival): Kaplan-Meier per quantile stratum 0..strata-1 of `value`, right-closed."""
    edges = quantiles(survival, value, [i / strata for i in range(1, strata)])
    rows = survival.where(F.col(value).isNotNull()).withColumn("stratum", sum(((F.col(value) > e).cast("int") for e in edges), F.lit(0)))
    return scores.survival_at(scores.kaplan_meier(rows, ["stratum"]), years, ["stratum"])


def consensus(*sigmas: Column) -> Column:
    """The middle of an odd number of estimates; null where one is null."""
    known = sigmas[0].isNotNull()
    for s in sigmas[1:]:
        known = known & s.isNotNull()
    return F.when(known, F.element_at(F.array_sort(F.array(*sigmas)), len(sigmas) // 2 + 1))


def single_measure(sigma_pair: Column) -> Column:
    """Noise of one measurement from that of a difference of two."""
    return sigma_pair / math.sqrt(2.0)


def variation_percent(sigma: Column) -> Column:
    """Coefficient of variation of a log-normal error, in percent."""
    return 100.0 * F.sqrt(F.exp(sigma * sigma) - 1.0)


def stratified_noise(rows: DataFrame, value: str, strata: dict[str, Column], least_entities: int = 10) -> DataFrame:
    """(label, stratum, n, entities, sd): robust deviation in every stratum of every label with enough entities."""
    melted = rows.select("entity_id", value, F.explode(F.array(*[F.struct(F.lit(k).alias("label"), c.cast("string").alias("stratum")) for k, c in strata.items()])).alias("s")).select("entity_id", value, "s.*").where("stratum is not null")
    sd = scores.robust_sd(melted, value, ["label", "stratum"])
    entities = melted.groupBy("label", "stratum").agg(F.countDistinct("entity_id").alias("entities"))
    return sd.join(entities, ["label", "stratum"]).where(F.col("entities") >= least_entities)


def log_ratio_summary(pairs: DataFrame, measured: Column, native: Column, least: int = 10) -> DataFrame:
    """(n, mean, sd, p05, p95) of ln(measured / native) over pairs where both are above 0; null below `least` pairs."""
    rows = pairs.where((measured > 0) & (native > 0)).select(F.log(measured / native).alias("r"))
    stats = rows.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")).crossJoin(F.broadcast(group_quantiles(rows, [], "r", [0.05, 0.95])))
    enough = F.col("n") >= least
    return stats.select("n", *[F.when(enough, c).alias(name) for name, c in (("mean", F.col("mean")), ("sd", F.col("sd")), ("p05", F.get("q", 0)), ("p95", F.get("q", 1)))])


def padded_size(size: Column | int, least: int, divisor: int) -> Column:
    """The least multiple of `divisor` that is neither below `size` nor below `least`."""
    size = F.lit(size) if isinstance(size, int) else size
    return (F.ceil(F.greatest(size, F.lit(least)) / divisor) * divisor).cast("int")


def pad(mask: DataFrame, size: int, least: int, divisor: int) -> DataFrame:
    """The mask in the middle of its padded grid; never cropped. The grid's size is added as `size`."""
    new = padded_size(size, least, divisor)
    shift = F.floor((new - size) / 2).cast("int")
    return mask.select(*voxel.KEY, *[(F.col(c) + shift).alias(c) for c in voxel.VOXEL], new.alias("size"))


def evaluate(predictions: dict[str, DataFrame], target: DataFrame, spacing: tuple[float, float, float] | None = None) -> DataFrame:
    """(method, case_id, n_a, n_b, n_both, dice, signed_rvd, abs_rvd): every method's masks against the target.

    With a spacing also hd95, null where a surface is empty.
    """
    out = None
    for method, mask in predictions.items():
        rows = voxel.overlap(mask, target)
        if spacing is not None:
            rows = rows.join(shuffled(voxel.hd95(mask, target, spacing)), "case_id", "left")
        rows = rows.withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out


def tile_weight(offset: Column, patch: int, sigma_scale: float = 0.125) -> Column:
    """Gaussian weight of a place in a tile, 1 at the centre and never 0."""
    d = (offset - patch // 2) / (sigma_scale * patch)
    return F.greatest(F.exp(-0.5 * d * d), F.lit(1e-12))


def merge_tiles(tiles: DataFrame, key: str, patch: int) -> DataFrame:
    """(key, place, value): weighted mean of the tiles (key, start, offset, value) that cover a place."""
    w = tile_weight(F.col("offset"), patch)
    rows = tiles.select(key, (F.col("start") + F.col("offset")).alias("place"), w.alias("w"), (w * F.col("value")).alias("wv"))
    return rows.groupBy(key, "place").agg((F.sum("wv") / F.sum("w")).alias("value"))
