"""Classification, survival and noise metrics.

Global orderings (ROC, Kaplan-Meier, ranks) first group by the distinct ordering value, so that what a window sees is
one row per value, not per case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.groups import count_dominated, dominance, group_quantiles, group_totals
from panelloom.functions.numbers import normal_cdf
from panelloom.functions.seed import keyed_fraction
from panelloom.functions.spread import by_ranges, checkpointed, quantiles, range_totals, running_totals


def auc(cases: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """(by..., auc): area under the ROC curve with ties as one half; null if a class is missing."""
    per = cases.groupBy(*(by or []), p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    return area_of_counts(per.withColumnRenamed(p, "p"), by or [])


def area_of_counts(per: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auc) of counts (by..., p, pos, neg), one row per distinct p of a group; keys of `by` are not null."""
    ranked = group_totals(per, by, ["p"], {"upto": F.col("neg")}) if by else running_totals(per, "p", {"upto": F.col("neg")})
    total = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, total / pairs).alias("auc"))


def probability_scores(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, brier, log_loss) with p clipped to [1e-6, 1 - 1e-6]."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    loss = -F.avg(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))
    return cases.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg((p - F.col("y")) * (p - F.col("y"))).alias("brier"), loss.alias("log_loss"))


def calibration_error(cases: DataFrame, edges: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(ece): mean absolute gap of observed and predicted rates over quantile bins; a value on an edge goes up."""
    at = quantiles(cases, "p", list(edges))
    binned = cases.withColumn("bin", sum(((F.col("p") >= e).cast("int") for e in at), F.lit(0)))
    per = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def kaplan_meier(survival: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., time_yr, at_risk, events, survival) at each distinct time."""
    by = by or []
    per = survival.groupBy(*by, "time_yr").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))
    share = 1 - F.col("events") / F.col("at_risk")
    if not by:
        # Both totals go over the same ranges: who is at risk is the whole number less those before.
        dealt = by_ranges(per, "time_yr")
        total = dealt.agg(F.sum("n").alias("__all"))
        risk = range_totals(dealt, "time_yr", {"__upto": F.col("n")}).crossJoin(F.broadcast(total)).withColumn("at_risk", F.col("__all") - F.col("__upto") + F.col("n"))
        steps = range_totals(risk, "time_yr", {"logs": F.when(share > 0, F.log(share)).otherwise(F.lit(0.0)), "gone": (share <= 0).cast("int")})
        return steps.select("time_yr", "at_risk", "events", F.when(F.col("gone") > 0, 0.0).otherwise(F.exp("logs")).alias("survival"))
    risk = group_totals(per, by, ["time_yr"], {"at_risk": F.col("n")}, descending=True)
    steps = group_totals(risk, by, ["time_yr"], {"logs": F.when(share > 0, F.log(share)).otherwise(F.lit(0.0)), "gone": (share <= 0).cast("int")})
    return steps.select(*by, "time_yr", "at_risk", "events", F.when(F.col("gone") > 0, 0.0).otherwise(F.exp("logs")).alias("survival"))


def survival_at(curve: DataFrame, years: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., year, survival): the last value at or before each year, 1 before the first time."""
    at = curve.withColumn("year", F.explode(F.array(*[F.lit(float(y)) for y in years])))
    last = F.max(F.when(F.col("time_yr") <= F.col("year"), F.struct("time_yr", "survival")))
    return at.groupBy(*(by or []), "year").agg(F.coalesce(last["survival"], F.lit(1.0)).alias("survival"))


def concordance(cases: DataFrame, by: str, leaf: int = 1 << 17) -> DataFrame:
    """(by, c_index) over comparable pairs: an event at time a and any case with a later time; equal risks count one half.

    cases: by, time, event, risk, none of them null; null without a comparable pair. Pairs are counted, not made: those with
    a later time and a smaller risk by count_dominated, equal risks and all comparable pairs by running totals.
    """
    per = checkpointed(cases.groupBy(by, "time", "risk").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("n")))
    largest = per.groupBy(by).count().agg(F.max("count")).first()[0]
    if not largest or largest <= leaf:
        return per.groupBy(by).applyInPandas(_concordance_of_fold(by), f"`{by}` {per.schema[by].dataType.simpleString()}, c_index double")
    good = count_dominated(per, by, ["time", "risk"], ["risk", "time"], "d", "n", leaf)

    def later_cases(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Per group of `by`: the sum over events of the cases with a later time and equal keys."""
        upto = group_totals(rows, keys, ["time"], {"upto": F.col("n")})
        return upto.groupBy(*keys).agg((F.sum("n") * F.sum("d") - F.sum(F.col("d") * F.col("upto"))).cast("double").alias("pairs")).groupBy(by).agg(F.sum("pairs").alias("pairs"))

    equal = later_cases(per, [by, "risk"]).withColumnRenamed("pairs", "equal")
    every = later_cases(per.groupBy(by, "time").agg(F.sum("d").alias("d"), F.sum("n").alias("n")), [by])
    joined = every.join(good, by, "left").join(equal, by, "left")
    return joined.select(by, F.when(F.col("pairs") > 0, (F.coalesce("total", F.lit(0.0)) + F.coalesce("equal", F.lit(0.0)) / 2) / F.col("pairs")).alias("c_index"))


def _concordance_of_fold(by: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["time", "risk"])
        time, risk, d, n = (frame[c].to_numpy(np.float64) for c in ("time", "risk", "d", "n"))
        from_here = np.append(n[::-1].cumsum()[::-1], 0)
        every = float((d * from_here[np.searchsorted(time, time, side="right")]).sum())
        rank = np.empty(len(frame), dtype=np.int64)
        by_risk = np.lexsort((time, risk))
        rank[by_risk] = np.arange(len(frame))
        upto = n[by_risk].cumsum()
        last = np.searchsorted(risk[by_risk], risk[by_risk], side="right") - 1
        equal = float((d[by_risk] * (upto[last] - upto)).sum())
        return pd.DataFrame({by: frame[by].iloc[:1].to_numpy(), "c_index": [(dominance(rank, d, n) + equal / 2) / every if every else None]})

    return run


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by..., rho): correlation of average ranks inside each group; distinct values are ranked by running counts."""
    by = by or []

    def ranks(column: str) -> DataFrame:
        counts = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
        per = group_totals(counts, by, [column], {"upto": F.col("n")}) if by else running_totals(counts, column, {"upto": F.col("n")})
        return per.select(*by, column, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"rank_{column}"))

    pairs = rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(ranks(x), [*by, x]).join(ranks(y), [*by, y])
    a, b, n = F.col(f"rank_{x}"), F.col(f"rank_{y}"), F.col("n")
    # Ranks are centred by their mean, (N + 1) / 2, which the whole group's weights give.
    sums = both.groupBy(*by).agg(F.sum(n).alias("n"), *[F.sum(n * c).alias(k) for k, c in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))])
    spread = lambda u, v, uv: F.col(uv) - F.col(u) * F.col(v) / F.col("n")
    within = spread("a", "a", "aa") * spread("b", "b", "bb")
    return sums.select(*by, F.when(within > 0, spread("a", "b", "ab") / F.sqrt(within)).alias("rho"))


def cluster_bootstrap(rows: DataFrame, value: str, replicates: int, seed: str, entity: str = "entity_id", small: int = 1_000_000) -> DataFrame:
    """(mean, lo, hi): the mean of `value` with a 95 % interval from drawing as many entities as there are, with replacement.

    Per-entity sums stand for the rows; the draws are those of bootstrap_weights. A draw looks its entity's sums up in a
    broadcast table where there are up to `small` entities, and meets them in a shuffle beyond that.
    """
    sums = rows.groupBy(entity).agg(F.sum(value).alias("s"), F.count(value).alias("n")).where(F.col(entity).isNotNull())
    numbered = checkpointed(running_totals(sums, entity, {"__k": F.lit(1)}).select((F.col("__k") - 1).cast("long").alias("__k"), "s", "n"))
    count = numbered.count()
    # The entities are few rows in few partitions, the draws are not.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, count * replicates // 2_000_000)
    draws = numbered.select("__k").repartition(tasks).select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), "__k")
    place = F.floor(keyed_fraction(seed, F.col("replicate"), F.col("__k")) * F.lit(count)).cast("long")
    table = F.broadcast(numbered) if count <= small else numbered
    per = draws.select("replicate", place.alias("__k")).join(table, "__k").groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("m"))
    interval = per.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return numbered.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(F.broadcast(interval)).select("mean", F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"))


def finite_summary(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """(by..., metric, n_finite, n_nonfinite, mean, std, median) in one pass over a stacked form."""
    from panelloom.functions.numbers import finite

    stacked = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("s")).select(*by, "s.*")
    ok = stacked.withColumn("ok", F.when(finite(F.col("x")), F.col("x")))
    keys = [*by, "metric"]
    flat = ok.groupBy(*keys).agg(F.count("ok").alias("n_finite"), (F.count(F.lit(1)) - F.count("ok")).alias("n_nonfinite"), F.avg("ok").alias("mean"), F.when(F.count("ok") > 0, F.coalesce(F.stddev_samp("ok"), F.lit(0.0))).alias("std"))
    return with_quantiles(flat, ok, keys, "ok", {"median": 0.5})


def with_quantiles(flat: DataFrame, rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Adds exact quantiles of `value` per group to one row per group; null keys are a group."""
    q = group_quantiles(rows, by, value, list(shares.values()))
    named = q.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *[F.get("q", i).alias(n) for i, n in enumerate(shares)])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return (flat.join(named, same, "left") if by else flat.crossJoin(F.broadcast(named))).drop(*[f"__k{i}" for i in range(len(by))])


def subset_fan_out(rows: DataFrame, subsets: dict) -> DataFrame:
    """One row per (row, subset whose predicate holds): overlapping subsets in one pass."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in subsets.items()]))
    return rows.withColumn("subset", F.explode(names))


def robust_sd(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, sd) with sd = 1.4826 times the median absolute deviation."""
    kept = checkpointed(rows.select(*by, value))
    centre = group_quantiles(kept, by, value, [0.5]).select(*by, F.get("q", 0).alias("__m"))
    joined = (kept.join(centre, by) if by else kept.crossJoin(F.broadcast(centre))).withColumn("__away", F.abs(F.col(value) - F.col("__m")))
    return with_quantiles(joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), joined, by, "__away", {"__mad": 0.5}).select(*by, "n", (1.4826 * F.col("__mad")).alias("sd"))


def zero_interval(pairs: DataFrame, bins: int = 5, least: int = 5) -> DataFrame:
    """(variance): robust variances of y over quantile bins of dt, extrapolated to dt = 0 by weighted least squares.

    Bins of under `least` rows are left out; of fewer than 15 pairs there are two bins. Null if one bin or none is left.
    """
    if bins > 2 and pairs.limit(15).count() < 15:
        bins = 2
    edges = quantiles(pairs, "dt_yr", [i / bins for i in range(1, bins)])
    binned = pairs.withColumn("bin", sum(((F.col("dt_yr") >= e).cast("int") for e in edges), F.lit(0)))
    sd = robust_sd(binned, "y", ["bin"])
    mean = binned.groupBy("bin").agg(F.avg(F.col("dt_yr") * F.col("dt_yr")).alias("x"))
    p = sd.join(mean, "bin").where(F.col("n") >= least).withColumn("v", F.col("sd") * F.col("sd"))
    w, wx, wy = F.sum("n"), F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("v"))
    wxx, wxy = F.sum(F.col("n") * F.col("x") * F.col("x")), F.sum(F.col("n") * F.col("x") * F.col("v"))
    slope = (w * wxy - wx * wy) / (w * wxx - wx * wx)
    return p.agg(F.greatest((wy - slope * wx) / w, F.lit(0.0)).alias("variance"))


def shrinkage(pairs: DataFrame) -> DataFrame:
    """(n, rms, median_sigma, p50, p90, p95) of -y over the pairs that shrink."""
    z = pairs.where("y < 0").select((-F.col("y")).alias("z"))
    p50, p90, p95 = quantiles(z, "z", [0.5, 0.9, 0.95])
    found = z.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("rms"))
    return found.select("n", "rms", F.lit(p50 / 0.6745).alias("median_sigma"), F.lit(p50).alias("p50"), F.lit(p90).alias("p90"), F.lit(p95).alias("p95"))


def noise_thresholds(sigma: DataFrame, column: str = "sigma") -> DataFrame:
    """Adds 95 % change thresholds and the share of no-change pairs beyond 20 and 50 %."""
    s = F.col(column)
    return sigma.withColumns({"one_sided": F.exp(1.645 * s) - 1, "two_sided": F.exp(1.96 * s) - 1, "false_20": 1 - normal_cdf(F.log(F.lit(1.2)) / s), "false_50": 1 - normal_cdf(F.log(F.lit(1.5)) / s)})


def balanced_folds(entities: DataFrame, k: int, seed: str, entity: str = "entity_id", ranges: int | None = None) -> DataFrame:
    """(entity, fold): rank by md5 order, modulo k; ranks come from counts of ranges of the order, not one sorted task.

    There are four ranges per shuffle partition and 64 at least, so they grow with what the session is set up for.
    """
    from panelloom.functions.seed import keyed_order

    ranges = ranges or max(64, 4 * int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    rows = entities.select(entity).distinct().withColumn("__o", keyed_order(seed, F.col(entity))).withColumn("__r", F.floor(F.col("__o") * ranges / 4294967296.0).cast("int"))
    counts = rows.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__o", entity)) - 1
    return rows.withColumn("__in", inside).join(F.broadcast(offsets), "__r").select(entity, ((F.col("__before") + F.col("__in")) % k).cast("int").alias("fold"))


def rotation(folds: DataFrame, k: int) -> DataFrame:
    """Every row in every test fold with its role: test, validation = (f + 1) mod k, or train."""
    test = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = folds.withColumn("test_fold", test)
    return rows.withColumn("role", F.when(F.col("fold") == F.col("test_fold"), "test").when(F.col("fold") == (F.col("test_fold") + 1) % k, "validation").otherwise("train"))


def extend_folds(known: DataFrame, new: DataFrame, k: int, seed: str, entity: str = "entity_id") -> DataFrame:
    """Known entities keep their fold; new ones, in md5 order, go to the fold that is smallest at the time (ties low).

    The sequence of folds follows from k counts: it fills the folds up to the largest, then goes round.
    """
    from panelloom.functions.seed import keyed_order

    counts = {r.fold: r["count"] for r in known.groupBy("fold").count().collect()}
    filled = [counts.get(f, 0) for f in range(k)]
    # Level by level: below the largest count only the short folds take a turn.
    levels = sorted(set(filled))
    turns, start = [], 0
    for low, high in zip(levels, [*levels[1:], None]):
        short = [f for f in range(k) if filled[f] <= low]
        length = None if high is None else (high - low) * len(short)
        turns.append((start, length, short))
        start += length or 0
    fresh = new.select(entity).distinct().join(known.select(entity), entity, "left_anti")
    fresh = fresh.withColumn("__k", F.struct(keyed_order(seed, F.col(entity)).alias("o"), F.col(entity).alias("e")))
    fresh = running_totals(fresh, "__k", {"__upto": F.lit(1)}).withColumn("__p", F.col("__upto") - 1)
    fold = F.lit(None).cast("int")
    for begin, length, short in reversed(turns):
        own = F.get(F.array(*[F.lit(f) for f in short]), ((F.col("__p") - begin) % len(short)).cast("int"))
        fold = F.when(F.col("__p") >= begin, own).otherwise(fold) if length is None else F.when((F.col("__p") >= begin) & (F.col("__p") < begin + length), own).otherwise(fold)
    return known.select(entity, "fold").unionByName(fresh.select(entity, fold.alias("fold")))


def top_share(rows: DataFrame, value: str, share: float) -> DataFrame:
    """Rows at or above the (1 - share) quantile of `value`; ties at the edge stay in, nulls do not."""
    return rows.where(F.col(value) >= quantiles(rows, value, [1 - share])[0])
