"""Longitudinal window operators over a panel (entity_id, obs_id, t, v, crossed, post, absent).

Every operator partitions by entity and orders by (t, obs_id); one shuffle on entity_id serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def ENTITY():  # noqa: N802
    return Window.partitionBy("entity_id")


def W():  # noqa: N802
    return ENTITY().orderBy("t", "obs_id")


def SO_FAR():  # noqa: N802
    return W().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ordinal(panel: DataFrame) -> DataFrame:
    """Adds ord (0-based) and is_first."""
    return panel.withColumn("ord", F.row_number().over(W()) - 1).withColumn("is_first", F.col("ord") == 0)


def cumulative_time(panel: DataFrame, gap: str = "gap") -> DataFrame:
    """Adds elapsed, the running sum of the gaps (a missing first gap counts 0), and bad_gap for later ones missing or <= 0."""
    later = F.row_number().over(W()) > 1
    return panel.withColumn("elapsed", F.sum(F.coalesce(F.col(gap), F.lit(0.0))).over(SO_FAR())).withColumn("bad_gap", later & (F.col(gap).isNull() | (F.col(gap) <= 0)))


def with_gap(panel: DataFrame) -> DataFrame:
    return panel.withColumn("gap", F.col("t") - F.lag("t").over(W()))


def since_baseline(panel: DataFrame) -> DataFrame:
    """Adds since = t minus the entity's first time, null where any time of the entity is unknown."""
    return panel.withColumn("since", F.when(F.count("t").over(ENTITY()) == F.count(F.lit(1)).over(ENTITY()), F.col("t") - F.min("t").over(ENTITY())))


def transition(panel: DataFrame, signed: str, state: str) -> DataFrame:
    """Adds switched: signed passes from below to at least zero, or state turns true; false on an entity's first row."""
    sign = (F.lag(signed).over(W()) < 0) & (F.col(signed) >= 0)
    turned = ~F.lag(state).over(W()) & F.col(state)
    return panel.withColumn("switched", F.coalesce(sign, F.lit(False)) | F.coalesce(turned, F.lit(False)))


def consecutive(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their predecessor's columns as prev_*; an entity's first row is dropped."""
    before = F.lag(F.struct(*columns)).over(W())
    return panel.withColumn("__prev", before).where("__prev is not null").select("*", *[F.col(f"__prev.{c}").alias(f"prev_{c}") for c in columns]).drop("__prev")


def noise_pairs(panel: DataFrame) -> DataFrame:
    """Pairs of equal state without intervention, absence or non-positive values: log ratio, geometric mean, years."""
    pairs = consecutive(panel, ["obs_id", "t", "v", "post", "absent", "cls"])
    usable = ~F.coalesce("crossed", F.lit(False)) & ~F.col("absent") & ~F.col("prev_absent") & (F.col("v") > 0) & (F.col("prev_v") > 0) & (F.col("post") == F.col("prev_post"))
    return pairs.where(usable).select(
        "entity_id",
        "obs_id",
        "post",
        ((F.col("t") - F.col("prev_t")) / 365.25).alias("dt_yr"),
        F.log(F.col("v") / F.col("prev_v")).alias("y"),
        F.sqrt(F.col("v") * F.col("prev_v")).alias("gm"),
        (F.col("cls") != F.col("prev_cls")).alias("cls_switch"),
    )


def rate_pairs(panel: DataFrame) -> DataFrame:
    """Pairs without intervention or absence, whatever their state: log rate per day (null on a zero gap)."""
    pairs = consecutive(panel, ["t", "v", "absent"])
    usable = ~F.coalesce("crossed", F.lit(False)) & ~F.col("absent") & ~F.col("prev_absent") & (F.col("v") > 0) & (F.col("prev_v") > 0)
    days = F.col("t") - F.col("prev_t")
    return pairs.where(usable).select("entity_id", "obs_id", F.when(days > 0, F.log(F.col("v") / F.col("prev_v")) / days).alias("log_rate"))


def natural_pairs(panel: DataFrame) -> DataFrame:
    """Pairs whose two ends both precede treatment: relative change and annual rate."""
    pairs = consecutive(panel, ["t", "v", "absent", "post"])
    usable = ~F.coalesce("crossed", F.lit(False)) & ~F.col("post") & ~F.col("prev_post") & ~F.col("absent") & ~F.col("prev_absent") & (F.col("v") > 0) & (F.col("prev_v") > 0)
    years = (F.col("t") - F.col("prev_t")) / 365.25
    return pairs.where(usable).select("entity_id", "obs_id", ((F.col("v") - F.col("prev_v")) / F.col("prev_v")).alias("rel"), F.when(years > 0, F.log(F.col("v") / F.col("prev_v")) / years).alias("rate_yr"))


def rolling_tuples(panel: DataFrame, k: int = 3, carry: tuple[str, ...] = ("obs_id", "t", "v", "crossed", "post", "absent")) -> DataFrame:
    """One row per k consecutive observations: column c of member i is c_i, tuple_id joins the observation ids."""
    own = F.struct(*carry)
    members = [own, *[F.lead(own, i).over(W()) for i in range(1, k)]]
    rows = panel.select("entity_id", *[m.alias(f"__{i}") for i, m in enumerate(members)]).where(f"__{k - 1} is not null")
    columns = [F.col(f"__{i}.{c}").alias(f"{c}_{i + 1}") for i in range(k) for c in carry]
    tuple_id = F.concat_ws("__", *[F.col(f"__{i}.obs_id").cast("string") for i in range(k)])
    return rows.select("entity_id", tuple_id.alias("tuple_id"), *columns)


def exclusion_reasons(tuples: DataFrame, k: int = 3) -> DataFrame:
    """Adds reasons (array, several may hold), unknown (an intervention flag after the first member is null)."""
    later = range(2, k + 1)
    crossed = F.array(*[F.coalesce(F.col(f"crossed_{i}"), F.lit(False)) for i in later])
    every = range(1, k + 1)
    any_of = lambda a: F.exists(a, lambda x: x)
    reasons = F.array_compact(
        F.array(
            F.when(any_of(crossed), F.lit("intervention")),
            F.when(any_of(F.array(*[F.col(f"absent_{i}") for i in every])), F.lit("absent")),
            F.when(any_of(F.array(*[F.col(f"v_{i}") <= 0 for i in every])), F.lit("empty")),
        )
    )
    unknown = any_of(F.array(*[F.col(f"crossed_{i}").isNull() for i in later]))
    return tuples.withColumn("reasons", reasons).withColumn("unknown", unknown)


def tuple_table(panel: DataFrame) -> DataFrame:
    """Triples without exclusion: values, gaps and the composition of their states."""
    rows = exclusion_reasons(rolling_tuples(panel)).where(F.size("reasons") == 0)
    n_post = sum(F.col(f"post_{i}").cast("int") for i in (1, 2, 3))
    state = F.when(n_post == 0, "all_pre").when(n_post == 3, "all_post").otherwise("mixed")
    return rows.select("entity_id", "tuple_id", F.col("v_1").alias("v1"), F.col("v_2").alias("v2"), F.col("v_3").alias("v3"), (F.col("t_2") - F.col("t_1")).alias("dt1"), (F.col("t_3") - F.col("t_2")).alias("dt2"), state.alias("state"), "unknown")


def initial_run(panel: DataFrame, stop_at_post: bool = True, at_least: int = 2) -> DataFrame:
    """The longest prefix of each entity before a break, if it has at_least rows.

    Breaks: an intervention after the first row, an absent or empty value and (stop_at_post) a treated state.
    """
    broken = (F.coalesce("crossed", F.lit(False)) & (F.row_number().over(W()) > 1)) | F.col("absent") | (F.col("v") <= 0)
    if stop_at_post:
        broken = broken | F.col("post")
    flagged = panel.withColumn("__broken", broken.cast("int"))
    kept = flagged.withColumn("__stopped", F.max("__broken").over(SO_FAR())).where("__stopped = 0").drop("__broken", "__stopped")
    return kept.withColumn("run_length", F.count(F.lit(1)).over(ENTITY())).where(F.col("run_length") >= at_least)


def restartable_runs(panel: DataFrame) -> DataFrame:
    """Runs that restart: an unusable row ends a run and belongs to none, a usable row after an intervention starts one."""
    usable = ~F.col("absent") & (F.col("v") > 0)
    starts = F.coalesce("crossed", F.lit(False)) | ~usable
    marked = panel.withColumn("__usable", usable).withColumn("run_id", F.sum(starts.cast("int")).over(SO_FAR()))
    return marked.where("__usable").drop("__usable")


def history_features(runs: DataFrame) -> DataFrame:
    """Instances inside a run: from observation k to the next, with what was known at k.

    n_prior, has_prev, last rate per year, span and OLS slope of log v over the run so far, and the horizon.
    """
    run = Window.partitionBy("entity_id", "run_id").orderBy("t", "obs_id")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_v, years = F.log("v"), F.col("t") / 365.25
    gap = (F.col("t") - F.lag("t").over(run)) / 365.25
    last = F.when(gap > 0, (log_v - F.log(F.lag("v").over(run))) / gap)
    # Times are counted from the entity's first day of the run, which keeps the sums small.
    base = runs.withColumn("ty", years - F.first(years).over(so_far)).withColumn("ly", log_v)
    out = base.select(
        "entity_id",
        "obs_id",
        "run_id",
        (F.row_number().over(run) - 1).alias("n_prior"),
        (F.row_number().over(run) > 1).alias("has_prev"),
        F.coalesce(last, F.lit(0.0)).alias("last_rate_yr"),
        F.col("ty").alias("t_run_yr"),
        F.coalesce(F.regr_slope("ly", "ty").over(so_far), F.lit(0.0)).alias("run_rate_yr"),
        ((F.lead("t").over(run) - F.col("t")) / 365.25).alias("horizon_yr"),
        F.log(F.lead("v").over(run) / F.col("v")).alias("y"),
    )
    return out.where("y is not null and horizon_yr > 0").withColumn("last_rate_x_horizon", F.col("last_rate_yr") * F.col("horizon_yr"))


def is_event(v_from: Column, v_to: Column, relative: float | Column, floor: float = 0.0) -> Column:
    """Growth of at least `relative` of the start and at least `floor` in absolute terms."""
    return (((v_to - v_from) / v_from) >= relative) & ((v_to - v_from) >= floor)


def event_intervals(run: DataFrame, relative: float, floor: float = 0.0) -> DataFrame:
    """Intervals of initial runs with their event label, the mirrored shrink label and whether one event came before."""
    nxt = F.lead("v").over(W())
    grown = is_event(F.col("v"), nxt, relative, floor)
    shrunk = is_event(nxt, F.col("v"), relative, floor)
    rows = run.select("entity_id", "obs_id", "t", "v", nxt.alias("v_next"), (F.lead("t").over(W()) - F.col("t")).alias("horizon_days"), grown.alias("event"), shrunk.alias("mirrored_shrink"))
    prior = F.coalesce(F.max(F.col("event").cast("int")).over(W().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("prior_growth", prior == 1).where("v_next is not null")


def survival(run: DataFrame, relative: float, floor: float = 0.0) -> DataFrame:
    """(entity_id, time_yr, event, log_v0, n_obs): time to the first event against the first value, right-censored."""
    start = F.first("v").over(SO_FAR())
    rows = run.withColumn("years", (F.col("t") - F.first("t").over(SO_FAR())) / 365.25).withColumn("v0", start).withColumn("hit", is_event(F.col("v0"), F.col("v"), relative, floor))
    first_hit = F.min(F.when(F.col("hit"), F.col("years")))
    return rows.groupBy("entity_id").agg(F.greatest(F.coalesce(first_hit, F.max("years")), F.lit(1e-3)).alias("time_yr"), first_hit.isNotNull().cast("int").alias("event"), F.log(F.max("v0")).alias("log_v0"), F.count(F.lit(1)).alias("n_obs"))


def usable_samples(run_lengths: DataFrame, ks: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Per k: entities whose prefix has at least k rows and the number of k-tuples they give."""
    rows = run_lengths.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("n >= k")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.col("n") - F.col("k") + 1).alias("samples"))


def first_rows(panel: DataFrame) -> DataFrame:
    return panel.withColumn("__rank", F.row_number().over(W())).where("__rank = 1").drop("__rank")


def month_fraction(panel: DataFrame, day: str, cap: float = 95.0) -> DataFrame:
    """Adds months since the entity's first date: 12 per year, 1 per month, 1/30 per day, at most cap."""
    start = F.first(day).over(SO_FAR())
    months = (F.year(day) - F.year(start)) * 12 + (F.month(day) - F.month(start)) + (F.dayofmonth(day) - F.dayofmonth(start)) / 30.0
    return panel.withColumn("months", F.least(months, F.lit(cap)))


def temporal_encoding(interval: Column, order: int, scale: float) -> Column:
    """sin and cos of pi 2**k interval / scale for k < order, interleaved."""
    waves = F.transform(F.sequence(F.lit(0), F.lit(order - 1)), lambda k: F.lit(3.141592653589793) * F.pow(F.lit(2.0), k) * interval / scale)
    return F.flatten(F.transform(waves, lambda w: F.array(F.sin(w), F.cos(w))))


def anchored_tuples(panel: DataFrame) -> DataFrame:
    """(first, second, later) for every later observation of an entity."""
    rows = ordinal(panel).select("entity_id", "obs_id", "ord")
    first = F.max(F.when(F.col("ord") == 0, F.col("obs_id"))).over(ENTITY())
    second = F.max(F.when(F.col("ord") == 1, F.col("obs_id"))).over(ENTITY())
    return rows.withColumn("a", first).withColumn("b", second).where("ord >= 2").select("entity_id", "a", "b", F.col("obs_id").alias("c"))


def ordered_combinations(panel: DataFrame) -> DataFrame:
    """All i < j < k of an entity, by joins inside the entity."""
    rows = ordinal(panel).select("entity_id", "obs_id", "ord")
    side = lambda n: rows.select("entity_id", F.col("obs_id").alias(n), F.col("ord").alias(f"o{n}"))
    return side("a").join(side("b"), "entity_id").where("oa < ob").join(side("c"), "entity_id").where("ob < oc").select("entity_id", "a", "b", "c")
