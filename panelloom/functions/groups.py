"""Orders inside many groups at once, of which one may hold nearly all rows: running totals, exact quantiles, dominance counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.spread import checkpointed

#: Values of a group up to which its quantiles are taken in one aggregation.
SMALL = 1_000_000
#: Bits of an order statistic that one pass settles.
DIGIT = 8


def group_totals(rows: DataFrame, by: list[str], order: list[str], totals: dict[str, Column], descending: bool = False) -> DataFrame:
    """Adds, per name, the sum of an expression over the rows of the same group up to and with this one.

    `order` is unique inside a group. Rows are dealt by ranges of (by, order), so a group takes as many ranges as it has
    rows for; sums before a range come from one row per group and range. No column of `by` is null.
    """
    ordered = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    dealt = checkpointed(rows.repartitionByRange(*by, *ordered).withColumn("__r", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(*by, "__r").agg(*[F.sum(c).alias(f"__{n}") for n, c in totals.items()])
    offsets = per.select(*by, "__r", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals])
    inside = Window.partitionBy(*by, "__r").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()})
    return summed.join(offsets, [*by, "__r"]).withColumns({n: F.col(n) + F.col(f"__{n}") for n in totals}).drop("__r", *[f"__{n}" for n in totals])


def _images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Longs in the order of the doubles of column x."""
    for frame in batches:
        bits = np.ascontiguousarray(frame["x"].to_numpy(np.float64) + 0.0).view(np.int64)
        yield frame.assign(image=np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


def _between(low: Column, high: Column, place: Column) -> Column:
    return low + (high - low) * (place - F.floor(place))


def group_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], small: int | None = None) -> DataFrame:
    """(by..., n, q): count and exact, linearly interpolated quantiles (array q) of the non-null values per group.

    Groups without a value have n = 0 and null quantiles; null keys are a group. Groups of up to `small` values take one
    aggregation. In the others the order statistics of all groups are found together: values become longs of the same
    order, a pass counts them by their next 8 bits inside the ranges that are still in question, and once such a range has
    at most `small` values these are ranked.
    """
    small = SMALL if small is None else small
    v = F.col(value).cast("double")
    counts = rows.groupBy(*by).agg(F.count(v).alias("n"))
    plain = F.percentile(v, F.array(*[F.lit(float(q)) for q in shares]))
    large = counts.where(F.col("n") > small).select(*by, "n").withColumn("__g", F.xxhash64(F.to_json(F.struct(*by))) if by else F.lit(0).cast("long"))
    held = checkpointed(large)
    if held.isEmpty():
        return rows.groupBy(*by).agg(F.count(v).alias("n"), plain.alias("q"))
    # There is at most one large group in `small` rows, so the table of them is broadcast.
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"__l.{c}").eqNullSafe(F.col(f"__v.{c}"))
    rest = rows.alias("__v").join(F.broadcast(held.alias("__l")), same, "left_anti") if by else rows.limit(0)
    usual = rest.groupBy(*by).agg(F.count(v).alias("n"), plain.alias("q")) if by else None
    found = rows.select(*by, v.alias("x")).where("x is not null").alias("__v").join(F.broadcast(held.alias("__l")), same).select("__g", "x")
    images = checkpointed(found.mapInPandas(_images, "__g long, x double, image long"))
    place = F.col("share") * (F.col("n") - 1)
    wanted = held.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares]))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    state = wanted.select("__g", F.col("rank").alias("wanted"), "rank", F.lit(0).cast("long").alias("prefix"), F.col("n").alias("inside")).distinct()
    done, shift = [], 64
    while True:
        state = checkpointed(state)
        ready = state.where(F.col("inside") <= small) if shift else state
        done.append(_ranked(images, ready, shift))
        state = state.where(F.col("inside") > small) if shift else state.limit(0)
        if not shift or state.isEmpty():
            break
        shift -= DIGIT
        state = _narrowed(images, state, shift)
    ranked = done[0]
    for part in done[1:]:
        ranked = ranked.unionByName(part)
    values = ranked.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("wanted", "x"))).alias("at"))
    place_of = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    quantiles = F.array(*[_between(F.element_at("at", F.floor(place_of(q))), F.element_at("at", F.ceil(place_of(q))), place_of(q)) for q in shares])
    crowded = held.join(values, "__g").select(*by, "n", quantiles.alias("q"))
    return crowded if usual is None else usual.unionByName(crowded)


def _prefix(shift: int) -> Column:
    return F.shiftright("image", shift) if shift < 64 else F.lit(0).cast("long")


def _narrowed(images: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """The ranges of 8 more bits that hold the wanted ranks, with the ranks inside them."""
    open_ranges = F.broadcast(state.select("__g", "prefix").distinct())
    digits = images.withColumn("prefix", _prefix(shift + DIGIT)).join(open_ranges, ["__g", "prefix"]).groupBy("__g", "prefix", _prefix(shift).alias("next")).agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("__g", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    upto = digits.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    met = state.join(upto, ["__g", "prefix"]).where("rank >= before and rank < before + k")
    return met.select("__g", "wanted", (F.col("rank") - F.col("before")).alias("rank"), F.col("next").alias("prefix"), F.col("k").alias("inside"))


def _ranked(images: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """(__g, wanted, x) of the ranges that are small enough, or that hold one value only (no bit is left)."""
    keyed = images.withColumn("prefix", _prefix(shift)).join(F.broadcast(state.select("__g", "prefix").distinct()), ["__g", "prefix"])
    if shift == 0:
        one = keyed.groupBy("__g", "prefix").agg(F.min("x").alias("x"))
        return state.join(one, ["__g", "prefix"]).select("__g", "wanted", "x")
    counts = keyed.groupBy("__g", "prefix", "image").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy("__g", "prefix").orderBy("image").rowsBetween(Window.unboundedPreceding, 0)))
    return state.join(upto, ["__g", "prefix"]).where("rank >= upto - k and rank < upto").select("__g", "wanted", "x")


def dominance(second: np.ndarray, weight: np.ndarray, count: np.ndarray) -> float:
    """Sum of weight[a] * count[b] over b after a in the order of the rows with a smaller `second`: counted while merging."""
    total, size, n = 0.0, 1, len(second)
    place = np.arange(n)
    while size < n:
        block = place // (2 * size)
        order = np.lexsort((second, block))
        right = (order // size) % 2 == 1
        upto = np.cumsum(np.where(right, count[order], 0))
        start = np.searchsorted(block[order], block[order], side="left")
        before = np.where(start > 0, upto[start - 1], 0)
        total += float(np.sum(np.where(right, 0, weight[order]) * (upto - before), dtype=np.float64))
        size *= 2
    return total


def count_dominated(rows: DataFrame, by: str, first: list[str], second: list[str], weight: str, count: str, leaf: int = 1 << 17, fan: int = 16) -> DataFrame:
    """(by, total): per group the sum of weight[a] * count[b] over pairs with b after a by `first` and before a by `second`.

    Both orders are unique in a group. A group of up to `leaf` rows is counted while merging, in one task. A larger one is
    cut by `first` into `fan` parts: pairs of different parts are counted from running totals of the parts in the order of
    `second`, a part is then a group of its own. Work and rows are n log n whatever the groups are.
    """
    spark = rows.sparkSession
    left = checkpointed(rows.select(F.col(by).alias("__by"), *dict.fromkeys([*first, *second]), F.col(weight).cast("double").alias("__w"), F.col(count).cast("double").alias("__c")).withColumn("__node", F.xxhash64("__by")))
    out = spark.createDataFrame([], left.select("__by", F.lit(0.0).alias("total")).schema)

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(first)
        rank = np.empty(len(frame), dtype=np.int64)
        rank[np.lexsort([frame[c].to_numpy() for c in reversed(second)])] = np.arange(len(frame))
        return pd.DataFrame({"__by": frame["__by"].iloc[:1].to_numpy(), "total": [dominance(rank, frame["__w"].to_numpy(), frame["__c"].to_numpy())]})

    while True:
        sizes = left.groupBy("__node").agg(F.count(F.lit(1)).alias("__n"))
        large = F.broadcast(checkpointed(sizes.where(F.col("__n") > leaf)))
        out = out.unionByName(left.join(large, "__node", "left_anti").groupBy("__node").applyInPandas(counted, out.schema))
        if large.isEmpty():
            break
        cut = group_totals(left.join(large, "__node"), ["__node"], first, {"__upto": F.lit(1)}).withColumn("__part", F.floor((F.col("__upto") - 1) * fan / F.col("__n")).cast("int"))
        totals = {f"__s{k}": F.when(F.col("__part") == k, F.col("__c")).otherwise(0.0) for k in range(1, fan)}
        met = group_totals(cut, ["__node"], second, totals)
        later = sum((F.when(F.col("__part") < k, F.col(f"__s{k}")).otherwise(0.0) for k in range(1, fan)), F.lit(0.0))
        out = out.unionByName(met.groupBy("__by").agg(F.sum(F.col("__w") * later).alias("total")))
        left = checkpointed(cut.withColumn("__node", F.xxhash64("__node", "__part")).drop("__upto", "__part", "__n"))
    return out.groupBy(F.col("__by").alias(by)).agg(F.sum("total").alias("total"))
