"""Contract checks, flags, selection and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.spread import running_totals


def contract(panel: DataFrame) -> DataFrame:
    """One row: rows, missing required fields, repeated (entity, observation) keys, times that do not increase."""
    before = F.lag("t").over(Window.partitionBy("entity_id").orderBy("t", "obs_id"))
    missing = F.col("entity_id").isNull() | F.col("obs_id").isNull() | F.col("t").isNull()
    sums = panel.withColumn("__b", before).agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"), F.count_if(F.col("t") <= F.col("__b")).alias("not_increasing"))
    return sums.crossJoin(duplicates(panel, ["entity_id", "obs_id"]).agg(F.count(F.lit(1)).alias("repeated")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def resolve_pairs(files: DataFrame, key: str, is_image: Column, is_mask: Column) -> DataFrame:
    """Per key the number of images and masks; resolved if there is exactly one of each."""
    counts = files.groupBy(key).agg(F.count_if(is_image).alias("images"), F.count_if(is_mask).alias("masks"))
    return counts.withColumn("resolved", (F.col("images") == 1) & (F.col("masks") == 1))


def safe_path(path: Column) -> Column:
    """A relative path without parent steps or unusual characters."""
    return ~(F.startswith(path, F.lit("/")) | F.contains(path, F.lit("..")) | ~F.rlike(path, F.lit(r"^[A-Za-z0-9_./?=&#-]+$")))


def membership(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether the key is among `keys`."""
    return rows.join(keys.select(key).distinct().withColumn("__in", F.lit(True)), key, "left").withColumn(name, F.col("__in").isNotNull()).drop("__in")


def strict_flag(c: Column) -> Column:
    """Null for empty, true for 1/true/yes/y, false for 0/false/no/n, an error for anything else."""
    s = F.lower(F.trim(c))
    return F.when(c.isNull() | (s == ""), F.lit(None).cast("boolean")).when(s.isin("1", "true", "yes", "y"), True).when(s.isin("0", "false", "no", "n"), False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), c)).cast("boolean"))


def lenient_flag(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s == "true", True).when(s == "false", False)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")


def category(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Missing"))


def all_close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    """Equal length and every component within absolute + relative * |b|."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= absolute + relative * F.abs(y.cast("double"))), lambda ok: ok)


def first_match(text: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """The category of the first rule whose word occurs in the lower-cased text."""
    out = F.lit(fallback)
    for word, name in reversed(rules):
        out = F.when(F.contains(F.lower(text), F.lit(word)), name).otherwise(out)
    return out


def value_counts(df: DataFrame, column: str, top: int) -> DataFrame:
    return df.groupBy(category(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def cohort_flow(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, n, entities) for nested or overlapping gates, in one pass."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in gates.items()]))
    return df.withColumn("gate", F.explode(names)).groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities"))


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) independent of row order: SHA-256 over the sums of the eight 32-bit words of the rows' SHA-256.

    Sums tell repeated rows apart from single ones, need no sorted list and combine before the shuffle.
    """
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    word = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20, 0)"))
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(word(i), F.lit(0)).cast("string").alias(f"w{i}") for i in range(8)])
    return sums.select("rows", F.sha2(F.concat_ws(":", *[f"w{i}" for i in range(8)]).cast("binary"), 256).alias("digest"))


def stratified_pick(df: DataFrame, value: str, key: str, strata: int, seed: str) -> DataFrame:
    """One row of each of `strata` equal parts of the order by (value, key), chosen by sha256(seed:stratum).

    Ranks are running counts over ranges of the order, not one sorted task.
    """
    ordered = running_totals(df.withColumn("__k", F.struct(value, key)), "__k", {"__upto": F.lit(1)})
    rows = ordered.withColumn("__rank", F.col("__upto") - 1).withColumn("__total", F.lit(df.count())).drop("__k", "__upto")
    # The first (total mod strata) parts hold one row more.
    size, extra = F.floor(F.col("__total") / strata), F.col("__total") % strata
    wide = (size + 1) * extra
    stratum = F.when(F.col("__rank") < wide, F.floor(F.col("__rank") / (size + 1))).otherwise(extra + F.floor((F.col("__rank") - wide) / size)).cast("int")
    rows = rows.withColumn("stratum", stratum + 1)
    start = F.when(F.col("stratum") - 1 < extra, (F.col("stratum") - 1) * (size + 1)).otherwise(wide + (F.col("stratum") - 1 - extra) * size)
    length = size + (F.col("stratum") - 1 < extra).cast("int")
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "stratum").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return rows.where(F.col("__rank") - start == draw % length).drop("__total", "__rank")
