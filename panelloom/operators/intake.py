"""Manifests and joins that are checked: scans with a schema, offending rows, one-to-one and many-to-one joins, merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of a manifest and their types.
MANIFEST = "patient_id string, timepoint_id string, study_days double, image_path string, mask_path string, intervened_since_previous string, no_residual_vs string"


def manifest_faults(panel: DataFrame, entity: str = "patient_id", observation: str = "timepoint_id", time: str = "study_days", required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the panel with a fault: missing (a required field is null), repeated (entity and observation occur before),
    not_increasing (time is not above that of the row before, in the order of time and observation).

    A row has one line per fault; a panel without faults, or an empty one, gives none.
    """
    needed = [F.col(c).isNull() for c in dict.fromkeys((entity, observation, time, *required))]
    missing = needed[0]
    for c in needed[1:]:
        missing = missing | c
    order = Window.partitionBy(entity).orderBy(time, observation)
    again = F.row_number().over(Window.partitionBy(entity, observation).orderBy(time)) > 1
    late = F.coalesce(F.col(time) <= F.lag(time).over(order), F.lit(False))
    found = F.array_compact(F.array(F.when(missing, "missing"), F.when(again, "repeated"), F.when(late, "not_increasing")))
    return panel.withColumn("__f", found).withColumn("fault", F.explode("__f")).drop("__f")


def load_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A CSV manifest with header and fixed schema, flags as tri-state booleans; an empty or faulty one is an error.

    The error names the first ten offending rows.
    """
    from panelloom.operators.checks import strict_flag

    rows = spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    rows = rows.withColumns({c: strict_flag(F.col(c)) for c in ("intervened_since_previous", "no_residual_vs") if c in rows.columns})
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    first = manifest_faults(rows, required=("image_path", "mask_path")).select("patient_id", "timepoint_id", "fault").orderBy("patient_id", "timepoint_id", "fault").limit(10).collect()
    if first:
        raise ValueError("faulty rows: " + "; ".join(f"{r.patient_id}/{r.timepoint_id}: {r.fault}" for r in first))
    return rows


def quality_passed(rows: DataFrame, flag: str, include_failed: bool = False) -> DataFrame:
    """Rows whose text flag says true (any letter case, blanks around it); all rows with include_failed."""
    return rows if include_failed else rows.where(F.lower(F.trim(F.col(flag))) == "true")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which no key occurs twice on either side; a second occurrence is an error when the join runs.

    Counts ride on the join's own exchange: both sides are dealt by the keys anyway.
    """

    def single(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        fault = F.raise_error(F.concat(F.lit(f"key repeats on the {side}: "), F.concat_ws("/", *keys)))
        return df.withColumn(keys[0], F.when(n == 1, F.col(keys[0])).otherwise(fault.cast(df.schema[keys[0]].dataType)))

    return single(left, "left").join(single(right, "right"), keys, how)


def unmatched(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, n): keys of rows that the table lacks, a null key included, with their rows."""
    held = table.select(F.col(key).alias("__k")).distinct()
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(held, F.col(key) == F.col("__k"), "left_anti")


def many_to_one(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Rows with the columns of the one table row of their key; a repeated table key, or with how = "left" a row without
    a match, is an error that names it when the join runs. An inner join drops what is not matched.

    Both checks ride on the join: the table's keys are counted where the join deals them, and a left row looks at its own
    match. A null key matches nothing.
    """
    kind = table.schema[key].dataType
    twice = F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast(kind)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    single = table.where(F.col(key).isNotNull()).withColumn(key, F.when(n == 1, F.col(key)).otherwise(twice)).withColumn("__in", F.lit(True))
    joined = rows.join(single, key, how)
    if how == "left":
        lost = F.raise_error(F.concat(F.lit(f"{key} without a match: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(rows.schema[key].dataType)
        joined = joined.withColumn(key, F.when(F.col("__in"), F.col(key)).otherwise(lost))
    return joined.drop("__in")


def override_merge(rows: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose columns take the source's value where it has one; adds matched (the source has the key).

    source: one row per key, with the keys and the columns. Columns that rows lack are added, others keep their type; null keys
    match nothing.
    """
    renamed = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__in"))
    joined = rows.join(renamed, keys, "left")
    taken = {c: F.coalesce(F.col(f"__{c}").cast(rows.schema[c].dataType), F.col(c)) if c in rows.columns else F.col(f"__{c}") for c in columns}
    return joined.withColumns(taken).withColumn("matched", F.col("__in").isNotNull()).drop("__in", *[f"__{c}" for c in columns])


def mapped_merge(rows: DataFrame, source: DataFrame, keys: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """override_merge with the source's own names: keys and columns map our names to the source's."""
    lost = [c for c in (*keys.values(), *columns.values()) if c not in source.columns]
    if lost:
        raise ValueError(f"columns are missing: {lost}")
    named = source.select(*[F.col(theirs).alias(ours) for ours, theirs in {**keys, **columns}.items()])
    return override_merge(rows, named, list(keys), list(columns))


def empty_partitions(roles: DataFrame, by: str = "test_fold", expected: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """(by, role): the expected roles that no row of a split has."""
    every = roles.select(by).distinct().withColumn("role", F.explode(F.array(*[F.lit(r) for r in expected])))
    return every.join(roles.select(by, "role").distinct(), [by, "role"], "left_anti")


def cached_by_keys(spark: SparkSession, path: str, keys: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table at path if its key set equals that of `keys`, else measure(keys), written there first.

    Keys are compared by both differences. Only a folder that does not exist counts as no table; one that cannot be read,
    or that lacks a key column, is an error.
    """
    from pyspark.errors import AnalysisException

    names = keys.columns
    try:
        held = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        same = False
    else:
        known, asked = held.select(*names), keys
        same = known.exceptAll(asked.distinct()).isEmpty() and asked.distinct().exceptAll(known.distinct()).isEmpty()
    if not same:
        measure(keys).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def date_of_digits(c: Column) -> Column:
    """The date of eight digits yyyyMMdd; null for anything else."""
    return F.when(F.rlike(c, F.lit(r"^\d{8}$")), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"))
