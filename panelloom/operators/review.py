"""Row checks of cases, the frozen cohort, and the tables of a review."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators.checks import strict_flag, table_digest


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def required_flag(c: Column) -> Column:
    """A strict flag that may not be empty either."""
    flag = strict_flag(c)
    return F.when(flag.isNotNull(), flag).otherwise(F.raise_error(F.lit("a flag is missing")).cast("boolean"))


def resolve_path(c: Column, base: str) -> Column:
    """Absolute paths as they are, others below base."""
    return F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))


def absent_files(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose file is not in the index; a null key is absent."""
    return rows.join(index.select(key), key, "left_anti")


def pair_errors(rows: DataFrame) -> DataFrame:
    """Adds errors to rows of (voxels, declared_absent, size_matches): an empty mask must be declared, sizes must match."""
    empty = F.coalesce("voxels", F.lit(0)) == 0
    undeclared = empty & ~F.coalesce("declared_absent", F.lit(False))
    return rows.withColumn("errors", F.array_compact(F.array(F.when(undeclared, "undeclared_empty"), F.when(~F.coalesce("size_matches", F.lit(False)), "size"))))


def pair_counters(rows: DataFrame) -> DataFrame:
    """One row: pairs, declared_absent, empty, undeclared_empty, size errors."""
    n = lambda c, name: F.count_if(c).alias(name)
    checked = pair_errors(rows)
    return checked.agg(F.count(F.lit(1)).alias("pairs"), n(F.col("declared_absent"), "declared_absent"), n(F.coalesce("voxels", F.lit(0)) == 0, "empty"), n(F.array_contains("errors", "undeclared_empty"), "undeclared_empty"), n(F.array_contains("errors", "size"), "size_errors"))


def case_gate(overlaps: Column, borders: Column, least: float) -> Column:
    """Reasons against a case: an overlap below `least` at any but the reference (place 1), a touched border."""
    others = F.filter(overlaps, lambda _, i: i != 1)
    return F.array_compact(F.array(F.when(F.exists(others, lambda x: x < least), "overlap"), F.when(F.exists(borders, lambda b: b), "border")))


def least_overlap(overlaps_json: Column) -> Column:
    """The least overlap of a JSON list, the reference left out; infinite where the text is no list or holds none."""
    parsed = F.from_json(overlaps_json, "array<double>")
    return F.coalesce(F.array_min(F.filter(parsed, lambda x, i: (i != 1) & x.isNotNull())), F.lit(float("inf")))


def merged_flags(*lists: Column) -> Column:
    """The distinct flags of several ';' lists, sorted; nulls and blanks hold none."""
    parts = F.concat(*[F.split(F.coalesce(c, F.lit("")), ";") for c in lists])
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def freeze(cases: DataFrame, folds: DataFrame, passed: Column, key: str, k: int) -> DataFrame:
    """Passed cases with the fold of their entity. Duplicate cases, unknown entities and folds outside 0..k-1 are errors."""
    lost = missing_columns(cases, [key, "entity_id"]) + missing_columns(folds, ["entity_id", "fold"])
    if lost:
        raise ValueError(f"columns are missing: {lost}")
    kept = cases.where(passed).join(folds, "entity_id", "left")
    fault = F.when(F.col("fold").isNull() | ~F.col("fold").between(0, k - 1), "fold").when(F.count(F.lit(1)).over(Window.partitionBy(key)) > 1, "duplicate")
    checked = F.when(fault.isNull(), F.col("fold")).otherwise(F.raise_error(F.concat(F.lit("frozen case has a fault: "), fault)).cast("int"))
    return kept.withColumn("fold", checked)


def fold_counts(frozen: DataFrame) -> DataFrame:
    return frozen.groupBy("fold").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("entity_id").alias("entities"))


def decision_counts(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(decision, n): allowed decisions by name, the rest as blank or invalid."""
    text = F.trim(column)
    kind = F.when(text.isNull() | (text == ""), "blank").when(text.isin(allowed), text).otherwise("invalid")
    return rows.groupBy(kind.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def opaque_ids(selected: DataFrame, order: list[str], config: dict) -> DataFrame:
    """Adds opaque_id, qc-<hash of the configuration>-<number>. `selected` is a review selection of bounded size."""
    digest = F.substring(F.sha2(F.lit(json.dumps(config, sort_keys=True)).cast("binary"), 256), 1, 8)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return selected.withColumn("opaque_id", F.concat(F.lit("qc-"), digest, F.lit("-"), F.lpad(number.cast("string"), 3, "0")))


def reconcile(rows: DataFrame, selected: Column, failed: Column, reviewed: Column) -> DataFrame:
    """One row: selected, failed, reviewed, and whether the first two make up the third."""
    counts = rows.agg(F.count_if(selected).alias("selected"), F.count_if(failed).alias("failed"), F.count_if(reviewed).alias("reviewed"))
    return counts.withColumn("balanced", F.col("selected") + F.col("failed") == F.col("reviewed"))


def run_record(spark: SparkSession, parameters: dict, inputs: dict[str, DataFrame]) -> DataFrame:
    """One row per input: its name, rows and digest, the parameters as JSON and the Spark version; no host names."""
    out = None
    for name, table in inputs.items():
        row = table_digest(table).withColumn("input", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("input", "rows", "digest", F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"), F.lit(spark.version).alias("version"))


def natural_key(c: Column, width: int = 20) -> Column:
    """A text that sorts digit runs as numbers: every run is padded with zeros."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(F.rlike(x, F.lit(r"^\d")) & (F.length(x) < width), F.lpad(x, width, "0")).otherwise(x)), "")


def fold_diagnostics(rows: DataFrame, value: str) -> DataFrame:
    """(fold, n_train, n_test, train_mean): the training sums of a fold are the totals less its own."""
    per = rows.groupBy("fold").agg(F.count(value).alias("n_test"), F.sum(value).alias("__s"))
    total = per.agg(F.sum("n_test").alias("__n"), F.sum("__s").alias("__t"))
    n = F.col("__n") - F.col("n_test")
    return per.crossJoin(F.broadcast(total)).select("fold", n.alias("n_train"), "n_test", F.when(n > 0, (F.col("__t") - F.col("__s")) / n).alias("train_mean"))


def review_selection(rows: DataFrame, key: str, overlap: str, passed: Column, sample_passed: int, seed: str, most_flagged: int | None = None) -> DataFrame:
    """(key, overlap, kind, place): cases to review, flagged ones first by their overlap, then a sample of the passed ones.

    Every flagged case is taken, or the `most_flagged` with the least overlap; null overlaps count as infinite. The sample
    has one case of each of `sample_passed` strata of the order by overlap. Of rows with one key the flagged one with the
    least overlap counts. place numbers the selection from 0.
    """
    from panelloom.functions.spread import running_totals
    from panelloom.operators.checks import stratified_pick

    known = rows.select(key, F.coalesce(F.col(overlap).cast("double"), F.lit(float("inf"))).alias("overlap"), F.coalesce(passed, F.lit(False)).alias("__passed"))
    flagged = known.where("not __passed").groupBy(key).agg(F.min("overlap").alias("overlap"))
    kept = flagged if most_flagged is None else flagged.orderBy("overlap", key).limit(most_flagged)
    rest = known.where("__passed").groupBy(key).agg(F.min("overlap").alias("overlap")).join(flagged, key, "left_anti")
    picked = kept.withColumn("kind", F.lit("flagged"))
    if sample_passed > 0:
        picked = picked.unionByName(stratified_pick(rest, "overlap", key, sample_passed, seed).select(key, "overlap", F.lit("passed").alias("kind")))
    order = F.struct((F.col("kind") == "passed").alias("late"), F.when(F.col("kind") == "flagged", F.col("overlap")).otherwise(0.0).alias("o"), F.col(key).alias("k"))
    numbered = running_totals(picked.withColumn("__at", order), "__at", {"__n": F.lit(1)})
    return numbered.select(key, "overlap", "kind", (F.col("__n") - 1).cast("long").alias("place"))


def require_columns(rows: DataFrame, required: list[str]) -> DataFrame:
    """The rows as they are; an error that names the missing columns."""
    lost = missing_columns(rows, required)
    if lost:
        raise ValueError(f"columns are missing: {lost}")
    return rows


def checked_folds(rows: DataFrame, entity: str = "entity_id", fold: str = "fold") -> DataFrame:
    """The rows as they are; an error when they are read if an entity has two folds or none, so that no fold's training
    rows hold an entity of its test rows."""
    per = rows.groupBy(entity).agg(F.min(fold).alias("__a"), F.max(fold).alias("__b"), F.count_if(F.col(fold).isNull()).alias("__n"))
    fault = F.concat(F.lit("entity in several folds or none: "), F.coalesce(F.col(entity).cast("string"), F.lit("null")))
    bad = (F.col("__n") > 0) | (F.col("__a") != F.col("__b"))
    checked = per.select(F.col(entity).alias("__e"), F.when(~bad, F.col("__a")).otherwise(F.raise_error(fault).cast(rows.schema[fold].dataType)).alias("__fold"))
    return rows.join(checked, F.col(entity).eqNullSafe(F.col("__e"))).withColumn(fold, F.col("__fold")).drop("__e", "__fold")
