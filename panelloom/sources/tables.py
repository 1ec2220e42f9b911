"""Scans of attribute tables, file layouts and per-fold results, and the sinks of cases and summaries.

Every path may be on any store that Spark reads; nothing is listed or opened on the driver's own disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    from panelloom.functions.spread import shared_folder

    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def read_attributes(spark: SparkSession, path: str, tab_separated: bool = False) -> DataFrame:
    """A delimited table with header, every column a string; empty fields are null."""
    return spark.read.csv(path, header=True, sep="\t" if tab_separated else ",", inferSchema=False, multiLine=False)


def file_index(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame:
    """(path, name, length) of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).load(root)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length")


def layout(paths: DataFrame, column: str, parts: dict[str, str]) -> DataFrame:
    """Adds a column per part: the first group of its pattern in the path, null where the path does not match."""
    found = {name: F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")) for name, pattern in parts.items()}
    return paths.withColumns(found)


def read_folds(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Per-case tables of folders named fold_<n>, as one table with the fold number of the path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).csv(root, header=True)
    return rows.withColumn("fold", F.regexp_extract(F.col("_metadata.file_path"), r"fold_(\d+)", 1).cast("int"))


def read_roles(spark: SparkSession, root: str, roles: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """(entity_id, role) from text files of one id per line whose path names the role; blank lines are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    role = F.regexp_extract(F.col("_metadata.file_path"), f"role=({'|'.join(roles)})", 1)
    return lines.select(F.trim("value").alias("entity_id"), role.alias("role")).where("entity_id <> ''")


def write_folds(cases: DataFrame, root: str) -> None:
    """Cases as CSV with header, one folder fold_<n> per fold."""
    cases.withColumn("part", F.concat(F.lit("fold_"), "fold")).drop("fold").write.partitionBy("part").csv(root, header=True)


def write_by_status(rows: DataFrame, root: str) -> None:
    """One pass over the rows, one folder per status."""
    rows.write.partitionBy("status").parquet(root)


def write_roles(split: DataFrame, root: str) -> None:
    split.select("role", F.col("entity_id").cast("string").alias("value")).write.partitionBy("role").text(root)


def public_columns(rows: DataFrame, private: list[str]) -> DataFrame:
    """The rows without the columns that identify an entity."""
    return rows.drop(*private)


def summary_line(template: str, *values: Column) -> Column:
    """A line of a text report; null where a value is null."""
    line = F.format_string(template, *values)
    for value in values:
        line = F.when(value.isNotNull(), line)
    return line
