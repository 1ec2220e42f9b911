"""Checkpoints, row ranks and components shared by the operators of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.spread import checkpointed as checkpointed


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any more (it does so after a collection)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns; columns with maps, which have no hash, count by their JSON."""
    mapped = {f.name for f in docs.schema if "map<" in f.dataType.simpleString()}
    return F.xxhash64(*[F.to_json(F.struct(F.col(quoted(c)))) if c in mapped else F.col(quoted(c)) for c in docs.columns])


#: What stands for a null id in orders and joins; row_identity tells it from the id of this value.
NO_ID = 2**63 - 1
IDENTITY = ("doc", "text_key", "text_key2")


def row_identity(id_column: Column, text_column: Column) -> list[Column]:
    """(doc, text_key, text_key2): rows of equal id and text are one, others are told apart by 127 bits of the text.

    In their order ids come first, then a hash of the text; null ids come last.
    """
    own, text = id_column.cast("long"), F.coalesce(text_column, F.lit(""))
    bits = F.shiftleft(F.crc32(text).cast("long"), 31).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)))
    told = bits.bitwiseOR(F.when(own.isNull(), F.lit(0)).otherwise(F.lit(-(2**63))).cast("long"))
    return [F.coalesce(own, F.lit(NO_ID)).alias("doc"), told.alias("text_key"), F.xxhash64(F.lit(7), text).alias("text_key2")]


def keyed_uniform(seed: str, *keys: Column) -> Column:
    """A double in (0, 1) drawn from md5(seed:key...); SQL engines agree on it."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *keys).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def met_unevenly(rows: DataFrame, table: DataFrame, keys: list[str], value: str, place: list[str], hot: int = 1000) -> DataFrame:
    """rows with `value` of table (keys, value, n) for equal keys, null where there is none; keys[0] may be changed.

    n: how many rows have the keys. The `hot` most common keys, a bounded table, are met by broadcast, and their rows
    are dealt by `place` afterwards; every other key has at most one row in `hot` of all.
    """
    few = table.orderBy(F.desc("n"), *keys).limit(hot).select(*keys, F.col(value).alias("__hot"))
    kind = rows.schema[keys[0]].dataType
    met = rows.join(F.broadcast(few), keys, "left").withColumn(keys[0], F.when(F.col("__hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*place).cast(kind)))
    return met.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce("__hot", value)).drop("__hot")


def gapless_rank(df: DataFrame, group: str, order: Column, name: str, ties: list[str], buckets: int) -> DataFrame:
    """Adds the 0-based rank inside `group` by (`order`, `ties`), where `order` is a double in [0, 1).

    Rows are cut into `buckets` ranges of `order`, counted per range, and ranked inside a range; a group that
    holds most rows is therefore spread over as many tasks as any other.
    """
    rows = df.withColumn("__order", order).withColumn("__bucket", F.floor(F.col("__order") * buckets).cast("int"))
    counts = rows.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, "__bucket").orderBy("__order", *ties)
    ranked = rows.withColumn("__in", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(name, (F.col("__offset") + F.col("__in")).cast("long")).drop("__order", "__bucket", "__in", "__g", "__b", "__offset")


#: Edges that one task reads in a round of components.
EDGES_A_TASK = 100_000


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Alternates large-star and small-star steps, each a min aggregation and a join, until nothing changes; the
    edge list never outgrows its first size, and is kept in as many partitions as it needs. Nodes without an edge are
    absent.
    """

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    current = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = signature(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = current.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        current = checkpointed(small.coalesce(max(8, before[0] // EDGES_A_TASK)))
        after = signature(current)
        # The shuffles of a round are many small files where there are many partitions.
        del both, least, large, small
        free_shuffles(edges.sparkSession)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
