"""Comparisons inside groups of any size, without a task that holds a whole hot group.

tiled() sends every pair of rows to one unit, where all pairs count. Where only components count, chunked() cuts a group
into chunks that share its leader, and against_rest() then meets those rows that are not in the group's largest component
with all others: a group that hangs together, as copies do, costs a multiple of its rows, not of their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed


def tiled(rows: DataFrame, keys: list[str], id_column: str, tile: int) -> DataFrame:
    """Rows of groups with two or more members, sent to every tile (i, j) that must see them, with i <= j.

    A group of n rows has ceil(n / tile) chunks by a hash of the id; each pair of chunks is one unit of work.
    Columns added: __ti, __tj, __chunk.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__g") - 1))
    return (
        rows.join(sizes, keys)
        .withColumn("__g", F.ceil(F.col("__n") / tile).cast("long"))
        .withColumn("__chunk", F.expr(f"pmod(xxhash64({id_column}), __g)"))
        .withColumn("__o", other)
        .withColumn("__ti", F.least("__chunk", "__o"))
        .withColumn("__tj", F.greatest("__chunk", "__o"))
        .drop("__n", "__g", "__o")
    )


def once(rows: DataFrame, key: str, id_column: str, tile: int, sketch: Column, sketch_bits: int) -> DataFrame:
    """chunked() for rows of key and id (and component) with unique ids in a cell, without cells that need no comparison.

    Cells of exactly two rows whose sketches (a non-negative int or a long made from the id) differ in more than
    sketch_bits bits are left out, and of the cells that hold the same rows one is kept: all of them would make the
    same comparisons. So are cells whose rows share one component, where rows have that column. Equal sets are known by
    their size and the xor of their ids' hashes and sketches. The rows are made and shuffled by cell once: a cell is
    measured by window sums, which spill, and what is left of the rows is written before it is read twice.
    """
    told = [c for c in rows.columns if c == "component"]
    cell = Window.partitionBy(key)
    measures = {"__n": F.count(F.lit(1)), "__leader": F.min(id_column), "__xor": F.bit_xor(sketch), "__set": F.bit_xor(F.xxhash64(id_column))}
    measures |= {name: f(c) for c in told for name, f in (("__least", F.min), ("__most", F.max))}
    measured = rows.select(key, id_column, *told).where(F.col(key).isNotNull()).withColumns({name: value.over(cell) for name, value in measures.items()})
    left = measured.where(f"__n > 2 or __n = 2 and bit_count(__xor) <= {sketch_bits}")
    if told:
        left = left.where("__least <> __most")
    left = checkpointed(left.select(key, id_column, "__n", "__leader", "__xor", "__set"))
    sizes = left.groupBy("__n", "__xor", "__set").agg(F.min(key).alias(key), F.min("__leader").alias("__leader"))
    return chunked(left.select(key, id_column), sizes, [key], id_column, tile)


def chunked(rows: DataFrame, sizes: DataFrame, keys: list[str], id_column: str, tile: int) -> DataFrame:
    """Rows of the groups (keys, __n, __leader) in chunks of about `tile` rows, the leader in all; adds __ti, __tj, __g.

    __g is the number of chunks; a group with one is compared whole.
    """
    own = F.array(F.expr(f"pmod(xxhash64({id_column}, {', '.join(keys)}), __g)"))
    cut = rows.join(sizes.select(*keys, "__n", "__leader"), keys).withColumn("__g", F.ceil(F.col("__n") / tile).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.col("__g") - 1)
    to = F.when(F.col(id_column) == F.col("__leader"), every).otherwise(own)
    return cut.withColumn("__ti", F.explode(to)).withColumn("__tj", F.col("__ti")).drop("__n", "__leader")


def against_rest(rows: DataFrame, linked: DataFrame, keys: list[str], id_column: str, tile: int) -> DataFrame:
    """Units (__ti, __tj) in which each row outside the largest component of its group meets all rows of the group.

    linked: (node, component) of what is known so far. Rows of one component need no comparison, so what is left of a
    group of n rows with r outside makes about r * n / tile + n * ceil(r / tile) rows.
    """
    known = rows.join(linked.select(F.col("node").alias(id_column), "component"), id_column, "left").withColumn("__c", F.coalesce("component", id_column)).drop("component")
    per = known.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__k"))
    sizes = per.groupBy(*keys).agg(F.sum("__k").alias("__n"), F.max(F.struct("__k", "__c")).alias("__big")).where("__n > __big.__k")
    both = known.join(sizes, keys).withColumns({"__ng": F.ceil(F.col("__n") / tile).cast("long"), "__rg": F.ceil((F.col("__n") - F.col("__big.__k")) / tile).cast("long"), "__h": F.expr(f"xxhash64({id_column}, {', '.join(keys)})")})
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    every = both.withColumn("__ti", upto("__rg")).withColumn("__tj", F.expr("pmod(__h, __ng)"))
    rest = both.where("__c <> __big.__c").withColumn("__tj", upto("__ng")).withColumn("__ti", F.expr("pmod(__h, __rg)"))
    return every.unionByName(rest).drop("__c", "__n", "__big", "__ng", "__rg", "__h").withColumn("__g", F.lit(1).cast("long"))


def by_unit(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroups a sorted stream into frames that hold whole units only; at most one unit is kept back."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        last = np.ones(len(frame), dtype=bool)
        for k in keys:
            last &= (frame[k] == frame[k].iloc[-1]).to_numpy()
        cut = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        held = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
    if held is not None:
        yield held.reset_index(drop=True)


def unit_bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which the units of a sorted frame begin, and its length."""
    change = np.zeros(len(frame), dtype=bool)
    change[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(frame))


def dense_components(adjacent: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row of a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with the edges (a, b); as many as nodes less components."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def run_units(frames: Iterator[pd.DataFrame], keys: list[str], one: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    for frame in by_unit(frames, keys):
        bounds = unit_bounds(frame, keys)
        out = [x for a, b in zip(bounds[:-1], bounds[1:]) if (x := one(frame.iloc[a:b])) is not None]
        if out:
            yield pd.concat(out, ignore_index=True)
