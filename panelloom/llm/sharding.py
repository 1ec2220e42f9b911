"""Shards of nearly equal bytes: a minimax contiguous partition of ordered atomic groups.

Rows with equal texts are one group; groups are ordered by a 60-bit hash of the text. The smallest capacity for
which a greedy walk needs at most `shards` contiguous runs is found by binary search, and the cuts are made there.
The driver never sees all groups: it holds sums of hash ranges (at most a few thousand rows a level) and refines
only those ranges in which a cut can still fall, until these are single groups; the rest of the order is summed.

Edge cases: a null text counts as an empty one (one byte, same group); an empty table gives an empty result; one
group larger than a fair share fills its shard alone and sets the capacity; equal rows share a shard and get
slots of their own; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed, gapless_rank, keyed_uniform, read

#: Hashes have 60 bits; the first sums are over at most 2**12 ranges, a refined range has 2**_FANOUT_BITS parts.
_FIRST_SHIFT = 48
_FANOUT_BITS = 8


def greedy_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Numbers of the first unit of each shard when every shard takes what still fits; None if they are too few."""
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    cuts, at = [], 0
    for _ in range(shards):
        cuts.append(at)
        at = bisect_right(sums, sums[at] + capacity) - 1
        if at == len(sizes):
            return cuts
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which greedy_cuts succeeds."""
    low, high = max([1, max(sizes, default=1), -(-sum(sizes) // shards)]), max(1, sum(sizes))
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _sums(groups: DataFrame, shift: int, inside: list[int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(low, shift, bytes, groups, largest group) of the non-empty hash ranges of width 2**shift; one aggregation.

    inside: only the parts of these ranges, given by their number at width 2**(shift + _FANOUT_BITS).
    """
    if inside is not None:
        wanted = groups.sparkSession.createDataFrame([(i,) for i in inside], "outer long")
        groups = groups.withColumn("outer", F.shiftright("h", shift + _FANOUT_BITS)).join(F.broadcast(wanted), "outer", "left_semi")
    rows = groups.groupBy(F.shiftright("h", shift).alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.max("n").alias("m")).collect()
    return [(r.part << shift, shift, int(r.n), int(r.g), int(r.m)) for r in rows]


def shard_starts(groups: DataFrame, shards: int) -> list[int]:
    """Hashes at which shards begin, for groups (h, n): the minimax contiguous partition in hash order."""
    units = sorted(_sums(groups, _FIRST_SHIFT))
    while units:
        sizes = [u[2] for u in units]
        sums = [0, *accumulate(sizes)]
        total = sums[-1]
        upper = smallest_capacity(sizes, shards)
        lower = max(-(-total // shards), *(u[4] for u in units))
        # Whatever capacity between the bounds is the right one, the k-th greedy cut lies in [slow, fast].
        slow = fast = 0
        unsure: set[int] = set()
        for _ in range(shards):
            slow, fast = _least_cut(sums, units, min(total, slow + lower)), min(total, fast + upper)
            touched = range(max(0, bisect_right(sums, slow) - 1), min(len(units), bisect_right(sums, fast)))
            unsure |= {u for u in touched if units[u][3] > 1}
        if not unsure:
            break
        finer: list[tuple] = []
        for shift in sorted({units[u][1] for u in unsure}):
            finer += _sums(groups, shift - _FANOUT_BITS, [units[u][0] >> shift for u in unsure if units[u][1] == shift])
        units = sorted([u for i, u in enumerate(units) if i not in unsure] + finer)
    sizes = [u[2] for u in units]
    return [units[c][0] for c in (greedy_cuts(sizes, shards, smallest_capacity(sizes, shards)) or [0])[1:]]


def _least_cut(sums: list[int], units: list[tuple], position: int) -> int:
    """The least place of the last group boundary at or before `position`: at worst one largest group earlier."""
    u = min(len(units) - 1, bisect_right(sums, position) - 1)
    return max(sums[u], position - units[u][4])


def shard(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", slot_rows: int = 512) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 4).alias("h"))
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("h").agg(F.sum("size").alias("n")))
    starts = shard_starts(groups, shards)
    number = F.lit(0)
    for s in starts:
        number = number + (F.col("h") >= F.lit(s)).cast("int")
    placed = rows.withColumn("shard", number)
    buckets = max(1, rows.count() // shards // slot_rows)
    order = keyed_uniform("slot", F.col("doc_id").cast("string"))
    return gapless_rank(placed, "shard", order, "slot", ["h", "doc_id"], buckets).select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of nearly equal bytes."""
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {"op5_sharding": op5_sharding}


def oracle_sql() -> dict[str, str]:
    return {}
