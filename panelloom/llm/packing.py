"""Packing by optimal length buckets.

The global histogram of document lengths, one row per distinct length, goes to the driver: lengths repeat, so it is far
smaller than the table (at most sqrt(2 n) rows for texts of n words in all). Dynamic programming over the ordered lengths
chooses at most `buckets` boundaries with the least padding in all; the best cut never moves back as the end moves on,
so each bucket takes a divide-and-conquer pass of m log m steps over m lengths. Each document is padded to the
boundary of its bucket, and batches of at most `token_budget` padded tokens form inside each bucket in a keyed
pseudo-random order.

Edge cases: null, empty and wordless texts have length 0 and share the smallest bucket; a document longer than the
budget is a batch of its own; ties in the keyed order are broken by doc_id and length, so rows equal in both may change
places; a null id is drawn by its text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed, gapless_rank, keyed_uniform, read
from panelloom.llm.mixing import word_count


def _best_cuts(before: np.ndarray, lengths: np.ndarray, n_before: np.ndarray, t_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least total padding with one more bucket for every end 1..m, and where that bucket begins (the lowest on ties).

    All ends of one level of the recursion are solved together, each over the cuts between those of its neighbours.
    """
    m = len(lengths)
    total, cut = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    spans = [(1, m, 0, m - 1)]
    while spans:
        next_spans = []
        for low, high, first, last in spans:
            end = (low + high) // 2
            i = np.arange(first, min(last, end - 1) + 1)
            padded = before[i] + lengths[end - 1] * (n_before[end] - n_before[i]) - (t_before[end] - t_before[i])
            best = int(padded.argmin())
            total[end], cut[end] = padded[best], i[best]
            if low < end:
                next_spans.append((low, end - 1, first, int(i[best])))
            if end < high:
                next_spans.append((end + 1, high, int(i[best]), last))
        spans = next_spans
    return total, cut


def bucket_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` runs of the ordered distinct lengths with the least total padding; exact."""
    m = len(lengths)
    if m == 0:
        return []
    n_before = np.concatenate([[0], np.cumsum(counts)])
    t_before = np.concatenate([[0], np.cumsum(counts * lengths)])
    # One bucket first; every further one starts from the best totals with one less.
    total = np.concatenate([[0], lengths * n_before[1:] - t_before[1:]])
    chosen = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(min(buckets, m) - 1):
        total, cut = _best_cuts(total, lengths, n_before, t_before)
        chosen.append(cut)
    out, end = set(), m
    for cut in reversed(chosen):
        if end:
            out.add(int(lengths[end - 1]))
            end = int(cut[end])
    return sorted(out)


def length_boundaries(sized: DataFrame, buckets: int) -> list[int]:
    """Optimal boundaries for (n_tokens), from its exact histogram."""
    rows = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    return bucket_boundaries(np.array([r.n_tokens for r in rows], np.int64), np.array([r.n for r in rows], np.int64), buckets)


def pack(docs: DataFrame, buckets: int = 8, token_budget: int = 65_536, seed: str = "pack", rank_rows: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, place, padding) of every row of docs."""
    sized = checkpointed(docs.select(F.col(id_column).cast("long").alias("doc_id"), word_count(F.col(text_column)).alias("n_tokens"), F.coalesce(F.col(id_column).cast("string"), F.xxhash64(text_column).cast("string")).alias("drawn_by")))
    ends = length_boundaries(sized, buckets)
    number, length = F.lit(0), F.lit(ends[0] if ends else 0).cast("long")
    for i, end in enumerate(ends[:-1]):
        number = F.when(F.col("n_tokens") > end, i + 1).otherwise(number)
        length = F.when(F.col("n_tokens") > end, F.lit(ends[i + 1]).cast("long")).otherwise(length)
    placed = sized.withColumn("bucket", number).withColumn("bucket_length", length)
    ranges = max(1, sized.count() // max(1, len(ends)) // rank_rows)
    order = keyed_uniform(seed, F.col("drawn_by"))
    ranked = gapless_rank(placed, "bucket", order, "rank", ["doc_id", "n_tokens"], ranges)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("rank") / per_batch).cast("long").alias("batch"), (F.col("rank") % per_batch).alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into eight optimal length buckets."""
    return pack(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op7_packing": op7_packing}


def oracle_sql() -> dict[str, str]:
    return {}
