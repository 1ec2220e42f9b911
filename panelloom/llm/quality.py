"""Quality rules: counted base rules, then a calibrated n-gram classifier against a fixed threshold.

Features are hashed word unigrams, word bigrams and 4-grams of characters (code points), each family as frequencies that
sum to one. A logistic regression with an L2 penalty is fitted in its dual form on at most `max_labelled` labelled
documents, those with the smallest keyed hashes of their ids (of rows that repeat an id, the least text); a quarter of them is held out to calibrate the scores
to probabilities (Platt). The fitted weights, of fixed size, are sent to the tasks, which score whole texts in Arrow
batches: a gather and a segmented sum, no loop over words.

Edge cases: a null text has no words and fails the base rules; without labels of both kinds the base rules decide
alone and the probability is null; several labels of one document count as the lowest; equal rows get equal results;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from panelloom.llm._spark import keyed_uniform, read, whole_row
from panelloom.llm._text import TextBlock, shingle_hashes, span_hashes, text_blocks

#: Log2 of the hashed dimensions of each of the three families.
BITS = 15
FAMILIES = 3
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (raw + self.bias) + self.offset, -40, 40)))


def _families(block: TextBlock, word: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family the feature numbers of all n-grams and the rows they belong to."""
    top = np.uint64(64 - BITS)
    yield (word >> top).astype(np.int64), rows
    pairs, first = shingle_hashes(word, rows, 2)
    yield (pairs >> top).astype(np.int64) + (1 << BITS), rows[first]
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    if len(lead) >= 4:
        lower = block.data | ((block.data >= 65) & (block.data <= 90)).astype(np.uint8) << 5
        ends = np.append(lead, len(block.data))
        row = np.repeat(np.arange(block.rows), np.diff(np.searchsorted(lead, block.offsets)))
        first = np.flatnonzero(row[3:] == row[:-3])
        grams = span_hashes(TextBlock(lower, block.offsets, 0).byte_values(), lead[first], ends[first + 4])
        yield (grams >> top).astype(np.int64) + (2 << BITS), row[first]


def scores(block: TextBlock, word: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over families of the mean weight of the n-grams of each row."""
    out = np.zeros(block.rows)
    for feature, row in _families(block, word, rows):
        n = np.bincount(row, minlength=block.rows)
        out += np.bincount(row, weights=weights[feature], minlength=block.rows) / np.maximum(n, 1)
    return out


def base_counts(block: TextBlock, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, word: np.ndarray) -> dict[str, np.ndarray]:
    """The counted rules of every row: words, their code points, symbols, repeated lines, words in repeated 5-word windows."""
    n = block.rows
    full = np.flatnonzero(np.diff(block.offsets))
    per_row = lambda flags: np.bincount(full, weights=np.add.reduceat(flags.astype(np.int64), block.offsets[:-1][full]), minlength=n).astype(np.int64) if len(full) else np.zeros(n, np.int64)
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    line_start, line_end, line_row = block.lines()
    worded = np.concatenate([[0], np.cumsum(np.bincount(starts, minlength=len(block.data) + 1)[: len(block.data)])])
    use = np.flatnonzero(worded[line_end] > worded[line_start])
    later = _repeats(span_hashes(block.byte_values(), line_start[use], line_end[use]), line_row[use], first_too=False)
    windows, first = shingle_hashes(word, rows, 5)
    twice = first[_repeats(windows, rows[first], first_too=True)]
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": np.bincount(rows, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64),
        "n_symbols": per_row(_IS_SYMBOL[block.data]),
        "n_dup_lines": np.bincount(line_row[use][later], minlength=n),
        "n_repeat_words": np.bincount(rows[covered], minlength=n),
    }


def _repeats(hashes: np.ndarray, rows: np.ndarray, first_too: bool) -> np.ndarray:
    """Flags of the items whose hash occurs in the same row before (or, with first_too, anywhere else)."""
    flag = np.zeros(len(hashes), dtype=bool)
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    flag[order[1:][same]] = True
    if first_too:
        flag[order[:-1][same]] = True
    return flag


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse feature vectors (feature numbers, frequencies) of labelled documents."""
    for batch in batches:
        ids, label = batch.column(0), batch.column(2)
        for block in text_blocks(batch, "text"):
            starts, ends, rows = block.words()
            word = block.word_hashes(starts, ends)
            parts = [[] for _ in range(block.rows)]
            for feature, row in _families(block, word, rows):
                key, count = np.unique(row * (FAMILIES << BITS) + feature, return_counts=True)
                owner = key // (FAMILIES << BITS)
                total = np.bincount(row, minlength=block.rows)
                for r in np.unique(owner):
                    mine = owner == r
                    parts[r].append((key[mine] % (FAMILIES << BITS), count[mine] / total[r]))
            index = [np.concatenate([p[0] for p in x] or [np.zeros(0)]).astype(np.int32) for x in parts]
            value = [np.concatenate([p[1] for p in x] or [np.zeros(0)]).astype(np.float32) for x in parts]
            arrays = [ids.slice(block.first_row, block.rows), label.slice(block.first_row, block.rows), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "good", "index", "value"])


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, penalty: float, steps: int = 25) -> tuple[np.ndarray, float]:
    """L2 logistic regression by Newton steps on the dual coefficients; returns (weights, bias)."""
    n, dim = len(rows), FAMILIES << BITS
    kernel = np.zeros((n, n))
    width = 1 << 12
    # Feature numbers are ascending in each row, so a block of columns is a slice of it; no copy of all rows is made.
    cuts = [np.searchsorted(index, np.arange(0, dim + 1, width)) for index, _ in rows]
    for block in range(dim // width):
        dense = np.zeros((n, width), dtype=np.float32)
        for r, (index, value) in enumerate(rows):
            part = slice(cuts[r][block], cuts[r][block + 1])
            dense[r, index[part] - block * width] = value[part]
        kernel += dense @ dense.T
    alpha, bias = np.zeros(n), 0.0
    for _ in range(steps):
        f = kernel @ alpha + bias
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-5)
        z = f + (y - p) / s
        system = kernel + np.diag(penalty / s)
        both = np.linalg.solve(system, np.column_stack([z, np.ones(n)]))
        new_bias = both[:, 0].sum() / both[:, 1].sum()
        new_alpha = both[:, 0] - new_bias * both[:, 1]
        moved = np.abs(new_alpha - alpha).max()
        alpha, bias = new_alpha, new_bias
        if moved < 1e-6 * max(1.0, np.abs(alpha).max()):
            break
    weights = np.zeros(dim)
    for (index, value), a in zip(rows, alpha):
        weights[index] += a * value
    return weights, float(bias)


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(good | raw), by damped Newton steps on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((p - t) * raw).sum(), (p - t).sum()])
        h = np.array([[(s * raw * raw).sum() + 1e-9, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 1000, penalty: float = 1e-3, seed: str = "quality") -> Model | None:
    """Fits the model; max_labelled bounds the labelled documents that reach the driver."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    order = keyed_uniform(seed, F.col("doc_id").cast("string"))
    chosen = known.withColumn("draw", order).orderBy("draw", "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("good").alias("good"))
    rows = joined.mapInArrow(_features, "doc_id long, good boolean, index array<int>, value array<float>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    y = rows["good"].to_numpy().astype(float)[order]
    if len(y) < 20 or y.min(initial=1) == y.max(initial=0):
        return None
    vectors = [(np.asarray(i.values), np.asarray(v.values)) for i, v in zip(rows["index"], rows["value"])]
    vectors = [vectors[i] for i in order]
    held = np.arange(len(y)) % 4 == 3
    for kind in (0.0, 1.0):
        if not ((y == kind) & held).any() or not ((y == kind) & ~held).any():
            held = np.zeros(len(y), dtype=bool)
            break
    fit = [v for v, h in zip(vectors, held) if not h]
    weights, bias = fit_logistic(fit, y[~held], penalty)
    check = held if held.any() else ~held
    raw = np.array([value @ weights[index] for (index, value), h in zip(vectors, check) if h]) + bias
    slope, offset = platt(raw, y[check])
    return Model(weights.astype(np.float32), bias, slope, offset)


def _score(shipped):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for block in text_blocks(batch, "text"):
                starts, ends, rows = block.words()
                word = block.word_hashes(starts, ends)
                counts = base_counts(block, starts, ends, rows, word)
                if model is None:
                    chance = pa.nulls(block.rows, pa.float64())
                else:
                    chance = pa.array(model.probability(scores(block, word, rows, model.weights)))
                arrays = [batch.column(i).slice(block.first_row, block.rows) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(counts[c].astype(np.int64)) for c in names), chance], names=[*batch.schema.names, *names, "quality_probability"])

    return run


def judge(docs: DataFrame, model: Model | None, threshold: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """The counts, base_failed, quality_probability and kept of every row; its own columns are packed in `row`."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(docs).alias("row"), F.col("text"))
    schema = StructType([*rows.schema.fields])
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, LongType())
    scored = rows.mapInArrow(_score(shipped), schema.add("quality_probability", DoubleType())).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality_probability", F.lit(1.0)) >= threshold))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and classifier verdict of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    judged = judge(docs, model)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")


def queries() -> dict:
    return {"op2_quality": op2_quality}


def oracle_sql() -> dict[str, str]:
    return {}
