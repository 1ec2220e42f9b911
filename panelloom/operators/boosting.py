"""Boosted trees of absolute loss: settings by inner folds, every outer fold predicted out of fold.

All training rows take part in a fit, in memory that does not grow with them. Features are binned at exact quantiles of the
fit's training rows, which come from running counts over ranges of the values. A tree sees a row by its bins alone, so the
rows of one combination of bins are a cell: Spark sorts a fit's rows by cell, its task writes the targets to a temporary file,
sorts them inside the cells and keeps codes and places of the cells. A tree grows level by level from sums of gradients by node and bin; a
cell's sum is its rows less those at or below its value, found by bisection. Leaves take the median of the residuals, which
bisections bracket until what is left is small. Fits are independent: one task for each pair of an outer and an inner fold,
which fits all settings on its training rows and scores them on its held-out rows.
"""

from __future__ import annotations

import json
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.spread import checkpointed

#: The four settings of the regression study.
GRID = (
    {"depth": 2, "rate": 0.03, "trees": 150},
    {"depth": 2, "rate": 0.1, "trees": 100},
    {"depth": 3, "rate": 0.03, "trees": 150},
    {"depth": 3, "rate": 0.1, "trees": 100},
)

#: Combinations of bins up to which a model is a table of its values.
CELLS = 1 << 18
#: Bins of a feature; a code takes eight bits, and five codes a long.
BINS = 255
CODES = 5
#: Bits of the first long that tell whether a row is held out, and from which on it has the number of the fit.
HELD, FIT = 41, 42
#: Residuals of a leaf of which the median is taken at once, and held-out rows that are scored at once.
AT_ONCE = 1 << 17


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the upper ends of all bins but the last: midpoints of distinct values, or quantiles where they are many."""
    out = []
    for column in x.T:
        known = np.unique(column)
        middle = (known[1:] + known[:-1]) / 2
        if len(known) > bins:
            middle = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="midpoint"))
        out.append(middle)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of every row and feature; a feature's bins lie together in memory."""
    return np.asfortranarray(np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1))


def grow(codes: np.ndarray, gradient: np.ndarray, rows: np.ndarray, sizes: list[int], depth: int, least: int) -> tuple[list, np.ndarray]:
    """A tree's splits, one list per level of (feature, bin) or None by node, and the leaf of every cell.

    gradient, rows: the sum of gradients and the number of rows of a cell. A node splits where the sum of squared gradient
    sums per row grows most; ties go to the first feature and bin. Both sides keep `least` rows or more.
    """
    node = np.zeros(len(codes), dtype=np.int64)
    levels = []
    for level in range(depth):
        count = 1 << level
        best = [(1e-12, None)] * count
        total, number = np.bincount(node, gradient, count), np.bincount(node, rows, count)
        with np.errstate(divide="ignore", invalid="ignore"):
            base = np.where(number > 0, total * total / number, 0.0)
            for f, size in enumerate(sizes):
                place = node * size + codes[:, f]
                g = np.bincount(place, gradient, count * size).reshape(count, size).cumsum(axis=1)[:, :-1]
                n = np.bincount(place, rows, count * size).reshape(count, size).cumsum(axis=1)[:, :-1]
                right_g, right_n = total[:, None] - g, number[:, None] - n
                gain = np.where((n >= least) & (right_n >= least), g * g / n + right_g * right_g / right_n - base[:, None], -np.inf)
                for k in range(count if gain.shape[1] else 0):
                    b = int(np.argmax(gain[k] > gain[k].max() - 1e-9))
                    if gain[k, b] > best[k][0] + 1e-9:
                        best[k] = (gain[k, b], (f, b))
        splits = [s for _, s in best]
        levels.append(splits)
        node = descend(codes, node, splits)
    return levels, node


def descend(codes: np.ndarray, node: np.ndarray, splits: list) -> np.ndarray:
    """Nodes one level down; a node without a split sends all its rows to the left."""
    right = np.zeros(len(codes), dtype=bool)
    for f in {s[0] for s in splits if s}:
        edge = np.array([s[1] if s and s[0] == f else np.iinfo(np.int64).max for s in splits])
        right |= codes[:, f] > edge[node]
    return 2 * node + right


def _reached(y: np.ndarray, low: np.ndarray, high: np.ndarray, now: np.ndarray, bound: float, equal: bool) -> np.ndarray:
    """Per cell, whose targets lie sorted in y from low to high, the place up to which y - now is below the bound (or equals it)."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        rest = y[middle] - now[open_]
        on = rest <= bound if equal else rest < bound
        low[open_[on]] = middle[on] + 1
        high[open_[~on]] = middle[~on]
        open_ = open_[low[open_] < high[open_]]
    return low


def _middle(y: np.ndarray, low: np.ndarray, high: np.ndarray, now: np.ndarray) -> tuple[float, float]:
    """The two middle values (the same one twice if their number is odd) of y - now over all cells."""
    n = int((high - low).sum())
    first, last = (n - 1) // 2, n // 2
    while n > AT_ONCE:
        # An even sample of the sorted cells brackets the ranks; bisections count what is outside the bracket.
        ends = np.cumsum(high - low)
        at = np.linspace(0, n - 1, 4096).astype(np.int64)
        cell = np.searchsorted(ends, at, side="right")
        tried = np.sort(y[high[cell] - (ends[cell] - at)] - now[cell])
        a, b = (float(tried[int(np.clip(r / n * 4096 + w, 0, 4095))]) for r, w in ((first, -100), (last, 100)))
        from_, to = _reached(y, low, high, now, a, False), _reached(y, low, high, now, b, True)
        below, upto = int((from_ - low).sum()), int((to - low).sum())
        if first >= upto:
            low, gone = to, upto
        elif last < below:
            high, gone = from_, 0
        else:
            gone = below if first >= below else 0
            low, high = from_ if first >= below else low, to if last < upto else high
        first, last, before, n = first - gone, last - gone, n, int((high - low).sum())
        if n == before:
            # Nothing is outside, so most values equal the least one.
            to = _reached(y, low, high, now, a, True)
            upto = int((to - low).sum())
            if last < upto:
                return a, a
            if first < upto:
                use = to < high
                return a, float((y[to[use]] - now[use]).min())
            low, first, last, n = to, first - upto, last - upto, n - upto
    count = high - low
    rest = y[np.repeat(high - np.cumsum(count), count) + np.arange(n)] - np.repeat(now, count)
    rest.partition([first, last])
    return float(rest[first]), float(rest[last])


def boosted(codes: np.ndarray, starts: np.ndarray, y: np.ndarray, sizes: list[int], depth: int, rate: float, trees: int, least: int) -> tuple[float, list]:
    """The start and the trees (levels, leaf values) of cells: their codes, and their targets in y from one start to the next, sorted."""
    low, high = starts[:-1], starts[1:]
    count = high - low
    start = sum(_middle(y, low, high, np.zeros(len(codes)))) / 2
    now, out, rows = np.full(len(codes), start), [], count.astype(np.float64)
    few = len(y) <= 4 * AT_ONCE
    for _ in range(trees):
        if few:
            rest = y - np.repeat(now, count)
            gradient = np.add.reduceat(np.sign(rest), low)
        else:
            below = _reached(y, low, high, now, 0.0, False)
            level, upto = below < high, below.copy()
            level[level] = y[below[level]] == now[level]
            upto[level] = _reached(y, below[level], high[level], now[level], 0.0, True)
            gradient = (high - upto - (below - low)).astype(np.float64)
        levels, leaf = grow(codes, gradient, rows, sizes, depth, least)
        values = np.zeros(1 << depth)
        own = np.repeat(leaf, count) if few else None
        for k in range(1 << depth):
            mine = leaf == k
            if not mine.any():
                continue
            if few:
                part = rest[own == k]
                first, last = (len(part) - 1) // 2, len(part) // 2
                part.partition([first, last])
                values[k] = rate * (part[first] + part[last]) / 2
            else:
                values[k] = rate * sum(_middle(y, low[mine], high[mine], now[mine])) / 2
        now += values[leaf]
        out.append((levels, values.tolist()))
    return start, out


def sort_cells(y: np.ndarray, starts: np.ndarray, some: int = 1 << 20) -> None:
    """Sorts y in place from one start to the next, cells of about `some` values at a time."""
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + some, side="right")) - 1)
        part, count = y[starts[first] : starts[last]], np.diff(starts[first : last + 1])
        if last == first + 1:
            part.sort()
        else:
            part[:] = part[np.lexsort((part, np.repeat(np.arange(len(count)), count)))]
        first = last


def fit(x: np.ndarray, y: np.ndarray, depth: int, rate: float, trees: int, least: int = 10, bins: int = BINS) -> dict:
    """{edges, start, trees: [(levels, leaf values)]} of boosted trees of absolute loss."""
    edges = bin_edges(x, bins)
    codes = binned(x, edges)
    order = np.lexsort((y, *codes.T[::-1]))
    codes, y = codes[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))
    start, grown = boosted(np.asfortranarray(codes[first]), np.append(first, len(y)), y, [len(e) + 1 for e in edges], depth, rate, trees, least)
    return {"edges": [e.tolist() for e in edges], "start": start, "trees": grown}


def walked(model: dict, codes: np.ndarray) -> np.ndarray:
    """The model's values of rows of bins, tree by tree."""
    out = np.full(len(codes), model["start"])
    for levels, values in model["trees"]:
        node = np.zeros(len(codes), dtype=np.int64)
        for splits in levels:
            node = descend(codes, node, splits)
        out += np.asarray(values)[node]
    return out


def tabulated(model: dict) -> np.ndarray | None:
    """The model's values of all combinations of bins, an axis a feature; None above CELLS of them."""
    sizes = [len(e) + 1 for e in model["edges"]]
    if math.prod(sizes) > CELLS:
        return None
    return walked(model, np.asfortranarray(np.indices(sizes).reshape(len(sizes), -1).T)).reshape(sizes)


def predict(model: dict, x: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """The model's values of rows, looked up in its table if that is given: the same numbers without a walk of the trees."""
    codes = binned(x, [np.asarray(e) for e in model["edges"]])
    return walked(model, codes) if table is None else table[tuple(codes.T)]


def _counted(members: np.ndarray, place: dict[tuple[int, int], int], ranges: dict | None = None, wanted: dict | None = None):
    """Reads a range of (feature, value, fold, inner fold, n). Without ranges: per range and feature the rows and the distinct
    values of each fit (a column of members, which has a row a class). With them: the values at the wanted ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        feature, value, f, i, n, r = (np.concatenate(c) for c in zip(*parts))
        kind = np.array([place[k] for k in zip(f.tolist(), i.tolist())])
        out = []
        for j in np.unique(feature).tolist():
            own = np.flatnonzero(feature == j)
            own = own[np.argsort(value[own], kind="stable")]
            v, k, m, here = value[own], kind[own], n[own], int(r[0])
            if ranges is None:
                use = [members[k, t] for t in range(members.shape[1])]
                out.append((here, j, [int(m[u].sum()) for u in use], [int((np.diff(v[u]) != 0).sum()) + int(u.any()) for u in use]))
                continue
            for t in range(members.shape[1]):
                use = members[k, t]
                ranks, upto = wanted[j, t], np.cumsum(m[use]) + ranges[here, j][t]
                if ranks is None:
                    out += [(j, t, -1, x) for x in np.unique(v[use]).tolist()]
                elif len(upto):
                    ranks = ranks[(ranks >= ranges[here, j][t]) & (ranks < upto[-1])]
                    out += [(j, t, *x) for x in zip(ranks.tolist(), v[use][np.searchsorted(upto, ranks, side="right")].tolist())]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())) if ranges is None else (pa.int32(), pa.int32(), pa.int64(), pa.float64())
            names = ["r", "j", "n", "d"] if ranges is None else ["j", "t", "rank", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    return run


def exact_edges(kept: DataFrame, names: list[str], fits: list[tuple[int, int | None]], bins: int = BINS) -> list[list[np.ndarray]]:
    """bin_edges() of the training rows of every fit (outer fold, inner fold held out or None), per feature.

    kept: f, i and the features. Values are counted by fold and inner fold and dealt by ranges; the driver gets the rows and
    distinct values of each range, fit and feature, then the values at 2 (bins - 1) ranks at most of each.
    """
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).alias("v")) for j, c in enumerate(names)]))
    counts = kept.select("f", "i", each.alias("e")).groupBy("e.j", "e.v", "f", "i").agg(F.count(F.lit(1)).alias("n"))
    dealt = checkpointed(counts.repartitionByRange("j", "v").select("j", "v", "f", "i", "n", F.spark_partition_id().alias("r")))
    classes = sorted((r.f, r.i) for r in dealt.select("f", "i").distinct().collect())
    place = {c: k for k, c in enumerate(classes)}
    members = np.array([[f != o and i != g for o, g in fits] for f, i in classes]).reshape(len(classes), len(fits))
    per = sorted((r.r, r.j, r.n, r.d) for r in dealt.mapInArrow(_counted(members, place), "r int, j int, n array<long>, d array<long>").collect())
    before, rows, distinct = {}, np.zeros((len(names), len(fits)), np.int64), np.zeros((len(names), len(fits)), np.int64)
    for r, j, n, d in per:
        before[r, j] = rows[j].copy()
        rows[j] += n
        distinct[j] += d
    wanted = {}
    for j in range(len(names)):
        for t in range(len(fits)):
            at = (rows[j, t] - 1) * (np.arange(1, bins) / bins)
            wanted[j, t] = None if distinct[j, t] <= bins else np.unique(np.concatenate([np.floor(at), np.ceil(at)]).astype(np.int64))
    found: dict = {}
    for r in dealt.mapInArrow(_counted(members, place, before, wanted), "j int, t int, rank long, value double").collect():
        found.setdefault((r.j, r.t), []).append((r.rank, r.value))
    out = []
    for t in range(len(fits)):
        own = []
        for j in range(len(names)):
            if wanted[j, t] is None:
                known = np.array(sorted(v for _, v in found.get((j, t), [])))
                own.append((known[1:] + known[:-1]) / 2)
            else:
                value, at = dict(found[j, t]), (rows[j, t] - 1) * (np.arange(1, bins) / bins)
                low, high = (np.array([value[int(k)] for k in side(at)]) for side in (np.floor, np.ceil))
                own.append(np.unique(high - (high - low) * 0.5))
        out.append(own)
    return out


def _dealt(fits: list[tuple[int, int | None]], edges: list[list[np.ndarray]]):
    """(codes..., y) of the training and held-out rows of every fit, from (f, i, features..., y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, i, *x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.stack(x, axis=1)
            for t, (o, g) in enumerate(fits):
                use = f != o
                if not use.any():
                    continue
                codes = binned(x[use], edges[t]).astype(np.int64)
                packed = [(codes[:, at : at + CODES] << (8 * np.arange(codes[:, at : at + CODES].shape[1]))).sum(axis=1) for at in range(0, codes.shape[1], CODES)]
                packed[0] += (t << FIT) + ((i[use] == g).astype(np.int64) << HELD if g is not None else 0)
                yield pa.RecordBatch.from_arrays([*map(pa.array, packed), pa.array(y[use])], names=[*[f"c{k}" for k in range(len(packed))], "y"])

    return run


def _unpacked(packed: np.ndarray, width: int) -> np.ndarray:
    return np.asfortranarray(np.stack([(packed[:, f // CODES] >> (8 * (f % CODES))) & 255 for f in range(width)], axis=1))


class _Fit:
    """The rows of one fit as they come, sorted by cell, training rows first: targets go to a file."""

    def __init__(self, edges: list[np.ndarray], least: int):
        self.edges, self.least, self.sizes = edges, least, [len(e) + 1 for e in edges]
        self.file, self.cells, self.counts, self.rows = tempfile.TemporaryFile(), [], [], 0
        self.models: list | None = None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.scored = 0

    def add(self, packed: np.ndarray, y: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], (packed[1:] != packed[:-1]).any(axis=1)]))
        count = np.diff(np.append(first, len(y)))
        if self.cells and (self.cells[-1][-1] == packed[0]).all():
            self.counts[-1][-1] += count[0]
            first, count = first[1:], count[1:]
        if len(first):
            self.cells.append(packed[first])
            self.counts.append(count)
        self.file.write(np.ascontiguousarray(y).tobytes())
        self.rows += len(y)

    def fitted(self, settings: list[dict]) -> list[tuple[dict, np.ndarray | None]]:
        """Models and their tables, which are made where they are not more than the rows."""
        self.file.flush()
        y = np.asarray(np.memmap(self.file, dtype=np.float64, mode="r+", shape=(self.rows,)))
        starts = np.concatenate([[0], np.cumsum(np.concatenate(self.counts))])
        sort_cells(y, starts)
        codes, out = _unpacked(np.concatenate(self.cells), len(self.sizes)), []
        for s in settings:
            start, trees = boosted(codes, starts, y, self.sizes, s["depth"], s["rate"], s["trees"], self.least)
            model = {"edges": [e.tolist() for e in self.edges], "start": start, "trees": trees}
            out.append((model, tabulated(model) if math.prod(self.sizes) <= self.rows else None))
        return out

    def hold(self, packed: np.ndarray, y: np.ndarray, grid: tuple[dict, ...]) -> None:
        if self.models is None:
            self.models, self.errors = (self.fitted(list(grid)) if self.rows else []), np.zeros(len(grid))
        self.held.append((packed, y))
        self.waiting += len(y)
        if self.waiting >= AT_ONCE:
            self.score()

    def score(self) -> None:
        if not self.waiting:
            return
        packed, y = (np.concatenate(x) for x in zip(*self.held))
        first = np.concatenate([[True], (packed[1:] != packed[:-1]).any(axis=1)])
        codes, cell = _unpacked(packed[first], len(self.sizes)), np.cumsum(first) - 1
        for k, (model, table) in enumerate(self.models or []):
            values = walked(model, codes) if table is None else table[tuple(codes.T)]
            self.errors[k] += np.abs(values[cell] - y).sum()
        self.scored, self.held, self.waiting = self.scored + len(y), [], 0


def _fits(edges: list[list[np.ndarray]], least: int, grid: tuple[dict, ...]) -> callable:
    """Yields every fit of a stream of (codes..., y), sorted by the codes, with its number, all its rows read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Fit]]:
        number, own = -1, None
        for batch in batches:
            *packed, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            packed = np.stack(packed, axis=1)
            part, fit_, held = packed[:, 0] >> HELD, packed[:, 0] >> FIT, packed[:, 0] >> HELD & 1
            cut = np.flatnonzero(part[1:] != part[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(y)]):
                if a == b:
                    continue
                if fit_[a] != number:
                    if own is not None:
                        yield number, own
                    number, own = int(fit_[a]), _Fit(edges[int(fit_[a])], least)
                if held[a]:
                    own.hold(packed[a:b], y[a:b], grid)
                else:
                    own.add(packed[a:b], y[a:b])
        if own is not None:
            yield number, own

    return run


def boosted_out_of_fold(rows: DataFrame, features: list[str], target: str, key: str, grid: tuple[dict, ...] = GRID, fold: str = "fold", inner: str = "inner", least: int = 10) -> DataFrame:
    """Adds pred, depth, rate and trees: every row predicted by a model of the other folds.

    Per outer fold the setting is that of the least mean absolute error, averaged over the inner folds of its training rows
    (ties to the first in the grid); it is then fitted on all of these. Rows with a null feature, target, key or fold take no
    part in fits; rows with a null feature or fold get no prediction (null).
    """
    spark = rows.sparkSession
    names = [f"x{i}" for i in range(len(features))]
    numbers = [F.col(c).cast("double").alias(n) for c, n in zip([*features, target], [*names, "y"])]
    kept = checkpointed(rows.select(F.col(fold).cast("int").alias("f"), F.col(inner).cast("int").alias("i"), F.col(key).alias("k"), *numbers).na.drop().drop("k"))
    classes = sorted((r.f, r.i) for r in kept.select("f", "i").distinct().collect())
    counts, inners = sorted({f for f, _ in classes}), sorted({i for _, i in classes})
    if len(counts) < 2:
        raise ValueError("two outer folds or more are needed")
    fits: list[tuple[int, int | None]] = [*[(o, g) for o in counts for g in inners], *[(o, None) for o in counts]]
    edges = exact_edges(kept.select("f", "i", *names), names, fits)
    codes = [f"c{k}" for k in range(-(-len(names) // CODES))]

    def dealt(some: list[int]) -> DataFrame:
        """The rows of some fits, each in a task of its own, sorted by cell."""
        of = kept.select("f", "i", *names, "y").mapInArrow(_dealt([fits[t] for t in some], [edges[t] for t in some]), f"{', '.join(f'{c} long' for c in codes)}, y double")
        return of.repartitionById(len(some), F.shiftright("c0", FIT).cast("int")).sortWithinPartitions(*codes)

    tried = [t for t, (_, g) in enumerate(fits) if g is not None]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, own in _fits([edges[t] for t in tried], least, grid)(batches):
            own.score()
            if own.rows and own.scored:
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(grid), pa.int32()), pa.array(range(len(grid)), pa.int32()), pa.array(own.errors / own.scored)], names=["fit", "setting", "mae"])

    outer = F.get(F.array(*[F.lit(fits[t][0]) for t in tried]), F.col("fit"))
    errors = dealt(tried).mapInArrow(scored, "fit int, setting int, mae double").withColumn("o", outer)
    means = errors.groupBy("o", "setting").agg(F.round(F.avg("mae"), 9).alias("mae"))
    best = {r.o: r.b.setting for r in means.groupBy("o").agg(F.min(F.struct("mae", "setting")).alias("b")).collect()}
    last = [t for t, (_, g) in enumerate(fits) if g is None]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, own in _fits([edges[t] for t in last], least, grid)(batches):
            o = fits[last[t]][0]
            ((model, _),) = own.fitted([grid[best.get(o, 0)]])
            table = tabulated(model)
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([json.dumps(model)]), pa.array([None if table is None else table.tobytes()], pa.binary())], names=["o", "model", "cells"])

    models = {}
    for r in dealt(last).mapInArrow(final, "o int, model string, cells binary").collect():
        model = json.loads(r.model)
        models[r.o] = (model, None if r.cells is None else np.frombuffer(r.cells).reshape([len(e) + 1 for e in model["edges"]]))
    shipped = spark.sparkContext.broadcast(models)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last columns are the fold and the features; the others pass as they are."""
        for batch in batches:
            passed, made = batch.columns[: -1 - len(names)], [c.to_numpy(zero_copy_only=False) for c in batch.columns[-1 - len(names) :]]
            x, out = np.stack(made[1:], axis=1).astype(np.float64), np.full(batch.num_rows, np.nan)
            for o, (model, table) in shipped.value.items():
                own = np.flatnonzero((made[0] == o) & np.isfinite(x).all(axis=1))
                if len(own):
                    out[own] = predict(model, x[own], table)
            yield pa.RecordBatch.from_arrays([*passed, pa.array(out)], names=[*batch.schema.names[: len(passed)], "pred"])

    wide = rows.select("*", F.col(fold).cast("int").alias("f"), *numbers[:-1])
    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    out = wide.mapInArrow(predicted, f"{kinds}, pred double").withColumn("pred", F.when(~F.isnan("pred"), F.col("pred")))
    chosen = F.get(F.array(*[F.struct(*[F.lit(grid[best.get(o, 0)][c]).alias(c) for c in ("depth", "rate", "trees")]) for o in sorted(counts)]), F.array_position(F.array(*[F.lit(o) for o in sorted(counts)]), F.col(fold).cast("int")).cast("int") - 1)
    return out.withColumn("__s", chosen).select("*", "__s.depth", "__s.rate", "__s.trees").drop("__s")
