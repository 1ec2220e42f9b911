"""Overlapping tiles of three axes merged by block: a tile is cut at block edges, weighted, and summed where it belongs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def axis_weight(patch: int, sigma_scale: float = 0.125) -> np.ndarray:
    """Gaussian weights along one axis of a tile, 1 at its centre and never 0; a tile's weight is their product."""
    d = (np.arange(patch) - patch // 2) / (sigma_scale * patch)
    return np.maximum(np.exp(-0.5 * d * d), 1e-12)


#: Cells of tiles or blocks that a Python task takes at once.
CELLS = 1 << 19


def _lists(values: np.ndarray) -> pa.Array:
    """One list per place of the first axis."""
    width = values[0].size
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def _cut(patch: int, block: int, sigma_scale: float, key: str):
    """Rows (key, z0, y0, x0, values) to their parts (key, bz, by, bx, box, weighted, weight), tiles of one start at a time."""
    weight = axis_weight(patch, sigma_scale)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column("values")
        if values.null_count or (pc.list_value_length(values).to_numpy(zero_copy_only=False) != patch**3).any():
            raise ValueError(f"tiles must have {patch}^3 values")
        cubes = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, patch, patch, patch)
        starts, which = np.unique(np.stack([batch.column(f"{a}0").to_numpy() for a in AXES], axis=1), axis=0, return_inverse=True)
        for number, start in enumerate(starts.tolist()):
            rows = np.flatnonzero(which.ravel() == number)
            keys = batch.column(key).take(pa.array(rows))
            spans = [[(b, max(b * block, s), min((b + 1) * block, s + patch)) for b in range(s // block, (s + patch - 1) // block + 1)] for s in start]
            for (bz, z0, z1), (by, y0, y1), (bx, x0, x1) in product(*spans):
                cut = tuple(slice(a - s, b - s) for (a, b), s in zip(((z0, z1), (y0, y1), (x0, x1)), start))
                w = weight[cut[0]][:, None, None] * weight[cut[1]][None, :, None] * weight[cut[2]][None, None, :]
                same = lambda v: np.repeat(np.asarray([v], dtype=np.int32), len(rows), axis=0)  # noqa: B023, E731
                numbers = [pa.array(same(b)) for b in (bz, by, bx)]
                weighted = w * cubes[(rows, *cut)]
                yield pa.RecordBatch.from_arrays([keys, *numbers, _lists(same([z0, z1, y0, y1, x0, x1])), _lists(weighted), _lists(np.broadcast_to(w, weighted.shape))], names=[key, "bz", "by", "bx", "box", "weighted", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // patch**3)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                yield from pa.Table.from_batches(parts(batch.slice(low, step))).combine_chunks().to_batches()

    return run


def _sum(block: int, key: str):
    """Rows (key, bz, by, bx, parts in order) to voxel rows, many blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // block**3)
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                top = np.zeros((batch.num_rows, block, block, block))
                weight = np.zeros_like(top)
                origin = np.stack([batch.column(f"b{a}").to_numpy().astype(np.int64) * block for a in AXES], axis=1)
                counts = pc.list_value_length(batch.column("parts")).to_numpy()
                row = np.repeat(np.arange(batch.num_rows), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                parts = batch.column("parts").flatten()
                box = parts.field("box").flatten().to_numpy().reshape(-1, 6) - np.repeat(origin, 2, axis=1)[row]
                # The first part of every block, then the second: a fixed order, so sums do not depend on that of arrival.
                groups, which = np.unique(np.column_stack([place, box]), axis=0, return_inverse=True)
                order = np.argsort(which.ravel(), kind="stable")
                members = np.split(order, np.flatnonzero(np.diff(which.ravel()[order])) + 1)
                lists = [(out, parts.field(name).flatten().to_numpy(zero_copy_only=False)) for out, name in ((top, "weighted"), (weight, "weight"))]
                length = pc.list_value_length(parts.field("weight")).to_numpy()
                begin = np.cumsum(length) - length
                for (_, z0, z1, y0, y1, x0, x1), some in zip(groups.tolist(), members):
                    shape = (len(some), z1 - z0, y1 - y0, x1 - x0)
                    at = begin[some][:, None] + np.arange(shape[1] * shape[2] * shape[3])
                    for out, flat in lists:
                        out[row[some], z0:z1, y0:y1, x0:x1] += flat[at].reshape(shape)
                r, *voxel = np.nonzero(weight)
                columns = [pa.array((v + origin[r, i]).astype(np.int32)) for i, v in enumerate(voxel)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(r)), *columns, pa.array(top[(r, *voxel)] / weight[(r, *voxel)])], names=[key, *AXES, "value"])

    return run


def merge_tiles_3d(tiles: DataFrame, key: str, patch: int, block: int = 32, sigma_scale: float = 0.125) -> DataFrame:
    """(key, z, y, x, value): the weighted mean of the tiles (key, z0, y0, x0, values) that cover a voxel.

    values has patch^3 numbers, x fastest; starts are not negative. A tile meets at most (patch / block + 2)^3 blocks and
    sends each its own part (the halo exchange); a block sums the parts of the tiles over it, a number that the overlap
    bounds, and only then becomes voxel rows. Tiles of another length are an error.
    """
    kind = tiles.schema[key].dataType.simpleString()
    starts = [F.col(f"{a}0").cast("int").alias(f"{a}0") for a in AXES]
    parts = tiles.select(key, *starts, F.col("values").cast("array<double>").alias("values")).mapInArrow(_cut(patch, block, sigma_scale, key), f"`{key}` {kind}, bz int, by int, bx int, box array<int>, weighted array<double>, weight array<double>")
    blocks = parts.groupBy(key, "bz", "by", "bx").agg(F.sort_array(F.collect_list(F.struct("box", "weighted", "weight"))).alias("parts"))
    return blocks.mapInArrow(_sum(block, key), f"`{key}` {kind}, z int, y int, x int, value double")


def cut_tiles_3d(voxels: DataFrame, key: str, patch: int, starts: list[int]) -> DataFrame:
    """Tiles (key, z0, y0, x0, values) at all starts along the three axes of dense voxel rows (key, z, y, x, value)."""
    begin = F.array(*[F.lit(s) for s in starts])
    rows = voxels
    for a in AXES:
        covers = lambda s: (F.col(a) >= s) & (F.col(a) < s + patch)  # noqa: B023, E731
        rows = rows.withColumn(f"{a}0", F.explode(F.filter(begin, covers)))
    place = ((F.col("z") - F.col("z0")) * patch + F.col("y") - F.col("y0")) * patch + F.col("x") - F.col("x0")
    gathered = rows.groupBy(key, *[f"{a}0" for a in AXES]).agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col("value")))).alias("v"))
    return gathered.where(F.size("v") == patch**3).select(key, *[f"{a}0" for a in AXES], F.col("v.value").alias("values"))
