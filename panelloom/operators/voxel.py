"""Voxel-table operators: masks as rows (case_id, tp, z, y, x), dense values as rows with a value column.

Cases are groups; joins and aggregations are keyed by case and voxel, so work spreads over cases and over voxels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from panelloom.functions.groups import group_quantiles
from panelloom.functions.spread import checkpointed, shuffled

KEY = ["case_id", "tp"]
VOXEL = ["z", "y", "x"]
#: Face neighbours (dz, dy, dx).
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
#: Cases a partition that are made into voxels.
CASES = 1024


def spheres(cases: DataFrame, size: int = 12) -> DataFrame:
    """Sphere masks at three times: radius 2 + n mod 3, changing by -0.4, 0 or 0.5 a step, centre shifted by n mod 2.

    Cases are few rows in few partitions, their voxels are not: cases are dealt over the shuffle partitions first, and over more
    of them above CASES a partition, so that what a task sorts does not grow with the cases.
    """
    partitions = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cases = cases.repartition(max(partitions, math.ceil(cases.count() / CASES)), "case_id")
    n = F.col("case_id")
    rate = F.when(n % 3 == 0, -0.4).when(n % 3 == 1, 0.0).otherwise(0.5)
    radius = 2 + n % 3 + rate * F.col("tp")
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    grid = cases.withColumn("tp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("z", F.explode(axis)).withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis))
    dz, dy, dx = F.col("z") - 5 - n % 2, F.col("y") - 5, F.col("x") - 6
    return grid.where(dz * dz + dy * dy + dx * dx <= radius * radius).select("case_id", "tp", "z", "y", "x")


def dense(arrays: DataFrame, key: str, column: str, shape: tuple[int, int, int]) -> DataFrame:
    """Array rows to voxel rows (key, z, y, x, value) by index arithmetic."""
    _, height, width = shape
    rows = arrays.select(key, F.posexplode(column).alias("p", "value"))
    return rows.select(key, F.floor(F.col("p") / (height * width)).cast("int").alias("z"), F.floor(F.col("p") / width % height).cast("int").alias("y"), (F.col("p") % width).alias("x"), F.col("value").cast("double").alias("value"))


def volumes(mask: DataFrame, voxel_mm3: float) -> DataFrame:
    return mask.groupBy(*KEY).agg(F.count(F.lit(1)).alias("voxels"), (F.count(F.lit(1)) * voxel_mm3).alias("volume"))


def overlap(a: DataFrame, b: DataFrame, by: str = "case_id") -> DataFrame:
    """(case, n_a, n_b, n_both, dice, signed_rvd, abs_rvd): two empty masks agree; b is the target."""
    left = a.select(by, *VOXEL).withColumn("__a", F.lit(1))
    right = b.select(by, *VOXEL).withColumn("__b", F.lit(1))
    both = left.join(right, [by, *VOXEL], "full_outer").groupBy(by).agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("n_both"))
    total = F.col("n_a") + F.col("n_b")
    rvd = F.when(F.col("n_b") > 0, (F.col("n_a") - F.col("n_b")) / F.col("n_b")).otherwise(float("nan"))
    return both.withColumn("dice", F.when(total == 0, 1.0).otherwise(2 * F.col("n_both") / total)).withColumn("signed_rvd", rvd).withColumn("abs_rvd", F.abs("signed_rvd"))


def surface(mask: DataFrame) -> DataFrame:
    """Voxels with a face neighbour outside the mask, each once; outside the grid counts as background.

    Every voxel tells itself and its neighbours, each from a side of its own, so that one aggregation finds the voxels of the
    mask that are not told from all sides.
    """
    own = 1 << len(FACES)
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx"), F.lit(1 << i).alias("side")) for i, (a, b, c) in enumerate([*FACES, (0, 0, 0)])]))
    told = mask.withColumn("__s", steps).select(*KEY, *[(F.col(c) + F.col(f"__s.d{c}")).alias(c) for c in VOXEL], F.col("__s.side").alias("__side"))
    sides = told.groupBy(*KEY, *VOXEL).agg(F.bit_or("__side").alias("__sides"))
    return sides.where((F.col("__sides") >= own) & (F.col("__sides") < 2 * own - 1)).select(*KEY, *VOXEL)


def hd95(a: DataFrame, b: DataFrame, spacing: tuple[float, float, float], q: float = 0.95, size: int | None = None) -> DataFrame:
    """(case_id, hd95): the q quantile of surface distances in both directions, pooled; only cases with both masks.

    Each surface reads its distances off the transform of the other one, inside the numpy batch that makes a slice of it;
    no voxel row of the grid is made. A case's grid is its own (up to its largest coordinate, or `size`).
    """
    sides = surface(a.select("case_id", F.lit(0).alias("tp"), *VOXEL).unionByName(b.select("case_id", F.lit(1).alias("tp"), *VOXEL)))
    sides = checkpointed(sides)
    other = sides.withColumn("tp", 1 - F.col("tp"))
    distances = checkpointed(surface_distances(sides, other, spacing, size))
    return group_quantiles(distances, ["case_id"], "d", [q]).select("case_id", F.get("q", 0).alias("hd95"))


def surface_distances(points: DataFrame, reference: DataFrame, spacing: tuple[float, float, float], size: int | None = None) -> DataFrame:
    """(case_id, tp, d): the distance of every point to the nearest reference voxel of its case and time; without one, no row."""
    every = points.select("case_id", *VOXEL).unionByName(reference.select("case_id", *VOXEL))
    sizes = every.groupBy("case_id").agg((1 + F.max(F.greatest(*VOXEL))).cast("int").alias("size")) if size is None else None
    planes = _planes(reference, size if sizes is None else None, sizes)
    slices = _slices(planes, spacing, False)
    asked = points.groupBy(*KEY, F.col("z").cast("int").alias("z")).agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))).alias("asked"))
    kind = {c: points.schema[c].dataType.simpleString() for c in KEY}
    return slices.join(shuffled(asked), [*KEY, "z"]).mapInArrow(_read_slices(spacing[2] ** 2), ", ".join(f"{c} {k}" for c, k in kind.items()) + ", d double")


def centroid(mask: DataFrame) -> DataFrame:
    return mask.groupBy(*KEY).agg(*[F.avg(c).alias(f"c{c}") for c in VOXEL])


def bounding_box(mask: DataFrame) -> DataFrame:
    return mask.groupBy(*KEY).agg(*[f(c).alias(f"{c}_{n}") for c in VOXEL for n, f in (("min", F.min), ("max", lambda v: F.max(v) + 1))])


def border_faces(mask: DataFrame, size: int) -> DataFrame:
    """(case, tp, faces): names of the grid faces that the mask touches, and touches."""
    names = [F.when(F.bool_or(F.col(c) == at), F.lit(f"{c}_{n}")) for c in VOXEL for n, at in (("low", 0), ("high", size - 1))]
    return mask.groupBy(*KEY).agg(F.array_compact(F.array(*names)).alias("faces")).withColumn("touches", F.size("faces") > 0)


#: Lines up to this length take one vectorised step per distance; longer ones a lower envelope, linear in their length.
SHORT = 48


def _min_plus(field: np.ndarray, axis: int, weight: float) -> np.ndarray:
    """min over j of field[j] + weight * (i - j)**2 along an axis; infinite values stay."""
    lines = np.moveaxis(field, axis, -1)
    if lines.shape[-1] > SHORT:
        flat = np.ascontiguousarray(lines).reshape(-1, lines.shape[-1])
        return np.moveaxis(lower_envelope(flat, weight).reshape(lines.shape), -1, axis)
    out, n = field.copy(), field.shape[axis]
    f, o = np.moveaxis(field, axis, 0), np.moveaxis(out, axis, 0)
    for step in range(1, n):
        cost = weight * step * step
        np.minimum(o[step:], f[:-step] + cost, out=o[step:])
        np.minimum(o[:-step], f[step:] + cost, out=o[:-step])
    return out


def lower_envelope(lines: np.ndarray, weight: float) -> np.ndarray:
    """min over j of lines[:, j] + weight * (i - j)**2 for all i, by the lower envelope of the parabolas of each line.

    All lines advance together: a step adds the parabola of one place, takes away those that it hides, and at the end every
    place reads the parabola that is lowest there. A parabola comes and goes once, so a line costs its length.
    """
    count, n = lines.shape
    top = np.full(count, -1)
    at = np.zeros((count, n + 1), dtype=np.int64)
    begin = np.full((count, n + 2), np.inf)
    for q in range(n):
        height = lines[:, q]
        left = np.flatnonzero(np.isfinite(height))
        while len(left):
            k = top[left]
            v = at[left, np.maximum(k, 0)]
            with np.errstate(invalid="ignore", divide="ignore"):
                cross = np.where(k >= 0, (height[left] - lines[left, v]) / (2 * weight * (q - v)) + (q + v) / 2, -np.inf)
            hidden = (k >= 0) & (cross <= begin[left, np.maximum(k, 0)])
            stay = left[~hidden]
            top[stay] += 1
            at[stay, top[stay]] = q
            begin[stay, top[stay]] = cross[~hidden]
            begin[stay, top[stay] + 1] = np.inf
            left = left[hidden]
            top[left] -= 1
    out = np.full_like(lines, np.inf)
    some = np.flatnonzero(top >= 0)
    place = np.zeros(len(some), dtype=np.int64)
    for q in range(n):
        on = np.flatnonzero(begin[some, place + 1] < q)
        while len(on):
            place[on] += 1
            on = on[begin[some[on], place[on] + 1] < q]
        v = at[some, place]
        out[some, q] = lines[some, v] + weight * (q - v) ** 2
    return out


#: Cells of grids that a Python task takes at once.
CELLS = 1 << 19


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(size, rows) of grids of one size, some CELLS of their planes at a time; rows stay in Arrow."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            rows = batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))
            step = max(1, CELLS // int(size) ** 2)
            for low in range(0, rows.num_rows, step):
                yield int(size), rows.slice(low, step)


def _repeated(batch: pa.RecordBatch, columns: list[str], row: np.ndarray) -> dict[str, pa.Array]:
    return {c: batch.column(c).take(pa.array(row)) for c in columns}


def _lines(field: np.ndarray) -> pa.Array:
    """The last axis of an array as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, field.size + 1, field.shape[-1], dtype=np.int32)), pa.array(field.ravel()))


def _counts(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _plane_distances(weights: tuple[float, float], inside: bool):
    """Rows (case, tp, size, x, voxels of the plane) to rows (case, tp, size, x, z, o, i): squared distances inside the plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _pieces(batches):
            n = batch.num_rows
            at = batch.column("at")
            held = np.zeros((n, size * size), dtype=bool)
            held[np.repeat(np.arange(n), _counts(at)), at.flatten().to_numpy()] = True
            held = held.reshape(-1, size, size)
            columns = _repeated(batch, [*KEY, "size", "x"], np.repeat(np.arange(n), size))
            columns["z"] = pa.array(np.tile(np.arange(size, dtype=np.int32), n))
            for name, source in (("o", held), ("i", ~held)) if inside else (("o", held),):
                columns[name] = _lines(_min_plus(_min_plus(np.where(source, 0.0, np.inf), 1, weights[0]), 2, weights[1]))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _slice_fields(batch: pa.RecordBatch, size: int, weight: float, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Per name the squared distances (row, x, y) of the slices in the rows of `planes`, joined across planes."""
    planes = batch.column("planes")
    every = planes.flatten()
    row, x, out = np.repeat(np.arange(batch.num_rows), _counts(planes)), every.field("x").to_numpy(), {}
    for name in names:
        # A plane without a voxel of the mask has no outside distance, and is background everywhere.
        field = np.full((batch.num_rows, size, size), np.inf if name == "o" else 0.0)
        field[row, x] = every.field(name).flatten().to_numpy().reshape(-1, size)
        out[name] = _min_plus(field, 1, weight)
    return out


def _across_planes(weight: float, inside: bool):
    """Rows (case, tp, size, z, planes [(x, o, i)]) to one row per voxel of the slice with both squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _pieces(batches):
            fields = _slice_fields(batch, size, weight, ("o", "i") if inside else ("o",))
            columns = _repeated(batch, [*KEY, "z"], np.repeat(np.arange(batch.num_rows), size * size))
            grid = np.tile(np.arange(size * size, dtype=np.int32), batch.num_rows)
            columns |= {n: pa.array(f.ravel()) for n, f in fields.items()}
            yield pa.RecordBatch.from_pydict(columns | {"x": pa.array(grid // size), "y": pa.array(grid % size)})

    return run


def _read_slices(weight: float):
    """Rows (case, tp, size, z, planes, asked [(x, y)]) to the distances at the asked places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _pieces(batches):
            field = _slice_fields(batch, size, weight, ("o",))["o"]
            asked = batch.column("asked")
            places = asked.flatten()
            row = np.repeat(np.arange(batch.num_rows), _counts(asked))
            d = np.sqrt(field[row, places.field("x").to_numpy(), places.field("y").to_numpy()])
            yield pa.RecordBatch.from_pydict(_repeated(batch, KEY, row) | {"d": pa.array(d)})

    return run


def _planes(mask: DataFrame, size: int | None, sizes: DataFrame | None) -> DataFrame:
    """(case, tp, size, x, at): the voxels of each plane of one x that holds any, as numbers z * size + y."""
    sized = mask.withColumn("size", F.lit(size)) if sizes is None else mask.join(shuffled(sizes), "case_id")
    return sized.groupBy(*KEY, "size", F.col("x").cast("int").alias("x")).agg(F.collect_set((F.col("z") * F.col("size") + F.col("y")).cast("int")).alias("at"))


def _slices(planes: DataFrame, spacing: tuple[float, float, float], inside: bool) -> DataFrame:
    """(case, tp, size, z, planes): planes transformed along z and y at once, gathered by slice."""
    kinds = "o array<double>" + (", i array<double>" if inside else "")
    kind = ", ".join(f"{c} {planes.schema[c].dataType.simpleString()}" for c in KEY)
    rows = planes.mapInArrow(_plane_distances((spacing[0] ** 2, spacing[1] ** 2), inside), f"{kind}, size int, x int, z int, {kinds}")
    return rows.groupBy(*KEY, "size", "z").agg(F.collect_list(F.struct("x", *(("o", "i") if inside else ("o",)))).alias("planes"))


def _distances(mask: DataFrame, size: int, spacing: tuple[float, float, float], inside: bool) -> DataFrame:
    """(case, tp, z, x, o, i, y): squared distances of every grid voxel to the mask and, with inside, to the background.

    Planes of one x that hold voxels are transformed along z and y at once, then the lines across planes: two shuffles of
    planes and slices, in numpy batches; no group is larger than a slice of the grid.
    """
    kind = ", ".join(f"{c} {mask.schema[c].dataType.simpleString()}" for c in KEY)
    slices = _slices(_planes(mask, size, None), spacing, inside)
    return slices.mapInArrow(_across_planes(spacing[2] ** 2, inside), f"{kind}, z int, o double, " + ("i double, " if inside else "") + "x int, y int")


def distance_transform(mask: DataFrame, size: int, spacing: tuple[float, float, float]) -> DataFrame:
    """Exact squared distance of every grid voxel to the mask; cases and times without a voxel are left out."""
    return _distances(mask, size, spacing, False).select(*KEY, *VOXEL, F.col("o").alias("d"))


def signed_distance(mask: DataFrame, size: int, spacing: tuple[float, float, float], clip: float) -> DataFrame:
    """(case, tp, z, y, x, sdf) on the whole grid: outside minus inside distance, clipped and scaled to [-1, 1].

    A mask that fills the grid has no background, so no inside distance; cases and times without a voxel are left out.
    """
    background = F.when(F.col("i") < float("inf"), F.col("i")).otherwise(0.0)
    value = F.sqrt("o") - F.sqrt(background)
    return _distances(mask, size, spacing, True).select(*KEY, *VOXEL, (F.least(F.lit(clip), F.greatest(F.lit(-clip), value)) / clip).alias("sdf"))


def crop(mask: DataFrame, centre: DataFrame, shape: int) -> DataFrame:
    """Voxels inside a cube of `shape` around the rounded (half to even) centre, in its own coordinates; nothing wraps."""
    out = mask.join(shuffled(centre), KEY)
    for c in VOXEL:
        out = out.withColumn(c, (F.col(c) - F.bround(F.col(f"c{c}") - shape / 2)).cast("int"))
    for c in VOXEL:
        out = out.where(F.col(c).between(0, shape - 1))
    return out.select(*KEY, *VOXEL)


def normalise(voxels: DataFrame, key: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Values scaled to [-1, 1] between percentiles of the finite foreground (<> 0); background and non-finite: -1."""
    from panelloom.functions.numbers import finite

    good = finite(F.col("value")) & (F.col("value") != 0)
    edges = group_quantiles(voxels.select(key, F.when(good, F.col("value")).alias("value")), [key], "value", [low, high]).drop("n")
    a, b = F.get("q", 0), F.get("q", 1)
    scaled = 2 * (F.least(b, F.greatest(a, F.col("value"))) - a) / F.greatest(b - a, F.lit(1e-6)) - 1
    return voxels.join(shuffled(edges), key).withColumn("value", F.when(good, scaled).otherwise(-1.0)).drop("q")


def intensity_range(voxels: DataFrame, key: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(key, n, lo, q_low, q_high, hi) of the finite values of each case."""
    from panelloom.functions.numbers import finite
    from panelloom.operators.scores import with_quantiles

    rows = voxels.select(key, F.when(finite(F.col("value")), F.col("value")).alias("value"))
    flat = rows.groupBy(key).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return with_quantiles(flat, rows, [key], "value", {"q_low": low, "q_high": high})


def resample_nearest(mask: DataFrame, size: int, new_size: int) -> DataFrame:
    """The mask on an aligned grid of another size: target voxel i reads source floor((i + 1/2) size / new_size)."""
    axis = F.sequence(F.lit(0), F.lit(new_size - 1))
    out = mask
    for c in VOXEL:
        table = mask.sparkSession.range(1).select(F.explode(axis).alias("__i")).select("__i", F.floor((F.col("__i") + 0.5) * size / new_size).cast("int").alias(c))
        out = out.join(F.broadcast(table), c).drop(c).withColumnRenamed("__i", c)
    return out.select(*KEY, *VOXEL)


def tile_starts(size: Column, patch: Column, step: float) -> Column:
    """Starts of sliding-window tiles that cover `size`: evenly spaced, at most patch * step apart."""
    count = F.greatest(F.ceil((size - patch) / (patch * step)).cast("int") + 1, F.lit(1))
    gap = F.when(count > 1, (size - patch) / (count - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.bround(gap * i).cast("int"))


#: Voxels along an axis of the blocks in which components are first labelled, and voxels that are labelled at once.
BLOCK, AT_ONCE = 16, 1 << 20


def _least_places(place: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """Per place (grid number * BLOCK^3 + voxel, ascending) the index of the least place of its component inside the block."""
    inside = place % BLOCK**3
    at = (inside // BLOCK**2, inside // BLOCK % BLOCK, inside % BLOCK)
    ends = []
    for step in steps:
        if step > (0, 0, 0):
            continue
        kept = np.ones(len(place), dtype=bool)
        for c, d in zip(at, step):
            kept &= (c + d >= 0) & (c + d < BLOCK)
        here = np.flatnonzero(kept)
        asked = place[here] + (step[0] * BLOCK + step[1]) * BLOCK + step[2]
        found = np.searchsorted(place, asked)
        met = place[found] == asked
        ends.append((here[met], found[met]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    root = np.arange(len(place))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further


def _block_labels(steps: list[tuple[int, int, int]], keys: list[str]):
    """Rows (keys..., at: voxels of the block) to one row (keys..., label: the least voxel, at) per component in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            upto = np.cumsum(pc.list_value_length(whole.column("at")).to_numpy())
            low = 0
            while low < whole.num_rows:
                before = upto[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(upto, before + AT_ONCE, side="right")))
                batch = whole.slice(low, high - low)
                low = high
                at = batch.column("at")
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(at).to_numpy())
                place = np.sort(row * BLOCK**3 + at.flatten().to_numpy())
                root = _least_places(place, steps)
                order = np.argsort(root, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(root[order]) > 0])
                least = place[root[order][first]]
                voxels = pa.ListArray.from_arrays(pa.array(np.r_[first, len(place)].astype(np.int32)), pa.array((place[order] % BLOCK**3).astype(np.int32)))
                told = [batch.column(c).take(pa.array(least // BLOCK**3)) for c in keys]
                yield pa.RecordBatch.from_arrays([*told, pa.array((least % BLOCK**3).astype(np.int32)), voxels], names=[*keys, "label", "at"])

    return run


def _voxel_of(code: Column) -> Column:
    """The voxel (z, y, x) of a place in the block (bz, by, bx)."""
    inside = (F.floor(code / BLOCK**2), F.floor(code / BLOCK) % BLOCK, code % BLOCK)
    return F.struct(*[(F.col(f"b{c}") * BLOCK + p).cast("long").alias(c) for c, p in zip(VOXEL, inside)])


def _components(mask: DataFrame, faces: bool, rounds: int) -> DataFrame:
    """(case_id, tp, bz, by, bx, label, at): the components cut by blocks, `at` the places of their voxels in the block.

    Blocks of 16^3 voxels are labelled in numpy, many blocks of any cases at a time. Only where a case has several blocks
    are voxels on the faces of blocks told to the blocks beside them; the components of blocks that meet there are then
    joined in rounds. A voxel without a coordinate is left out.
    """
    steps = FACES if faces else [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    block = [f"b{c}" for c in VOXEL]
    wide = mask.select(*KEY, *[F.col(c).cast("long").alias(c) for c in VOXEL]).na.drop(subset=VOXEL)
    place = [F.pmod(F.col(c), F.lit(BLOCK)).cast("int") for c in VOXEL]
    placed = wide.select(*KEY, *[F.floor(F.col(c) / BLOCK).alias(f"b{c}") for c in VOXEL], ((place[0] * BLOCK + place[1]) * BLOCK + place[2]).alias("p"))
    gathered = placed.groupBy(*KEY, *block).agg(F.collect_set("p").alias("at"))
    kind = ", ".join(f"{c} {gathered.schema[c].dataType.simpleString()}" for c in [*KEY, *block])
    parts = gathered.mapInArrow(_block_labels(steps, [*KEY, *block]), f"{kind}, label int, at array<int>")
    parts = checkpointed(parts.withColumn("label", _voxel_of(F.col("label"))))
    number = F.struct(*block)
    several = parts.groupBy(*KEY).agg(F.min(number).alias("first"), F.max(number).alias("last")).where("first <> last").select(*KEY)
    crowd = checkpointed(parts.alias("p").join(shuffled(several.alias("s")), _same_case("p", "s"), "left_semi"))
    if crowd.isEmpty():
        return parts
    offsets = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in steps])
    outer = crowd.withColumn("p", F.explode("at")).withColumn("v", _voxel_of(F.col("p"))).select(*KEY, *block, "v", "label")
    on_face = F.lit(False)
    for c in VOXEL:
        on_face = on_face | F.pmod(F.col(f"v.{c}"), F.lit(BLOCK)).isin(0, BLOCK - 1)
    outer = outer.where(on_face)
    told = outer.withColumn("__o", F.explode(offsets)).withColumn("w", F.struct(*[(F.col(f"v.{c}") + F.col(f"__o.d{c}")).alias(c) for c in VOXEL]))
    # Each pair of neighbours in different blocks once; groups with a null key are kept apart by null-safe joins.
    beyond = F.lit(False)
    for c in VOXEL:
        beyond = beyond | (F.floor(F.col(f"w.{c}") / BLOCK) != F.col(f"b{c}"))
    met = told.where(beyond & (F.col("w") < F.col("v"))).alias("e").join(shuffled(outer.alias("t")), _same_case("e", "t") & (F.col("e.w") == F.col("t.v")))
    edges = checkpointed(met.select("e.case_id", "e.tp", F.col("e.label").alias("v"), F.col("t.label").alias("w")).distinct())
    root = _settled(edges, rounds).select(*KEY, F.col("v").alias("label"), F.col("label").alias("least"))
    joined = parts.alias("p").join(shuffled(root.alias("r")), _same_case("p", "r") & (F.col("p.label") == F.col("r.label")), "left")
    return checkpointed(joined.select(*[F.col(f"p.{c}") for c in [*KEY, *block]], F.coalesce("r.least", "p.label").alias("label"), "p.at"))


def _settled(edges: DataFrame, rounds: int) -> DataFrame:
    """(case_id, tp, v, label): the least node that each node of the edges (v, w) reaches.

    Every node points at a lower one that it reaches; each round hooks the roots that neighbours point at to the least of
    them and then jumps pointers until all are roots, so the rounds follow the logarithm of a path's length. Lineage is cut
    by checkpoints. An error is raised if labels have not settled after `rounds` rounds.
    """
    own, cut = _same_case, checkpointed
    nodes = edges.select(*KEY, "v").union(edges.select(*KEY, "w")).distinct()
    root = cut(nodes.withColumn("label", F.col("v")))
    for _ in range(rounds):
        labelled = edges.alias("e").join(shuffled(root.alias("r")), own("e", "r") & (F.col("e.v") == F.col("r.v"))).select("e.*", F.col("r.label").alias("a"))
        labelled = labelled.alias("e").join(shuffled(root.alias("r")), own("e", "r") & (F.col("e.w") == F.col("r.v"))).select(*[F.col(f"e.{c}") for c in KEY], "a", F.col("r.label").alias("b"))
        hooks = cut(labelled.where("a <> b").groupBy(*KEY, F.greatest("a", "b").alias("v")).agg(F.min(F.least("a", "b")).alias("low")))
        if hooks.isEmpty():
            break
        hooked = root.alias("r").join(shuffled(hooks.alias("h")), own("r", "h") & (F.col("r.v") == F.col("h.v")), "left")
        root = cut(hooked.select("r.case_id", "r.tp", "r.v", F.coalesce("h.low", "r.label").alias("label")))
        for _ in range(rounds):
            jumped = root.alias("r").join(shuffled(root.select(*KEY, F.col("v").alias("at"), F.col("label").alias("to")).alias("s")), own("r", "s") & (F.col("r.label") == F.col("s.at")))
            jumped = cut(jumped.select("r.case_id", "r.tp", "r.v", "r.label", "s.to"))
            root = jumped.select(*KEY, "v", F.col("to").alias("label"))
            if jumped.where("label <> to").isEmpty():
                break
        else:
            raise RuntimeError(f"pointers did not settle in {rounds} jumps")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return root


def component_labels(mask: DataFrame, faces: bool = False, rounds: int = 100) -> DataFrame:
    """(case_id, tp, v, label): the lowest voxel (z, y, x) of the component of each distinct voxel v.

    Neighbours share a corner, or with `faces` a face. Voxels are compared by (z, y, x), so axes of any length do.
    """
    return _components(mask, faces, rounds).withColumn("p", F.explode("at")).select(*KEY, _voxel_of(F.col("p")).alias("v"), "label")


def _same_case(a: str, b: str) -> Column:
    return F.col(f"{a}.case_id").eqNullSafe(F.col(f"{b}.case_id")) & F.col(f"{a}.tp").eqNullSafe(F.col(f"{b}.tp"))


def largest_component(mask: DataFrame, rounds: int = 100) -> DataFrame:
    """Voxels of the largest 26-connected component per (case, tp), each once; ties go to the one with the lowest voxel."""
    own = _same_case
    parts = _components(mask, False, rounds)
    sizes = parts.groupBy(*KEY, "label").agg(F.sum(F.size("at")).alias("n"))
    best = sizes.groupBy(*KEY).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(*KEY, F.col("b.label").alias("label"))
    kept = parts.alias("p").join(shuffled(best.alias("b")), own("p", "b") & (F.col("p.label") == F.col("b.label")), "left_semi")
    voxels = kept.withColumn("p", F.explode("at")).select(*KEY, _voxel_of(F.col("p")).alias("v"))
    return voxels.select(*KEY, *[F.col(f"v.{c}").cast(mask.schema[c].dataType).alias(c) for c in VOXEL])


def filled_foreground(voxels: DataFrame, size: int, key: str = "case_id") -> DataFrame:
    """Voxels (key, z, y, x) where any channel's value is not 0, and the holes that they enclose.

    A hole is a face-connected component of the background without a voxel on the border of the grid of `size`; the rounds
    that label components follow the logarithm of their paths, however they wind.
    """
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    grid = voxels.select(key).distinct()
    for c in VOXEL:
        grid = grid.withColumn(c, F.explode(axis.cast(ArrayType(voxels.schema[c].dataType))))
    given = voxels.select(key, *VOXEL, F.coalesce(F.col("value") != 0, F.lit(False)).alias("on"), F.lit(False).alias("in_grid"))
    told = given.unionByName(grid.withColumns({"on": F.lit(False), "in_grid": F.lit(True)}))
    cells = checkpointed(told.groupBy(key, *VOXEL).agg(F.bool_or("on").alias("on"), F.bool_or("in_grid").alias("in_grid")))
    back = cells.where("not on and in_grid").select(F.col(key).alias("case_id"), F.lit(0).alias("tp"), *VOXEL)
    parts = _components(back, True, 100).withColumn("voxels", F.transform("at", _voxel_of))
    edge = F.lit(False)
    for c in VOXEL:
        edge = edge | F.exists(f"voxels.{c}", lambda v: v.isin(0, size - 1))
    open_ones = parts.where(edge).select("case_id", "label").distinct().alias("o")
    same = F.col("l.case_id").eqNullSafe(F.col("o.case_id")) & (F.col("l.label") == F.col("o.label"))
    holes = parts.alias("l").join(shuffled(open_ones), same, "left_anti").withColumn("v", F.explode("voxels"))
    kinds = {c: voxels.schema[c].dataType for c in VOXEL}
    front = cells.where("on").select(key, *VOXEL)
    return front.unionByName(holes.select(F.col("case_id").alias(key), *[F.col(f"v.{c}").cast(kinds[c]).alias(c) for c in VOXEL]))


def resample_linear(values: DataFrame, size: int, new_size: int) -> DataFrame:
    """Values (key..., z, y, x, value) on an aligned grid of another size, by trilinear interpolation between the nearest
    source voxels; beyond the outer centres the border value holds, absent voxels are 0.

    Each source voxel gives its share to the target voxels between its neighbours, one axis after the other, so there is
    one small broadcast table of weights per axis and one aggregation per axis.
    """
    spark = values.sparkSession
    out = values
    for c in VOXEL:
        i = F.col("__i")
        place = F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), (i + 0.5) * size / new_size - 0.5))
        low = F.floor(place)
        table = spark.range(new_size).select(F.col("id").cast("int").alias("__i")).withColumn("__p", place).withColumn("__l", low)
        part = lambda at, w: F.struct(at.cast("int").alias("at"), w.alias("w"))
        table = table.select("__i", F.explode(F.array(part(F.col("__l"), 1 - (F.col("__p") - F.col("__l"))), part(F.col("__l") + 1, F.col("__p") - F.col("__l")))).alias("__e")).select("__i", F.col("__e.at").alias(c), F.col("__e.w").alias("__w")).where("__w > 0")
        rest = [v for v in out.columns if v not in (c, "value")]
        out = out.join(F.broadcast(table), c).groupBy(*rest, F.col("__i").alias(c)).agg(F.sum(F.col("__w") * F.col("value")).alias("value"))
    return out
