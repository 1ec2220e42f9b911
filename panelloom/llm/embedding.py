"""Embedding near-dedup: sketches find what may be near, tiles of cosine products compare it, one representative per group.

Unit vectors with a cosine of 0.98 are at most d = sqrt(2 - 2 * cosine) apart, and so are their places on any orthonormal
axes. A sketch is a vector's places on up to 32 axes of a sample, in whole steps of d / 48: 32 bytes. All sketches of a label
meet in pairs of parts (12 parts at most, so a sketch is copied twelve times at most, whatever the table's size), and what
rounding and the missing axes may hide counts as near; so no pair is missed. Vectors are then known by the component of their
near sketches, vectors with no near sketch leave, and only the others are shuffled with all their numbers. The comparisons of
sketches grow with the square of a label, less what boxes around leaves of 512 rows tell apart.

Inside a component, centroids are fitted on a bounded sample where cells make fewer copies than tiles alone. A vector belongs
to the cell of its nearest centroid and could also meet a neighbour in that neighbour's cell: a neighbour of x can only lie in
cell c if x is within d of the plane that divides c from x's own cell. A pair is compared in the lower-numbered of its two
cells, so a vector is shown to its own cell and to those lower ones that pass this bound: every pair at the threshold meets
exactly once and recall is 1, whatever the axes and centroids are. Equal vectors are compared once and counted by their
number; cells of any size are cut into tiles, and a tile returns link counts and a spanning forest, not its pairs.

Edge cases: vectors that are null, empty, zero or with null or non-finite components, and rows with a null label, link
with nothing and are kept; vectors of different length never link, so each length of a label is a group of its own; equal vectors (repeated rows) link with each other; rows that repeat a
vec_id are vectors of their own; an empty table gives an empty result; extra columns are ignored. The table is read twice.
Components are joined in rounds whose number follows the logarithm of a component's size; over 50 raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import _tiles
from panelloom.llm._spark import checkpointed, components, free_shuffles, keyed_uniform, read

#: Axes of a sketch at most, and steps in which it takes the distance of two neighbours.
AXES, REACH = 32, 48


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit vectors, started from a farthest-first walk; empty cells keep their centroid."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centroids = x[chosen].copy()
    for _ in range(rounds):
        cell = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        moved = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centroids)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def fit_cells(distinct: DataFrame, kind: str, reach: float, sample: int, cell_rows: int, max_cells: int, tile: int) -> dict[str, np.ndarray]:
    """Centroids per label from at most `sample` vectors in all; about one cell per cell_rows vectors of a label.

    Labels whose vectors would be shown to so many cells that they are copied more often than by tiles alone have none.
    """
    draw = keyed_uniform("cells", F.col("node").cast("string"))
    picked = distinct.select("label", "vector", draw.alias("draw")).orderBy("draw").limit(sample)
    sizes = picked.join(distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    out = {}
    for label, rows in sizes.toPandas().sort_values("draw").groupby("label"):
        n = rows["n"].iloc[0]
        k = min(max_cells, math.ceil(n / cell_rows), len(rows))
        if k > 1:
            x = _matrix(rows["vector"], kind)
            centroids = spherical_kmeans(x, k)
            share = _shown(x @ centroids.T, centroids, reach)[1].mean(axis=0)
            if (share * np.ceil(share * n / tile)).sum() < math.ceil(n / tile):
                out[label] = centroids
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(vectors: pd.Series, kind: str) -> np.ndarray:
    """The unit vectors of vectors that come as bytes of numbers of a kind."""
    return _unit(np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64))


def _binary(values: np.ndarray, ends: np.ndarray, usable: np.ndarray) -> pa.Array:
    """Bytes of the numbers up to each end, null where a row is not usable."""
    offsets = np.concatenate([[0], values.itemsize * ends]).astype(np.int32)
    valid = np.packbits(usable, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(usable), [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _usable(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Usable vectors as bytes of their kind and of their units, null for others; the label is joined by the length."""
        for batch in batches:
            lists = batch.column(2)
            length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            usable = np.asarray(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid())) & (length > 0)
            read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for size in np.unique(length[usable]).tolist():
                at = np.flatnonzero(usable & (length == size))
                values = lists.take(pa.array(at)).flatten()
                x = np.asarray(values.fill_null(float("nan")), dtype=np.float64).reshape(len(at), size)
                with np.errstate(invalid="ignore"):
                    largest = np.abs(x).max(axis=1)
                good = np.isfinite(largest) & (largest > 0)
                usable[at[~good]] = False
                read[size] = at[good], x[good]
            ends = np.cumsum(np.where(usable, length, 0))
            flat, unit = (np.empty(ends[-1] if len(ends) else 0, dtype=k) for k in (kind, np.float64))
            for size, (at, x) in read.items():
                place = (ends[at] - size)[:, None] + np.arange(size)
                flat[place], unit[place] = x, _unit(x)
            group = pc.binary_join_element_wise(pc.cast(batch.column(1), pa.string()), pa.array(length.astype(str), pa.string()), ":")
            yield pa.RecordBatch.from_arrays([batch.column(0), group, _binary(flat, ends, usable), _binary(unit, ends, usable)], names=["vec_id", "label", "vector", "unit"])

    return run


def fit_axes(distinct: DataFrame, kind: str, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vectors a centre and up to AXES orthonormal axes, along which the units of a bounded sample vary most.

    Any orthonormal axes do: they change how much is pruned, not what is found. Lengths outside the sample have none.
    """
    picked = distinct.select(F.length("vector").alias("size"), "vector", keyed_uniform("axes", F.col("node").cast("string")).alias("draw"))
    out = {}
    for size, rows in picked.orderBy("draw").limit(sample).toPandas().groupby("size"):
        x = _matrix(rows["vector"], kind)
        rest = x - x.mean(axis=0)
        axes = np.random.default_rng(1).normal(size=(x.shape[1], min(AXES, x.shape[1])))
        for _ in range(4):
            axes = np.linalg.qr(rest.T @ (rest @ axes) / len(x) + 1e-9 * axes)[0]
        # Strongest first.
        axes = axes @ np.linalg.eigh(axes.T @ (rest.T @ (rest @ axes)))[1][:, ::-1]
        out[x.shape[1]] = x.mean(axis=0), axes
    return out


def _sketched(shipped, parts: dict[str, int], kind: str, step: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes and sketches of a batch by label and part, one row for each tile that must see them."""
        for batch in batches:
            frame = batch.to_pandas()
            labels, tis, tjs, own, blobs = [], [], [], [], []
            for label, rows in frame.groupby("label"):
                x, node, g = _matrix(rows["vector"], kind), rows["node"].to_numpy(np.int64), parts.get(label, 1)
                centre, axes = shipped.value.get(x.shape[1], (0.0, np.eye(x.shape[1], min(AXES, x.shape[1]))))
                sketch = np.clip(np.rint((x - centre) @ axes / step), -127, 127).astype(np.int8)
                for part in np.unique(node % g).tolist():
                    mine = node % g == part
                    blob = node[mine].tobytes() + sketch[mine].tobytes()
                    for other in range(g):
                        labels.append(label), tis.append(min(part, other)), tjs.append(max(part, other)), own.append(part), blobs.append(blob)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), *[pa.array(c, pa.int32()) for c in (tis, tjs, own)], pa.array(blobs, pa.binary())], names=["label", "ti", "tj", "part", "blob"])

    return run


def _leaves(q: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows cut at medians of the widest axis until no leaf has more than `most`."""
    todo, out = [np.arange(len(q))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        mine = q[rows]
        order = np.argsort(mine[:, mine.var(axis=0).argmax()], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class _Forest:
    """Components of the edges that were added so far, of which few are held at a time."""

    def __init__(self, n: int, hold: int = 1 << 20):
        self.root, self.held, self.n, self.hold = np.arange(n), [], 0, hold

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.root[a] != self.root[b]
        self.held.append((self.root[a[new]], self.root[b[new]]))
        self.n += int(new.sum())
        if self.n > self.hold:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.n:
            a, b = (self.root[np.concatenate(x)] for x in zip(*self.held))
            node, least = _tiles.spanning_edges(a, b)
            to = np.arange(len(self.root))
            to[node] = least
            self.root, self.held, self.n = to[self.root], [], 0
        return self.root


def _lifted(q: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b with a @ b = -(squared distance) / 2 over the first dims; whole halves, so exact as floats."""
    f = q[:, :dims].astype(np.float32)
    half, one = (f * f).sum(axis=1)[:, None] / -2, np.ones((len(f), 1), np.float32)
    return np.hstack([f, half, one]), np.hstack([f, one, half])


def near_sketches(q: np.ndarray, left: int, within: bool, forest: _Forest, leaf: int = 512, first: int = 20, wide: int = 2048) -> None:
    """Adds to the forest the pairs of rows at most REACH steps apart, and as much as rounding may hide: of rows below
    `left` with the others, or, if within, of all rows.

    A leaf of rows meets those rows that are near the box around it; most pairs are told by the first axes.
    """
    most = lambda dims: (REACH + math.sqrt(dims)) ** 2 + 1e-3
    width, left = q.shape[1], len(q) if within else left
    first = min(first, width)
    (a1, b1), (a2, b2) = _lifted(q, first), _lifted(q, width)
    places = np.asfortranarray(q.astype(np.int16))
    spread = q.std(axis=0) + 1e-9
    products, hits = np.empty(leaf * wide, np.float32), np.empty(leaf * wide, bool)
    done = np.zeros(len(q), dtype=bool)
    done[:left] = not within
    for rows in _leaves(q[:left], leaf):
        low, high = places[rows].min(axis=0), places[rows].max(axis=0)
        others = np.flatnonzero(~done)
        if within:
            done[rows] = True
        # The axes along which the box is narrow tell most rows apart.
        near = np.zeros(len(others), dtype=np.int32)
        for d in np.argsort((high - low) / spread)[:10]:
            x = places[others, d]
            gap = np.maximum(np.maximum(low[d] - x, x - high[d]), 0).astype(np.int32)
            near += gap * gap
        others = others[near <= most(width)]
        own = a1[rows]
        for at in range(0, len(others), wide):
            some = others[at : at + wide]
            product, hit = (x[: len(rows) * len(some)].reshape(len(rows), len(some)) for x in (products, hits))
            np.matmul(own, b1[some].T, out=product)
            found = np.flatnonzero(np.greater_equal(product, np.float32(-most(first) / 2), out=hit).ravel())
            if len(found) > hit.size >> 6:
                found = np.flatnonzero((a2[rows] @ b2[some].T >= -most(width) / 2).ravel())
                i, j = rows[found // len(some)], some[found % len(some)]
            else:
                i, j = rows[found // len(some)], some[found % len(some)]
                keep = np.einsum("ij,ij->i", a2[i], b2[j]) >= -most(width) / 2
                i, j = i[keep], j[keep]
            if within:
                apart = i != j
                i, j = i[apart], j[apart]
            forest.add(i, j)


def _sketch_edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(unit: pd.DataFrame) -> pd.DataFrame | None:
        width = min(AXES, int(unit["label"].iloc[0].rsplit(":", 1)[1]))
        sides, within = [], unit["ti"].iloc[0] == unit["tj"].iloc[0]
        for part in (unit["ti"].iloc[0], unit["tj"].iloc[0])[: 1 if within else 2]:
            blobs = unit["blob"][unit["part"] == part]
            counts = [len(b) // (8 + width) for b in blobs]
            sides.append((np.frombuffer(b"".join(b[: 8 * n] for b, n in zip(blobs, counts)), np.int64), np.frombuffer(b"".join(b[8 * n :] for b, n in zip(blobs, counts)), np.int8).reshape(-1, width)))
        node, q = (np.concatenate(x) for x in zip(*sides))
        forest = _Forest(len(node))
        near_sketches(q, len(sides[0][0]), within, forest)
        root = forest.settle()
        own = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": node[own], "b": node[root[own]]}) if len(own) else None

    return _tiles.run_units(frames, ["label", "ti", "tj"], one)


def near_groups(distinct: DataFrame, kind: str, threshold: float, sample: int, part_rows: int = 8192, max_parts: int = 12) -> DataFrame:
    """(node, component) of all vectors that may have a neighbour at the threshold; neighbours share their component.

    Vectors are told apart by sketches: their places on a few orthonormal axes, in whole steps. Two units d apart are at
    most d apart on the axes, so none is missed. A label is cut into parts, and each pair of parts is one unit of work.
    """
    step = max(math.sqrt(2 - 2 * threshold + 1e-12), 1e-3) / REACH
    large = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows).collect()
    parts = {r.label: min(max_parts, math.ceil(r.n / part_rows)) for r in large}
    shipped = distinct.sparkSession.sparkContext.broadcast(fit_axes(distinct, kind, sample))
    sketched = distinct.select("label", "node", "vector").mapInArrow(_sketched(shipped, parts, kind, step), "label string, ti int, tj int, part int, blob binary")
    dealt = sketched.repartition("label", "ti", "tj").sortWithinPartitions("label", "ti", "tj")
    return components(dealt.mapInPandas(_sketch_edges, "a long, b long"))


def _shown(near: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, and whether it is shown to a cell, by its products with the centroids."""
    home = near.argmax(axis=1)
    apart = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)
    shown = near[np.arange(len(near)), home][:, None] - near <= reach * apart[home] + 1e-9
    return home, shown & (np.arange(len(centroids))[None, :] <= home[:, None])


def _assign(shipped, kind: str, reach: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shipped.value
        for frame in frames:
            cut = frame["label"].isin(list(centroids))
            yield frame.loc[~cut, ["label", "node"]].assign(cell=0, home=0)[["label", "cell", "home", "node"]]
            for label, rows in frame[cut].groupby("label"):
                home, shown = _shown(_matrix(rows["vector"], kind) @ centroids[label].T, centroids[label], reach)
                row, cell = np.nonzero(shown)
                yield pd.DataFrame({"label": label, "cell": cell, "home": home[row], "node": rows["node"].to_numpy()[row]})

    return run


def _compare(threshold: float, kind: str):
    keys = ["label", "cell", "__ti", "__tj"]

    def one(unit: pd.DataFrame) -> pd.DataFrame | None:
        x, home = _matrix(unit["vector"], kind), unit["home"].to_numpy()
        linked = x @ x.T >= threshold
        linked &= np.minimum(home[:, None], home[None, :]) == unit["cell"].iloc[0]
        np.fill_diagonal(linked, False)
        chunk = unit["__chunk"].to_numpy()
        if unit["__ti"].iloc[0] != unit["__tj"].iloc[0]:
            linked &= chunk[:, None] != chunk[None, :]
        if not linked.any():
            return None
        found = linked @ unit["copies"].to_numpy()
        node = unit["node"].to_numpy()
        root = node[_tiles.dense_components(linked)]
        use = linked.any(axis=1)
        return pd.DataFrame({"node": node[use], "root": root[use], "links": found[use].astype(np.int64)})

    return lambda frames: _tiles.run_units(frames, keys, one)


def near_duplicates(rows: DataFrame, threshold: float = 0.98, sample: int = 4096, cell_rows: int = 1024, max_cells: int = 256, tile: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    read_in = clean.mapInArrow(_usable(kind), "vec_id long, label string, vector binary, unit binary")
    # Equal vectors are known by 128 bits of their hashes.
    equal = ["label", "k1", "k2"]
    read_in = read_in.select("vec_id", "label", "vector", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")).alias("k1"), F.xxhash64(F.lit(7), "unit").alias("k2"))
    # The vectors themselves are kept once for each distinct one.
    distinct = read_in.where("k1 is not null").groupBy(*equal).agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    # Rows may repeat a vec_id, so vectors go by a hash of their own that keeps nothing else of it.
    distinct = checkpointed(distinct.withColumn("node", F.xxhash64(*equal)))
    vectors = checkpointed(read_in.drop("vector"))
    good = vectors.where("k1 is not null")
    free_shuffles(rows.sparkSession)
    grouped = near_groups(distinct, kind, threshold, sample).withColumnRenamed("component", "group")
    close = checkpointed(distinct.select("node", "copies", "vector").join(grouped, "node").withColumn("label", F.col("group").cast("string")).drop("group"))
    free_shuffles(rows.sparkSession)
    reach = math.sqrt(2 - 2 * threshold)
    shipped = rows.sparkSession.sparkContext.broadcast(fit_cells(close, kind, reach, sample, cell_rows, max_cells, tile))
    cells = close.select("label", "vector", "node").mapInPandas(_assign(shipped, kind, reach), "label string, cell int, home int, node long")
    units = _tiles.tiled(cells, ["label", "cell"], "node", tile).join(close.select("node", "vector", "copies"), "node")
    ordered = units.select("label", "cell", "__ti", "__tj", "__chunk", "home", "node", "vector", "copies").repartition("label", "cell", "__ti", "__tj").sortWithinPartitions("label", "cell", "__ti", "__tj", "node")
    found = checkpointed(ordered.mapInPandas(_compare(threshold, kind), "node long, root long, links long"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = distinct.select(*equal, "node", "first_id", "copies").join(linked, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(firsts, "root").select(*equal, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    members = good.select("vec_id", *equal).join(classes, equal).select("vec_id", "n_links", "component_id")
    alone = vectors.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all embeddings at cosine 0.98 within labels."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
), pairs as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(id, seen) as (
  select vec_id, vec_id from v
  union
  select r.id, p.y from reach r join pairs p on r.seen = p.x
), c as (select id, min(seen) as component_id from reach group by id),
n as (select x, count(*) as n from pairs group by x)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.id = v.vec_id left join n on n.x = v.vec_id
"""


def queries() -> dict:
    return {"op6_embedding": op6_embedding}


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding": ORACLE}
