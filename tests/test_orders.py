"""Orders of skewed groups: concordance, quantiles and running totals against direct computations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelloom.functions import groups
from panelloom.operators import estimates, scores, tiles, voxel


def pairs_by_hand(rows):
    good = every = 0.0
    for _, ta, ea, ra in rows:
        for _, tb, _, rb in rows if ea else []:
            if tb > ta:
                every += ea
                good += ea * (1.0 if ra > rb else 0.5 if ra == rb else 0.0)
    return good / every if every else None


def cases_of(spark, rows):
    return spark.createDataFrame(rows, "fold int, time double, event int, risk double")


@pytest.mark.parametrize("leaf", [1 << 17, 20, 3])
def test_concordance_of_skewed_folds_equals_all_pairs(spark, leaf):
    """A fold with nearly all rows, many equal times, one very common risk, a fold without a pair."""
    rng = np.random.default_rng(1)
    rows = [(0, float(rng.integers(0, 40)), int(rng.random() < 0.6), float(rng.choice([1.0, *rng.integers(0, 30, 3)]))) for _ in range(300)]
    rows += [(1, float(t), 1, float(-t)) for t in range(9)] + [(2, 5.0, 1, 1.0), (2, 5.0, 1, 3.0)] + [(3, 1.0, 0, 1.0), (3, 2.0, 0, 1.0)]
    got = {r.fold: r.c_index for r in scores.concordance(cases_of(spark, rows), "fold", leaf=leaf).collect()}
    for fold in range(4):
        want = pairs_by_hand([r for r in rows if r[0] == fold])
        assert got[fold] == want if want is None else abs(got[fold] - want) < 1e-12


def test_concordance_of_a_million_cases_in_one_fold(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(0).alias("fold"), (F.col("id") * 7919 % n).cast("double").alias("time"), (F.col("id") % 2).cast("int").alias("event"), (-(F.col("id") * 7919 % n) / 3).alias("risk"))
    assert scores.concordance(rows, "fold", leaf=1 << 17).first().c_index == 1.0


def test_dominance_counts_equal_all_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 131):
        second, w, c = rng.permutation(n), rng.integers(0, 3, n), rng.integers(1, 4, n)
        want = sum(w[a] * c[b] for a in range(n) for b in range(a + 1, n) if second[b] < second[a])
        assert groups.dominance(second, w, c) == want


@pytest.mark.parametrize("small", [10**6, 50, 1])
def test_group_quantiles_of_one_group_with_nearly_all_rows(spark, small):
    rng = np.random.default_rng(7)
    values = {"a": [*rng.normal(size=700), 0.0, -0.0, 1e300, -1e300, 5e-324], "b": [2.0] * 300, "c": [1.0], "d": [None, None], None: [3.0, 1.0, None]}
    rows = spark.createDataFrame([(k, None if x is None else float(x)) for k, xs in values.items() for x in xs], "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in groups.group_quantiles(rows, ["g"], "v", shares, small=small).collect()}
    assert len(got) == 5
    for k, xs in values.items():
        known = [x for x in xs if x is not None]
        assert got[k].n == len(known)
        if known:
            assert np.allclose(got[k].q, np.quantile(known, shares), rtol=1e-12)
        else:
            assert got[k].q is None


def test_quantiles_of_the_whole_table_as_one_group(spark):
    rows = spark.range(999).select((F.col("id") * 38 % 999).cast("double").alias("v"))
    for small in (10**6, 10):
        (r,) = groups.group_quantiles(rows, [], "v", [0.5, 0.1], small=small).collect()
        assert r.n == 999 and np.allclose(r.q, [499.0, 99.8], rtol=1e-12)


def test_running_totals_inside_a_crowded_group(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 480, 0).otherwise(F.col("id") % 3 + 1).alias("g"), F.col("id").alias("o"))
    for down in (False, True):
        got = groups.group_totals(rows, ["g"], ["o"], {"s": F.col("o"), "k": F.lit(1)}, descending=down).collect()
        table = [(r.g, r.o) for r in got]
        for r in got:
            before = [o for g, o in table if g == r.g and (o >= r.o if down else o <= r.o)]
            assert (r.s, r.k) == (sum(before), len(before))


def test_every_replicate_draws_as_many_entities_as_there_are(spark):
    rows = spark.createDataFrame([("a", e) for e in range(37)] + [("b", e) for e in range(5)] * 3 + [("b", None)], "g string, e int")
    for by, sizes in (([], {(): 37}), (["g"], {("a",): 37, ("b",): 5})):
        drawn = estimates.bootstrap_weights(rows, "e", 30, "s", by).groupBy(*by, "replicate").agg(F.sum("times").alias("n"), F.count_distinct("e").alias("k")).collect()
        assert len(drawn) == 30 * len(sizes)
        for r in drawn:
            n = sizes[tuple(r[c] for c in by)]
            assert r.n == n and 1 <= r.k <= n
        # Of 37 entities a replicate leaves out about 37 / e.
        assert 20 < np.mean([r.k for r in drawn if r.n == 37]) < 27


def test_distances_of_long_lines_equal_all_pairs(spark):
    """A grid of 60 a side takes lower envelopes; two cases of different size share the batches."""
    rng = np.random.default_rng(4)
    mask = {c: np.unique(rng.integers(0, n, size=(12, 3)), axis=0) for c, n in ((1, 60), (2, 9))}
    rows = spark.createDataFrame([(c, 0, *map(int, v)) for c, vs in mask.items() for v in vs], "case_id int, tp int, z int, y int, x int")
    asked = {c: rng.integers(0, 60 if c == 1 else 9, size=(40, 3)) for c in mask}
    points = spark.createDataFrame([(c, 0, *map(int, v)) for c, vs in asked.items() for v in vs], "case_id int, tp int, z int, y int, x int")
    spacing = np.array([0.5, 1.0, 2.0])
    got = voxel.surface_distances(points, rows, tuple(spacing)).collect()
    for c in mask:
        want = [min(np.sqrt((((p - v) * spacing) ** 2).sum()) for v in mask[c]) for p in asked[c]]
        assert np.allclose(sorted(r.d for r in got if r.case_id == c), sorted(want))


def test_lower_envelope_equals_all_parabolas():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 60, 130):
        f = np.where(rng.random((200, n)) < 0.2, rng.random((200, n)) * 50, np.inf)
        i = np.arange(n)
        want = (f[:, None, :] + 0.7 * (i[:, None] - i[None, :]) ** 2).min(axis=2)
        assert np.allclose(voxel.lower_envelope(f, 0.7), want)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_masks_are_not_collected_for_joins(spark):
    suppliers = spark.range(30).withColumnRenamed("id", "case_id")
    mask = voxel.spheres(suppliers)
    assert "Broadcast" not in _plan(voxel.surface(mask))
    assert "Broadcast" not in _plan(voxel.crop(mask, voxel.centroid(mask), 6))
    assert "Broadcast" not in _plan(voxel.surface_distances(mask, mask, (1.0, 1.0, 1.0), 12))
    assert "Broadcast" not in _plan(voxel.surface_distances(mask, mask, (1.0, 1.0, 1.0)))
    assert "Broadcast" not in _plan(voxel.largest_component(mask))
    scores = estimates.evaluate({"first": mask.where("tp = 0")}, mask.where("tp = 2"), (1.0, 1.0, 1.0))
    assert "Broadcast" not in _plan(scores)


def test_a_repeated_voxel_is_one_voxel_of_a_surface(spark):
    cube = [(1, 0, z, y, x) for z in range(3) for y in range(3) for x in range(3)]
    got = [tuple(r) for r in voxel.surface(spark.createDataFrame(cube * 2, "case_id int, tp int, z int, y int, x int")).collect()]
    assert sorted(got) == sorted(set(cube) - {(1, 0, 1, 1, 1)})


def _flood(voxels, steps):
    labels, left = {}, set(voxels)
    while left:
        least = min(left)
        left.discard(least)
        stack = [least]
        while stack:
            v = stack.pop()
            labels[v] = least
            for s in steps:
                w = tuple(a + b for a, b in zip(v, s))
                if w in left:
                    left.discard(w)
                    stack.append(w)
    return labels


def test_components_across_blocks_match_a_flood(spark):
    rng = np.random.default_rng(4)
    masks = {(c, t): {tuple(int(i) for i in v) for v in rng.integers(-20, 24, (n, 3))} for c, t, n in ((1, 0, 9000), (1, 1, 16000), (None, 0, 7000))}
    frame = spark.createDataFrame([(*k, *v) for k, m in masks.items() for v in m] + [(1, 0, None, 1, 1)], "case_id long, tp int, z int, y int, x int")
    corners = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    for faces, steps in ((True, voxel.FACES), (False, corners)):
        got = {}
        for r in voxel.component_labels(frame, faces).collect():
            assert (r.case_id, r.tp, tuple(r.v)) not in got
            got[r.case_id, r.tp, tuple(r.v)] = tuple(r.label)
        assert got == {(*k, v): least for k, m in masks.items() for v, least in _flood(m, steps).items()}


def test_blocks_without_a_neighbour_take_no_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(voxel, "_settled", lambda *a: rounds.append(a))
    mask = voxel.spheres(spark.range(9).withColumnRenamed("id", "case_id"))
    assert voxel.largest_component(mask).count() == mask.count() and not rounds


def test_groups_of_as_many_entities_share_their_draws(spark):
    rows = spark.createDataFrame([(g, e, float(e)) for g, n in (("a", 40), ("b", 40), ("c", 25)) for e in range(n)] + [("a", None, 1.0), (None, 3, 1.0)], "g string, e int, s double")
    drawn = estimates.bootstrap_weights(rows, "e", 20, "7", ["g"], ["s"])
    got = {(r.g, r.replicate, r.e): (r.times, r.s) for r in drawn.collect()}
    assert all(s == e for (_, _, e), (_, s) in got.items())
    totals = {}
    for (g, replicate, _), (times, _) in got.items():
        totals[g, replicate] = totals.get((g, replicate), 0) + times
    assert totals == {(g, k): n for g, n in (("a", 40), ("b", 40), ("c", 25)) for k in range(1, 21)}
    assert {k[1:]: v for k, v in got.items() if k[0] == "a"} == {k[1:]: v for k, v in got.items() if k[0] == "b"}
    plain = {(r.g, r.replicate, r.e): r.times for r in estimates.bootstrap_weights(rows, "e", 20, "7", ["g"]).collect()}
    assert plain == {k: times for k, (times, _) in got.items()}


def test_voxels_of_a_small_file_are_made_in_many_tasks(spark):
    mask = voxel.spheres(spark.range(400).coalesce(1).withColumnRenamed("id", "case_id"))
    assert mask.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_holes_across_blocks_are_filled_without_a_broadcast(spark):
    box = [(z, y, x) for z in range(1, 19) for y in range(1, 19) for x in range(1, 19)]
    shell = [v for v in box if not all(1 < c < 18 for c in v)]
    rows = [(1, *v, 1.0) for v in shell] + [(1, 25, 0, 0, 1.0), (2, 0, 0, 0, 0.0)]
    filled = voxel.filled_foreground(spark.createDataFrame(rows, "case_id int, z int, y int, x int, value double"), 20)
    assert "Broadcast" not in _plan(filled)
    assert sorted(tuple(r) for r in filled.collect()) == sorted([(1, *v) for v in box] + [(1, 25, 0, 0)])


def test_distances_take_a_bounded_number_of_cells_at_once():
    n = 5000
    planes = pa.RecordBatch.from_pydict({"case_id": pa.array(range(n)), "tp": pa.array([0] * n, pa.int32()), "size": pa.array([12] * n, pa.int32()), "x": pa.array([3] * n, pa.int32()), "at": pa.array([[7, 20]] * n, pa.list_(pa.int32()))})
    out = list(voxel._plane_distances((1.0, 1.0), True)(iter([planes])))
    assert max(len(b.column("o").flatten()) for b in out) <= voxel.CELLS and sum(b.num_rows for b in out) == 12 * n


def test_blocks_of_tiles_are_summed_many_at_a_time(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(z), int(y), int(x), [float(v) for v in rng.normal(size=27)]) for k in ("a", "b", None) for z, y, x in rng.integers(0, 6, (5, 3)).tolist() + [[0, 0, 0]] * 2]
    merged = tiles.merge_tiles_3d(spark.createDataFrame(rows, "k string, z0 int, y0 int, x0 int, values array<double>"), "k", 3, block=2)
    assert "FlatMapGroups" not in _plan(merged)
    w, top = tiles.axis_weight(3), {}
    for k, z0, y0, x0, values in rows:
        for i, v in enumerate(values):
            z, y, x = i // 9, i // 3 % 3, i % 3
            a = top.setdefault((k, z0 + z, y0 + y, x0 + x), [0.0, 0.0])
            a[0] += w[z] * w[y] * w[x] * v
            a[1] += w[z] * w[y] * w[x]
    got = {(r.k, r.z, r.y, r.x): r.value for r in merged.collect()}
    assert got == {k: pytest.approx(a / b) for k, (a, b) in top.items()}


def test_partitions_of_voxels_do_not_grow_with_the_cases(spark):
    mask = voxel.spheres(spark.range(6000).withColumnRenamed("id", "case_id"))
    held = mask.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("case_id").alias("n"))
    most, every = held.agg(F.max("n"), F.sum("n")).first()
    assert every == 6000 and most < 1300
