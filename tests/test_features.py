"""Pairing, review selection, checked folds, streamed runs, sketches, tiles, and the literal fixtures of reviews and geometry."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.functions import spread
from panelloom.operators import checks, estimates, review, scores, sketches, summaries, tiles, voxel, windows
from panelloom.plans import feature_queries, panel_queries
from panelloom.sources import pairing, tables
from panelloom.streaming import runs

CUBE = "case_id int, tp int, z int, y int, x int"


def cube(spark, low, high, case=1, tp=0, z=0):
    return spark.createDataFrame([(case, tp, a + z, b, c) for a in range(low, high) for b in range(low, high) for c in range(low, high)], CUBE)


# Pairing of stems (X5, X6)


def test_files_of_one_folder_make_one_pair(spark, tmp_path):
    folder = tmp_path / "in" / "VS_0001_01"
    folder.mkdir(parents=True)
    for name in ("t1post", "t1postIAC", "seg_t1postIAC"):
        (folder / f"VS_0001_01_{name}.nii.gz").write_bytes(b"x")
    (r,) = pairing.pair_stems(tables.file_index(spark, str(tmp_path))).collect()
    assert (r.exam, r.entity_id, r.pairs, r.status, r.reference) == ("VS_0001_01", "VS_0001", 1, "resolved", "t1postiac")
    assert r.image_path.endswith("VS_0001_01/VS_0001_01_t1postIAC.nii.gz") and r.mask_path.endswith("VS_0001_01_seg_t1postIAC.nii.gz")


def test_folders_without_a_single_pair_are_ambiguous(spark):
    names = {
        "a/VS_0001_01": ["VS_0001_01_t1post.nii", "VS_0001_01_seg_t1post.nii", "VS_0001_01_t1postIAC.nii", "VS_0001_01_seg_t1postIAC.nii"],
        "a/vs_0002_01": ["vs_0002_01_seg_t1post.nii.gz", "notes.txt"],
        "b/VS_0003_01": ["VS_0003_01_t1post.nii", "VS_0003_01_T1POST.nii.gz", "VS_0003_01_seg_t1post.nii.gz", "VS_0009_01_t1postIAC.nii.gz"],
        "b/other": ["VS_0004_01_t1post.nii.gz"],
    }
    rows = spark.createDataFrame([(f"{d}/{n}",) for d, ns in names.items() for n in ns] + [(None,), ("x.nii",)], "path string")
    got = {r.exam: (r.pairs, r.status, r.image_path) for r in pairing.pair_stems(rows).collect()}
    assert got == {"VS_0001_01": (2, "ambiguous", None), "VS_0002_01": (0, "ambiguous", None), "VS_0003_01": (1, "resolved", "b/VS_0003_01/VS_0003_01_t1post.nii")}


# Reviews (X14, X15, X17, X18) and folds


def test_all_flagged_cases_are_selected_before_a_repeatable_sample(spark):
    rows = [(f"T{i}", i not in (2, 5), json.dumps([0.9 - i / 100, 1.0, 0.95])) for i in range(8)] + [("T2", False, None), ("T5", True, "[0.1]")]
    frame = spark.createDataFrame(rows, "triplet_id string, ok boolean, overlaps string").withColumn("least", review.least_overlap(F.col("overlaps")))
    first, again = (review.review_selection(frame, "triplet_id", "least", F.col("ok"), 3, "7").orderBy("place").collect() for _ in range(2))
    assert first == again and len(first) == 5 and [r.place for r in first] == list(range(5))
    assert [r.triplet_id for r in first[:2]] == ["T5", "T2"] and {r.kind for r in first[2:]} == {"passed"}
    assert len({r.triplet_id for r in first}) == 5
    (one,) = review.review_selection(frame, "triplet_id", "least", F.col("ok"), 0, "7", most_flagged=1).collect()
    assert (one.triplet_id, one.kind) == ("T5", "flagged")
    assert review.review_selection(frame.limit(0), "triplet_id", "least", F.col("ok"), 3, "7").collect() == []


def test_messages_have_the_category_of_the_first_rule(spark):
    rules = [("no such file", "missing"), ("geometry", "geometry"), ("empty", "empty"), ("shape", "geometry")]
    texts = ["No such file: x", "Geometry differs", "mask is EMPTY", "Shape mismatch", "boom"]
    rows = spark.createDataFrame([(t,) for t in texts], "m string").select(checks.first_match(F.col("m"), rules, "other").alias("c"))
    assert [r.c for r in rows.collect()] == ["missing", "geometry", "empty", "geometry", "other"]


def test_a_cohort_freezes_with_the_folds_of_its_entities(spark):
    cases = spark.createDataFrame([(f"c{i}", f"e{i % 5}", i != 3) for i in range(6)], "case string, entity_id string, ok boolean")
    folds = spark.createDataFrame([(f"e{i}", i) for i in range(5)], "entity_id string, fold int")
    frozen = review.freeze(cases, folds, F.col("ok"), "case", 5)
    assert sorted((r.case, r.fold) for r in frozen.select("case", "fold").collect()) == [("c0", 0), ("c1", 1), ("c2", 2), ("c4", 4), ("c5", 0)]
    everything = review.freeze(cases, folds, F.lit(True), "case", 5)
    assert everything.count() == 6
    assert len(checks.table_digest(frozen).first().digest) == 64
    with pytest.raises(ValueError, match="columns are missing"):
        review.require_columns(cases, ["case", "mask_path"])


def test_an_entity_of_two_folds_stops_the_fold_loop(spark):
    good = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1)], "entity_id string, fold int")
    assert sorted(map(tuple, review.checked_folds(good).select("entity_id", "fold").collect())) == [("a", 0), ("a", 0), ("b", 1)]
    for bad in ([("a", 0), ("a", 1)], [("a", None)]):
        with pytest.raises(PySparkException, match="several folds or none: a"):
            review.checked_folds(spark.createDataFrame(bad, "entity_id string, fold int")).collect()


# Clinical columns and summaries (X4, X7, X16)


def test_days_add_up_and_treatments_cross(spark):
    rows = [("VS_0001", 1, None, "Pre", -50.0, False), ("VS_0001", 2, 100.0, "Post", 50.0, False), ("VS_0001", 3, 200.0, "Post", 250.0, True)]
    panel = spark.createDataFrame(rows, "entity_id string, obs_id int, gap double, state string, since double, absent boolean").withColumn("t", F.col("obs_id").cast("double"))
    days = windows.cumulative_time(panel, "gap").orderBy("obs_id").collect()
    assert [r.elapsed for r in days] == [0.0, 100.0, 300.0] and [r.bad_gap for r in days] == [False] * 3
    crossed = windows.transition(panel.withColumn("post", F.col("state") == "Post"), "since", "post").orderBy("obs_id").collect()
    assert [r.switched for r in crossed] == [False, True, False]


def test_an_empty_mask_must_be_declared(spark):
    rows = spark.createDataFrame([(0, True, True), (0, False, True), (5, False, False)], "voxels int, declared_absent boolean, size_matches boolean")
    assert [r.errors for r in review.pair_errors(rows).collect()] == [[], ["undeclared_empty"], ["size"]]
    one = review.pair_counters(rows.limit(1)).first()
    assert (one.pairs, one.empty, one.undeclared_empty) == (1, 1, 0)


def test_only_finite_values_are_summarised(spark):
    rows = spark.createDataFrame([("m", "e1", 0.5), ("m", "e1", math.inf), ("m", "e2", math.nan), ("k", "e1", 1.0), ("k", "e2", 3.0), ("k", "e2", 8.0)], "g string, e string, dice double")
    got = {r.g: r for r in summaries.case_summary(rows, ["dice"], "e", ["g"], 60, "s", ["dice"]).collect()}
    m, k = got["m"], got["k"]
    assert (m.cases, m.entities, m.finite_cases, m.nonfinite_cases, m.mean, m.std, m.median) == (3, 2, 1, 2, 0.5, None, 0.5)
    assert (k.cases, k.mean, k.median, k.entity_mean) == (3, 4.0, 3.0, 3.25) and k.lo <= k.mean <= k.hi
    changes = spark.createDataFrame([("g", 0.1, 0.2), ("g", 0.3, 0.4), ("g", -0.1, 0.5), ("g", math.inf, 0.1), ("few", 1.0, 1.0)], "g string, a double, b double")
    both = {r.g: (r.pairs, r.rho, round(r.direction, 6)) for r in summaries.change_agreement(changes, "a", "b", ["g"]).collect()}
    assert both == {"g": (3, -0.5, 0.666667), "few": (1, None, 1.0)}


# Geometry (X11, X12, X13)


def test_a_corner_voxel_is_cropped_into_the_middle(spark):
    mask = spark.createDataFrame([(1, 0, 0, 0, 0)], CUBE)
    centre = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], "case_id int, tp int, cz double, cy double, cx double")
    assert [tuple(r) for r in voxel.crop(mask, centre, 5).select("z", "y", "x").collect()] == [(2, 2, 2)]


def test_the_centre_of_a_cube_and_its_contact_with_the_border(spark):
    mask = cube(spark, 2, 4)
    assert tuple(voxel.centroid(mask).select("cz", "cy", "cx").first()) == (2.5, 2.5, 2.5)
    assert not voxel.border_faces(mask, 8).first().touches
    assert voxel.border_faces(mask.unionByName(spark.createDataFrame([(1, 0, 0, 3, 3)], CUBE)), 8).first().faces == ["z_low"]


def test_a_missing_intensity_becomes_background(spark):
    rows = spark.createDataFrame([("a", i, math.nan if i == 0 else float(i)) for i in range(27)], "k string, p int, value double")
    got = {r.p: r.value for r in voxel.normalise(rows, "k").collect()}
    assert got[0] == -1.0 and all(-1 <= v <= 1 for v in got.values()) and got[26] == 1.0


# Streams


def test_a_stream_of_runs_goes_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(e), i, float(i // 2), float(rng.choice([0.0, 5.0])), [None, True, False][rng.integers(3)], bool(rng.random() < 0.2)) for i, e in enumerate(rng.integers(0, 12, 400))]
    where = [str(tmp_path / n) for n in ("in", "out", "progress")]
    panel = spark.createDataFrame(rows, runs.PANEL)
    for low, high in ((0, 70), (70, 71), (71, 1000)):
        panel.where((F.col("t") >= low) & (F.col("t") < high)).write.mode("append").parquet(where[0])
        got = runs.restartable_runs(spark, *where)
    want = sorted((r.entity_id, r.obs_id, r.run_id) for r in windows.restartable_runs(panel).collect())
    assert sorted((r.entity_id, r.obs_id, r.run_id) for r in got.where("status = 'new'").collect()) == want
    assert got.where("status = 'late'").count() == 0
    # The last row of entity 3 again, and a row from before it: one is dropped, the other comes out as late.
    last = panel.where("entity_id = 3").orderBy(F.desc("t"), F.desc("obs_id")).limit(1)
    last.unionByName(last.withColumn("t", F.lit(0.25))).write.mode("append").parquet(where[0])
    again = runs.restartable_runs(spark, *where)
    assert sorted((r.entity_id, r.obs_id, r.run_id) for r in again.where("status = 'new'").collect()) == want
    assert [(r.entity_id, r.t, r.run_id) for r in again.where("status = 'late'").collect()] == [(3, 0.25, None)]


class _Held:
    """A value state, and the handle that gives it out."""

    def __init__(self):
        self.value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_one_call_takes_the_runs_of_many_entities():
    rng = np.random.default_rng(3)
    n, state, got, want, last = 2400, _Held(), [], [], {}
    panel = pd.DataFrame({"entity_id": rng.integers(0, 90, n), "obs_id": rng.integers(0, 3, n), "t": rng.integers(0, 40, n).astype(float), "v": rng.choice([0.0, 5.0], n), "crossed": rng.random(n) < 0.3, "absent": rng.random(n) < 0.2})
    panel["v"] = panel["v"].where(panel["t"] % 7 > 0, -1.0)
    panel = panel.drop_duplicates(["entity_id", "t", "obs_id"])
    # Later batches bring some rows from before the last ones, and some of them again.
    for batch in (panel[panel["t"] < 15], panel[(panel["t"] >= 12) & (panel["t"] < 30)], panel[panel["t"] >= 29]):
        batch = pd.concat([batch, batch.iloc[::5]])
        processor = runs.Runs()
        processor.init(state)
        for out in processor.handleInputRows((7,), iter([batch.iloc[::2], batch.iloc[1::2]]), None):
            got += [(r.entity_id, r.obs_id, r.t, None if pd.isna(r.run_id) else int(r.run_id), r.status) for r in out.itertuples(index=False)]
        for r in batch.sort_values(["entity_id", "t", "obs_id"]).itertuples(index=False):
            place, run = last.get(r.entity_id, ((-math.inf, 0), 0))
            if (r.t, r.obs_id) < place:
                want.append((r.entity_id, r.obs_id, r.t, None, "late"))
            elif (r.t, r.obs_id) > place:
                usable = r.v > 0 and not r.absent
                last[r.entity_id] = ((r.t, r.obs_id), run + int(r.crossed or not usable))
                want += [(r.entity_id, r.obs_id, r.t, last[r.entity_id][1], "new")] if usable else []
    assert sorted(got, key=str) == sorted(want, key=str) and {r[4] for r in got} == {"new", "late"}


def test_streamed_parts_of_many_files_bring_no_late_rows(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.repartition(70).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = feature_queries.queries()["d14_stream_runs"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = panel_queries.queries()["d14_restartable_runs"](spark, str(tmp_path)).collect()
    assert len(got) > 0 and sorted(map(tuple, got)) == sorted(map(tuple, want))


# Sketches and tiles


def test_merged_sketches_stand_for_the_whole(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).alias("day"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"), (F.col("id") % 3000).alias("u"))
    shares = {"low": 0.1, "mid": 0.5, "high": 0.99}
    parts = sketches.merge_sketches(sketches.sketch_table(rows, ["g", "day"], "v", "u"), ["g"])
    merged = sketches.read_sketches(parts, ["g"], shares)
    whole = {r.g: r for r in sketches.read_sketches(sketches.sketch_table(rows, ["g"], "v", "u"), ["g"], shares).collect()}
    for r in merged.collect():
        assert r.n == 10_000 and r.distinct == whole[r.g].distinct and abs(r.distinct - 1500) < 45
    assert all(r.error < 0.01 for r in sketches.rank_errors(rows, merged, ["g"], "v", shares).collect())
    twice = sketches.merge_sketches(parts.unionByName(parts), ["g"])
    assert {r.n for r in sketches.read_sketches(twice, ["g"], shares).collect()} == {20_000}
    empty = sketches.sketch_table(rows.limit(0), ["g"], "v", "u")
    assert sketches.merge_sketches(empty, ["g"]).collect() == []


@pytest.mark.parametrize("block", [2, 3, 32])
def test_merging_the_tiles_of_a_field_gives_the_field(spark, block):
    rng = np.random.default_rng(9)
    field = rng.normal(size=(2, 7, 7, 7))
    rows = spark.createDataFrame([(c, int(z), int(y), int(x), float(field[c, z, y, x])) for c in range(2) for z, y, x in np.ndindex(7, 7, 7)], "k int, z int, y int, x int, value double")
    cut = tiles.cut_tiles_3d(rows, "k", 4, [0, 2, 3])
    assert cut.count() == 2 * 27
    got = {(r.k, r.z, r.y, r.x): r.value for r in tiles.merge_tiles_3d(cut, "k", 4, block).collect()}
    assert len(got) == 2 * 343
    assert all(abs(v - field[p]) < 1e-12 for p, v in got.items())


def test_a_voxel_takes_the_weighted_mean_of_its_tiles(spark):
    rows = spark.createDataFrame([("a", s, 0, 0, [float(s)] * 8) for s in (0, 1)], "k string, z0 int, y0 int, x0 int, values array<double>")
    w = tiles.axis_weight(2)
    got = {(r.z, r.y, r.x): r.value for r in tiles.merge_tiles_3d(rows, "k", 2).collect()}
    assert got[0, 0, 0] == 0.0 and got[2, 1, 1] == 1.0 and abs(got[1, 0, 1] - w[0] / (w[0] + w[1])) < 1e-12


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        spread.shared_folder(Session())


def test_spearman_inside_groups_and_areas_with_ties(spark):
    rows = spark.createDataFrame([("a", float(i), float(i * i % 7)) for i in range(20)] + [("b", 1.0, 2.0), ("b", 1.0, 3.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in scores.spearman(rows, "x", "y", ["g"]).collect()}
    rank = lambda v: np.array([np.mean([k + 1 for k, w in enumerate(sorted(v)) if w == u]) for u in v])
    assert abs(got["a"] - np.corrcoef(rank(range(20)), rank([i * i % 7 for i in range(20)]))[0, 1]) < 1e-12 and got["b"] is None
    assert estimates.interval(spark.createDataFrame([(float(i),) for i in range(60)], "e double"), "e").first().replicates == 60
