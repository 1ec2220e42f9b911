"""Fixtures and properties of the panel, score and voxel operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from panelloom.functions import spread
from panelloom.operators import checks, estimates, forecast, intake, review, scores, summaries, voxel
from panelloom.operators import windows as X
from panelloom.plans import cohort_queries, intake_queries, panel_queries, score_queries, table_queries, voxel_queries
from panelloom.streaming import incremental

PANEL = "entity_id string, obs_id long, t double, v double, cls string, crossed boolean, post boolean, absent boolean"


def panel(spark, crossed=(None, False, False, True), absent=(False,) * 4):
    return spark.createDataFrame([("A", i, 100.0 * i, 10.0 + i, "F", c, False, a) for i, (c, a) in enumerate(zip(crossed, absent))], PANEL)


def test_rolling_tuples_before_and_after_the_intervention_filter(spark):
    rows = X.exclusion_reasons(X.rolling_tuples(panel(spark)))
    assert rows.count() == 2
    assert rows.where(F.size("reasons") == 0).count() == 1


def test_absence_excludes_every_tuple_that_holds_it(spark):
    rows = X.exclusion_reasons(X.rolling_tuples(panel(spark, (None, False, False, False), (False, False, True, False))))
    assert rows.count() == 2
    assert rows.where(F.size("reasons") == 0).count() == 0


def test_equal_and_shifted_masks(spark):
    cube = [(0, 0, z, y, x) for z in range(3, 6) for y in range(3, 6) for x in range(3, 6)]
    a = spark.createDataFrame(cube, "case_id int, tp int, z int, y int, x int")
    same = voxel.overlap(a, a).first()
    assert same.dice == 1.0 and same.abs_rvd == 0.0
    assert voxel.hd95(a, a, (0.5, 0.5, 0.5)).first().hd95 == 0.0
    shifted = a.withColumn("z", F.col("z") + 1)
    assert 0 < voxel.hd95(a, shifted, (0.5, 0.5, 0.5)).first().hd95 <= 0.5


def test_signed_distance_is_negative_inside(spark):
    cube = [(0, 0, z, y, x) for z in range(3, 6) for y in range(3, 6) for x in range(3, 6)]
    s = voxel.signed_distance(spark.createDataFrame(cube, "case_id int, tp int, z int, y int, x int"), 9, (1.0, 1.0, 1.0), 5.0)
    value = {(r.z, r.y, r.x): r.sdf for r in s.collect()}
    assert value[4, 4, 4] < 0 < value[0, 0, 0]
    assert len(value) == 729


def test_folds_are_balanced_and_extend(spark):
    ids = spark.range(103).select(F.col("id").alias("entity_id"))
    folds = scores.balanced_folds(ids, 5, "100")
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1
    more = scores.extend_folds(folds, spark.range(150).select(F.col("id").alias("entity_id")), 5, "100")
    sizes = [r["count"] for r in more.groupBy("fold").count().collect()]
    assert sum(sizes) == 150 and max(sizes) - min(sizes) <= 1


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("module", [panel_queries, score_queries, voxel_queries, cohort_queries, table_queries, intake_queries])
def test_queries_have_the_rows_of_their_sql(spark, module):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split():
        connection.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    sql = module.oracle_sql()
    for name, query in module.queries().items():
        if name in sql:
            result = connection.execute(sql[name])
            columns = [c[0] for c in result.description]
            found = query(spark, folder)
            assert sorted(found.columns) == sorted(columns), name
            expected = sorted(repr([_plain(v) for v in row]) for row in result.fetchall())
            assert sorted(repr([_plain(v) for v in row]) for row in found.select(*[f"`{c}`" for c in columns]).collect()) == expected, name


def test_natural_key_sorts_digit_runs_as_numbers(spark):
    rows = spark.createDataFrame([("v10",), ("v9",), ("a",), ("",), (None,)], "s string")
    assert [r.s for r in rows.orderBy(review.natural_key(F.col("s")).asc_nulls_last()).collect()] == ["", "a", "v9", "v10", None]


def test_freeze_rejects_unknown_entities_and_repeated_cases(spark):
    folds = spark.createDataFrame([("A", 0), ("B", 1)], "entity_id string, fold int")
    cases = spark.createDataFrame([(1, "A", True), (2, "B", True), (3, "C", False)], "case_id int, entity_id string, passed boolean")
    frozen = review.freeze(cases, folds, F.col("passed"), "case_id", 5)
    assert sorted((r.case_id, r.fold) for r in frozen.collect()) == [(1, 0), (2, 1)]
    for bad in (cases.withColumn("passed", F.lit(True)), cases.unionByName(cases)):
        with pytest.raises(Exception, match="fault"):
            review.freeze(bad, folds, F.col("passed"), "case_id", 5).collect()
    with pytest.raises(ValueError, match="missing"):
        review.freeze(cases.drop("entity_id"), folds, F.lit(True), "case_id", 5)


def test_required_flags_and_gates(spark):
    with pytest.raises(Exception, match="flag"):
        spark.range(1).select(review.required_flag(F.lit(""))).collect()
    row = spark.range(1).select(review.case_gate(F.array(F.lit(0.9), F.lit(0.0), F.lit(0.9)), F.array(F.lit(False)), 0.5).alias("good"), review.case_gate(F.array(F.lit(0.1), F.lit(1.0)), F.array(F.lit(True)), 0.5).alias("bad"), review.least_overlap(F.lit("no list")).alias("least")).first()
    assert row.good == [] and row.bad == ["overlap", "border"] and row.least == float("inf")


def test_padding_never_crops(spark):
    sizes = [(r.s, r.p) for r in spark.createDataFrame([(1,), (8,), (9,), (17,)], "s int").select("s", estimates.padded_size(F.col("s"), 4, 8).alias("p")).collect()]
    assert sizes == [(1, 8), (8, 8), (9, 16), (17, 24)]


def test_merged_tiles_of_one_field_give_the_field_back(spark):
    tiles = spark.range(24).select(F.explode(F.array(F.lit(0), F.lit(8))).alias("start"), F.col("id").alias("place")).withColumn("offset", F.col("place") - F.col("start")).where("offset between 0 and 15").select(F.lit(1).alias("k"), "start", "offset", (F.col("place") * 2.0).alias("value"))
    merged = estimates.merge_tiles(tiles, "k", 16).collect()
    assert len(merged) == 24 and all(abs(r.value - 2 * r.place) < 1e-9 for r in merged)


def test_calibration_of_true_probabilities_is_the_identity(spark):
    cases = spark.createDataFrame([(p / 10, int(i < p)) for p in range(1, 10) for i in range(10)], "p double, y int")
    line = estimates.calibration_line(cases).first()
    assert abs(line.slope - 1) < 1e-3 and abs(line.intercept) < 1e-3


def test_a_second_run_processes_only_new_files(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    run = lambda: sorted(r.id for r in incremental.process_new(spark, source, "id long", lambda d: d.where("id % 2 = 0"), target, progress).collect())
    spark.range(4).write.parquet(source)
    assert run() == [0, 2] and run() == [0, 2]
    spark.range(4, 7).write.mode("append").parquet(source)
    assert run() == [0, 2, 4, 6]


def test_largest_component_follows_long_paths_and_long_axes(spark):
    snake = [(0, y, x) for y in range(0, 20, 2) for x in range(12)] + [(0, y, 11 if y % 4 == 1 else 0) for y in range(1, 19, 2)]
    blob = [(9, y, x) for y in range(10) for x in range(10)]
    far = [(0, 0, 1000), (0, 0, 1001), (0, 1, 0)]
    rows = [(1, 0, *v) for v in snake + blob] + [(2, 0, *v) for v in far]
    got = {tuple(r) for r in voxel.largest_component(spark.createDataFrame(rows, "case_id long, tp int, z int, y int, x int")).collect()}
    assert got == {(1, 0, *v) for v in snake} | {(2, 0, 0, 0, 1000), (2, 0, 0, 0, 1001)}


def test_inner_folds_keep_entities_together(spark):
    rows = spark.createDataFrame([(e, o, e % 5) for e in range(200) for o in range(6)], "entity_id long, obs_id long, fold int")
    per = score_queries._by_entity(rows).groupBy("entity_id").agg(F.countDistinct("inner").alias("n"), F.min("inner").alias("inner")).collect()
    assert {r.n for r in per} == {1} and {r.inner for r in per} == set(range(5))


def test_quantiles_and_running_totals_beyond_the_small_size(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), rng.exponential(size=2000) * 1e6])
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.01, 0.2, 0.5, 0.75, 0.999, 1.0]
    monkeypatch.setattr(spread, "SMALL", 50)
    assert np.allclose(spread.quantiles(table, "v", shares), np.quantile(values, shares))
    per = table.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = spread.running_totals(per, "v", {"upto": F.col("n")}).orderBy("v").collect()
    order = np.sort(values)
    assert [r.upto for r in got] == [int(np.searchsorted(order, r.v, side="right")) for r in got]
    assert all(x != x for x in spread.quantiles(table.where("false"), "v", [0.5]))


def test_manifest_files_are_checked(spark, tmp_path):
    head = "patient_id,timepoint_id,study_days,image_path,mask_path,intervened_since_previous,no_residual_vs\n"
    good = head + "A,t0,0,i,m,,\nA,t1,100,i,m,false,no\nA,t2,200,i,m,0,N\nA,t3,300,i,m,yes,\n"
    (tmp_path / "good.csv").write_text(good)
    rows = intake.load_manifest(spark, str(tmp_path / "good.csv")).orderBy("study_days").collect()
    assert [r.intervened_since_previous for r in rows] == [None, False, False, True] and [r.no_residual_vs for r in rows] == [None, False, False, None]
    for name, text, fault in (("empty", head, "no rows"), ("late", good + "A,t4,300,i,m,,\n", "A/t4: not_increasing"), ("twice", good + "A,t0,400,i,m,,\n", "A/t0: repeated"), ("null", good + "B,t0,,i,m,,\n", "B/t0: missing")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError, match=fault):
            intake.load_manifest(spark, str(tmp_path / f"{name}.csv"))
    (tmp_path / "flag.csv").write_text(good + "B,t0,1,i,m,maybe,\n")
    with pytest.raises(Exception, match="not a flag"):
        intake.load_manifest(spark, str(tmp_path / "flag.csv")).collect()


def test_checked_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 5), (3, 6)], "k int, y int")
    assert [tuple(r) for r in intake.one_to_one(left, right, ["k"]).collect()] == [(1, "a", 5)]
    with pytest.raises(Exception, match="repeats on the right: 1"):
        intake.one_to_one(left, right.unionByName(right), ["k"]).collect()
    assert sorted((r.k or 0, r.n) for r in intake.unmatched(left, right, "k").collect()) == [(0, 1), (2, 1)]
    with pytest.raises(Exception, match="without a match: .*2"):
        intake.many_to_one(left, right, "k").collect()
    assert intake.many_to_one(left, right, "k", how="inner").count() == 1
    with pytest.raises(Exception, match="k repeats: 1"):
        intake.many_to_one(left, right.unionByName(right), "k", how="inner").collect()
    merged = intake.mapped_merge(left, right.withColumnRenamed("y", "value"), {"k": "k"}, {"x": "value", "new": "value"})
    assert sorted((r.k or 0, r.x, r.new, r.matched) for r in merged.collect()) == [(0, "c", None, False), (1, "5", 5, True), (2, "b", None, False)]
    with pytest.raises(ValueError, match="missing"):
        intake.mapped_merge(left, right, {"k": "id"}, {})


def test_logistic_fits_are_stationary_and_costs_are_the_best(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 300
    x, fold, inner = rng.normal(size=(n, 2)), rng.integers(0, 3, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5)))).astype(int)
    rows = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), int(y[i]), int(fold[i]), int(inner[i])) for i in range(n)], "id int, a double, b double, y int, fold int, inner int")
    costs = [0.01, 1.0]
    got = {r.id: (r.p, r.cost) for r in forecast.logistic_with_inner_cv(rows, ["a", "b"], "y", costs).collect()}

    def fit(train, cost, mean, sd):
        z = np.column_stack([np.ones(train.sum()), (x[train] - mean) / sd])
        beta, ridge = np.zeros(3), np.diag([0, 1 / cost, 1 / cost])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y[train] - p) - ridge @ beta)
        return lambda rows: 1 / (1 + np.exp(-(np.column_stack([np.ones(rows.sum()), (x[rows] - mean) / sd]) @ beta)))

    for f in range(3):
        train = fold != f
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0) + 1e-9
        loss = []
        for cost in costs:
            each = []
            for i in range(2):
                held = train & (inner == i)
                p = fit(train & (inner != i), cost, mean, sd)(held)
                each.append(-np.mean(np.where(y[held] == 1, np.log(p), np.log(1 - p))))
            loss.append(np.mean(each))
        best = costs[int(np.argmin(np.round(loss, 9)))]
        expected = fit(train, best, mean, sd)(fold == f)
        assert np.allclose([got[i][0] for i in np.flatnonzero(fold == f)], expected, atol=1e-6) and {got[i][1] for i in np.flatnonzero(fold == f)} == {best}


def test_ridge_inner_cv_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    n = 120
    x, fold, inner = rng.normal(size=(n, 2)), rng.integers(0, 3, n), rng.integers(0, 3, n)
    y = x[:, 0] * 0.3 + rng.normal(size=n)
    rows = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), float(y[i]), int(fold[i]), int(inner[i])) for i in range(n)], "id int, a double, b double, y double, fold int, inner int")
    got = {r.id: r for r in forecast.ridge_with_inner_cv(rows, ["a", "b"], "y", [0.1, 10.0, 1000.0]).collect()}

    def fit(train, penalty, test):
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0) + 1e-9
        z = (x[train] - mean) / sd
        beta = np.linalg.solve(z.T @ z + penalty * np.eye(2), z.T @ (y[train] - y[train].mean()))
        return y[train].mean() + (x[test] - mean) / sd @ beta

    for f in range(3):
        train = fold != f
        score = [np.mean([np.abs(fit(train & (inner != i), p, train & (inner == i)) - y[train & (inner == i)]).mean() for i in range(3)]) for p in (0.1, 10.0, 1000.0)]
        best = (0.1, 10.0, 1000.0)[int(np.argmin(score))]
        own = np.flatnonzero(fold == f)
        assert {got[i].penalty for i in own} == {best} and np.allclose([got[i].pred for i in own], fit(train, best, fold == f), atol=1e-8)


def test_bootstrap_takes_any_estimator(spark):
    rows = spark.createDataFrame([(e, float(e % 7 + i)) for e in range(60) for i in range(3)], "entity_id int, v double")
    mean = lambda drawn, by: drawn.groupBy(by).agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("estimate"))
    a = summaries.bootstrap(rows, "entity_id", 80, "s", estimator=mean).first()
    b = summaries.bootstrap(rows, "entity_id", 80, "s", function=lambda frame: frame["v"].mean()).first()
    assert a.replicates == b.replicates == 80 and abs(a.lo - b.lo) < 1e-9 and abs(a.hi - b.hi) < 1e-9 and a.lo < 4 < a.hi
    few = summaries.bootstrap(rows, "entity_id", 40, "s", estimator=mean).first()
    assert few.lo is None and few.replicates == 40


def test_table_digest_tells_rows_apart_whatever_their_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, x string")
    digest = lambda df: tuple(checks.table_digest(df).first())
    assert digest(rows) == digest(rows.orderBy(F.desc("k")).select("x", "k")) and len(digest(rows)[1]) == 64
    assert len({digest(d) for d in (rows, rows.distinct(), rows.where("false"), rows.withColumn("x", F.lit("a")))}) == 4


def test_filled_holes_and_cubes_with_a_tunnel(spark):
    box = [(z, y, x) for z in range(1, 6) for y in range(1, 6) for x in range(1, 6)]
    shell = [v for v in box if not all(1 < c < 5 for c in v)]
    tunnel = [v for v in shell if v != (1, 3, 3)]
    rows = [(case, *v, 1.0) for case, mask in ((1, shell), (2, tunnel)) for v in mask] + [(1, 3, 3, 3, 0.0), (3, 0, 0, 0, None)]
    got = voxel.filled_foreground(spark.createDataFrame(rows, "case_id int, z int, y int, x int, value double"), 7).groupBy("case_id").count().collect()
    assert {r.case_id: r["count"] for r in got} == {1: 125, 2: len(tunnel)}
