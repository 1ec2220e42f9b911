"""Fitted models against direct computations in numpy or direct fits."""

import math

import numpy as np
import pytest
from panelloom.operators import boosting, forecast
from pyspark.sql import functions as F


def _efron(beta, time, event, z, penalty):
    """The penalised log likelihood, event by event."""
    out = -penalty * len(time) / 2 * float(beta @ beta)
    risk = np.exp(z @ beta)
    for t in np.unique(time[event == 1]):
        dying = (time == t) & (event == 1)
        d = int(dying.sum())
        out += float((z[dying] @ beta).sum())
        for place in range(d):
            out -= math.log(risk[time >= t].sum() - place / d * risk[dying].sum())
    return out


def test_cox_is_the_maximum_of_the_likelihood_with_ties(spark):
    rng = np.random.default_rng(5)
    n = 120
    x = rng.normal(size=(n, 2)) * [1.0, 4.0] + [0.0, 9.0]
    days = 1 + rng.integers(0, 25, size=n)
    event = (rng.random(n) < 0.7).astype(int)
    days = np.where(x[:, 0] > 0.5, np.maximum(1, days // 3), days)
    rows = spark.createDataFrame([(float(d) / 365.25, int(e), float(a), float(b)) for d, e, (a, b) in zip(days, event, x)], "time_yr double, event int, a double, b double")
    found = forecast.cox(rows, ["a", "b"], penalty=0.05)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    beta = np.array([r[1] for r in found])
    value = lambda b: _efron(b, days, event, z, 0.05)
    step = 1e-4
    unit = np.eye(2) * step
    slope = [(value(beta + u) - value(beta - u)) / (2 * step) for u in unit]
    assert np.abs(slope).max() < 1e-5
    bend = np.array([[(value(beta + u + v) - value(beta + u - v) - value(beta - u + v) + value(beta - u - v)) / (4 * step**2) for v in unit] for u in unit])
    error = np.sqrt(np.diag(np.linalg.inv(-bend)))
    for (name, b, e, ratio, p), want in zip(found, error):
        assert abs(e - want) < 1e-4 * want, name
        assert ratio == math.exp(b) and abs(p - math.erfc(abs(b) / e / math.sqrt(2))) < 1e-12
    assert beta[0] > 0


def test_cox_of_one_tie_of_all_rows(spark):
    rows = spark.createDataFrame([(1.0, 1, float(i % 3)) for i in range(30)], "time_yr double, event int, a double")
    ((_, b, e, ratio, p),) = forecast.cox(rows, ["a"])
    assert abs(b) < 1e-9 and e > 0 and abs(ratio - 1) < 1e-9 and abs(p - 1) < 1e-6


@pytest.mark.parametrize("p", [1, 2, 3, 4])
def test_cox_of_distinct_real_times(spark, p):
    """One to four covariates: the score of the likelihood is zero at the result."""
    rng = np.random.default_rng(p)
    n = 90
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1)
    time = rng.exponential(size=n)
    event = (rng.random(n) < 0.6).astype(int)
    names = [f"c{i}" for i in range(p)]
    table = [(float(t), int(e), *map(float, r)) for t, e, r in zip(time, event, x)] + [(None, 1, *[0.5] * p)]
    rows = spark.createDataFrame(table, "time_yr double, event int, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    beta = np.array([r[1] for r in forecast.cox(rows, names)])
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    for u in np.eye(p) * 1e-4:
        slope = (_efron(beta + u, time, event, z, 0.05) - _efron(beta - u, time, event, z, 0.05)) / 2e-4
        assert abs(slope) < 1e-5


def _dense_restricted(points, s2, d):
    """-2 x the restricted log likelihood of an intercept and slope per entity, from whole covariance matrices."""
    value, information, right = 0.0, np.zeros((2, 2)), np.zeros(2)
    blocks = []
    for e in sorted({r[0] for r in points}):
        x = np.array([[1.0, r[1]] for r in points if r[0] == e])
        y = np.array([r[2] for r in points if r[0] == e])
        v = s2 * np.eye(len(x)) + x @ d @ x.T
        w = np.linalg.inv(v)
        value += np.linalg.slogdet(v)[1]
        information += x.T @ w @ x
        right += x.T @ w @ y
        blocks.append((x, y, w))
    beta = np.linalg.solve(information, right)
    value += sum((y - x @ beta) @ w @ (y - x @ beta) for x, y, w in blocks)
    return value + np.linalg.slogdet(information)[1], beta


def _growing(entities, seed, d):
    rng = np.random.default_rng(seed)
    factor = np.linalg.cholesky(np.array(d) + 1e-12 * np.eye(2))
    out = []
    for e in range(entities):
        u = factor @ rng.normal(size=2)
        for x in np.sort(rng.random(rng.integers(1, 7)) * 4):
            out.append((e, float(x), float(1.5 + u[0] + (0.3 + u[1]) * x + rng.normal() * 0.4)))
    return out


def test_mixed_model_is_the_minimum_of_the_restricted_likelihood(spark):
    points = _growing(200, 8, [[0.8, -0.1], [-0.1, 0.2]])
    par, sums = forecast.mixed_model(spark.createDataFrame(points, "entity_id int, x double, y double"))
    assert par["converged"] and sums.count() == 200
    at = np.array([par["s2"], par["d11"], par["d12"], par["d22"]])
    of = lambda v: _dense_restricted(points, v[0], np.array([[v[1], v[2]], [v[2], v[3]]]))
    value, beta = of(at)
    assert np.allclose(beta, [par["a"], par["b"]], rtol=1e-6)
    for k in range(4):
        for sign in (1, -1):
            moved = at.copy()
            moved[k] += sign * 1e-3
            assert of(moved)[0] > value - 1e-6
    slope = [(of(at + 1e-5 * u)[0] - of(at - 1e-5 * u)[0]) / 2e-5 for u in np.eye(4)]
    assert np.abs(slope).max() < 5e-3


def test_mixed_model_without_slopes_stays_definite(spark):
    points = _growing(60, 2, [[0.5, 0.0], [0.0, 0.0]])
    par, _ = forecast.mixed_model(spark.createDataFrame(points, "entity_id int, x double, y double"))
    assert par["d11"] * par["d22"] - par["d12"] ** 2 >= -1e-12 and par["d22"] < 0.05 and math.isfinite(par["criterion"])
    with pytest.raises(ValueError):
        forecast.mixed_model(spark.createDataFrame(points[:2], "entity_id int, x double, y double"))


def _plain_tree(x, gradient, rest, depth, least, rate, edges):
    """Nested tuples by trying every feature and every threshold between neighbouring values of the training rows."""
    best = (1e-12, None)
    base = gradient.sum() ** 2 / len(x) if len(x) else 0.0
    for f in range(x.shape[1] if depth else 0):
        for edge in edges[f]:
            left = x[:, f] <= edge
            if left.sum() >= least and (~left).sum() >= least:
                gain = gradient[left].sum() ** 2 / left.sum() + gradient[~left].sum() ** 2 / (~left).sum() - base
                if gain > best[0] + 1e-9:
                    best = (gain, (f, edge, left))
    if best[1] is None:
        return rate * float(np.median(rest))
    f, edge, left = best[1]
    return f, edge, _plain_tree(x[left], gradient[left], rest[left], depth - 1, least, rate, edges), _plain_tree(x[~left], gradient[~left], rest[~left], depth - 1, least, rate, edges)


def _plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _plain_boosting(x, y, depth, rate, trees, least):
    start = float(np.median(y))
    now, grown = np.full(len(y), start), []
    known = [np.unique(c) for c in x.T]
    edges = [(k[1:] + k[:-1]) / 2 for k in known]
    for _ in range(trees):
        tree = _plain_tree(x, np.sign(y - now), y - now, depth, least, rate, edges)
        now = now + np.array([_plain_value(tree, r) for r in x])
        grown.append(tree)
    return lambda r: start + sum(_plain_value(t, r) for t in grown)


def _steps(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 2)), 1)
    return x, np.sign(x[:, 0]) * 2 + (x[:, 1] > 0.5) * x[:, 0] + rng.normal(size=n) / 5


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_boosting_equals_a_plain_version(depth):
    x, y = _steps(120, depth)
    model = boosting.fit(x, y, depth, 0.3, 6, least=8)
    plain = _plain_boosting(x, y, depth, 0.3, 6, 8)
    assert np.allclose(boosting.predict(model, x), [plain(r) for r in x], atol=1e-12)


def test_boosting_takes_the_setting_of_the_inner_folds(spark):
    x, y = _steps(120, 5)
    table = [(i, i % 3, i // 3 % 2, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))] + [(500, 0, 0, None, 1.0, 1.0)]
    rows = spark.createDataFrame(table, "id int, fold int, inner int, a double, b double, y double")
    grid = ({"depth": 1, "rate": 0.3, "trees": 4}, {"depth": 2, "rate": 0.3, "trees": 8})
    got = {r.id: r for r in boosting.boosted_out_of_fold(rows, ["a", "b"], "y", "id", grid, least=5).collect()}
    assert len(got) == 121 and got[500].pred is None
    fold, inner = np.arange(120) % 3, np.arange(120) // 3 % 2
    for o in range(3):
        errors = []
        for s in grid:
            each = []
            for i in range(2):
                use, held = (fold != o) & (inner != i), (fold != o) & (inner == i)
                plain = _plain_boosting(x[use], y[use], s["depth"], s["rate"], s["trees"], 5)
                each.append(np.mean([abs(plain(r) - v) for r, v in zip(x[held], y[held])]))
            errors.append(np.mean(each))
        best = grid[int(np.argmin(errors))]
        plain = _plain_boosting(x[fold != o], y[fold != o], best["depth"], best["rate"], best["trees"], 5)
        for k in np.flatnonzero(fold == o):
            assert (got[k].depth, got[k].trees) == (best["depth"], best["trees"]) and abs(got[k].pred - plain(x[k])) < 1e-9


def test_boosting_bins_many_values_by_quantiles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 1))
    (edges,) = boosting.bin_edges(x, 255)
    counts = np.bincount(boosting.binned(x, [edges])[:, 0])
    assert len(counts) <= 255 and counts.max() < 3 * 5000 / 255


def test_boosting_fits_all_rows_of_a_large_table(spark):
    rows = spark.range(440_000).selectExpr("id", "cast(id % 2 as int) as fold", "cast(id div 2 % 2 as int) as inner", "cast(hash(id, 1) % 300 as double) as a", "hash(id, 2) / 2147483648 + sin(hash(id, 1) % 300 / 40) as y")
    grid = ({"depth": 2, "rate": 0.5, "trees": 2},)
    got = boosting.boosted_out_of_fold(rows, ["a"], "y", "id", grid).toPandas()
    x, y, fold = got[["a"]].to_numpy(), got["y"].to_numpy(), got["fold"].to_numpy()
    for o in range(2):
        # 220000 training rows: 20000 were left out before.
        model = boosting.fit(x[fold != o], y[fold != o], **grid[0])
        assert np.array_equal(boosting.predict(model, x[fold == o]), got["pred"].to_numpy()[fold == o])


@pytest.mark.parametrize("bins", [7, 40])
def test_edges_of_all_fits_equal_those_of_their_rows(spark, bins):
    rng = np.random.default_rng(4)
    f, i = rng.integers(0, 3, 700), rng.integers(0, 2, 700)
    x = np.stack([rng.normal(size=700), rng.integers(0, 30, 700) / 4, rng.integers(0, 2, 700)], axis=1)
    rows = spark.createDataFrame([(int(a), int(b), *map(float, v)) for a, b, v in zip(f, i, x)], "f int, i int, x0 double, x1 double, x2 double")
    fits = [(o, g) for o in range(3) for g in (0, 1, None)]
    for (o, g), edges in zip(fits, boosting.exact_edges(rows, ["x0", "x1", "x2"], fits, bins)):
        expected = boosting.bin_edges(x[(f != o) & ((i != g) if g is not None else True)], bins)
        assert [e.tolist() for e in edges] == [e.tolist() for e in expected]


@pytest.mark.parametrize("digits", [0, 1, 9])
@pytest.mark.parametrize("n", [20_000, 20_001])
def test_middle_values_of_many_cells(monkeypatch, n, digits):
    monkeypatch.setattr(boosting, "AT_ONCE", 50)
    rng = np.random.default_rng(n)
    starts = np.unique(np.concatenate([[0, n], rng.integers(0, n, 40)]))
    y = np.round(rng.normal(size=n), digits)
    for a, b in zip(starts[:-1], starts[1:]):
        y[a:b].sort()
    now = np.round(rng.normal(size=len(starts) - 1), 1)
    rest = np.sort(y - np.repeat(now, np.diff(starts)))
    assert boosting._middle(y, starts[:-1], starts[1:], now) == (rest[(n - 1) // 2], rest[n // 2])


def test_boosting_by_bisection_equals_all_residuals_at_once(monkeypatch):
    x, y = _steps(3000, 9)
    y = np.round(y, 1)
    model = boosting.fit(x, y, 3, 0.1, 12)
    monkeypatch.setattr(boosting, "AT_ONCE", 100)
    assert boosting.fit(x, y, 3, 0.1, 12) == model


def test_targets_are_sorted_inside_cells():
    rng = np.random.default_rng(2)
    y, starts = rng.normal(size=500), np.array([0, 3, 4, 200, 260, 500])
    for some in (1, 60, 1000):
        got = y.copy()
        boosting.sort_cells(got, starts, some)
        assert all(np.array_equal(got[a:b], np.sort(y[a:b])) for a, b in zip(starts[:-1], starts[1:]))


def test_boosting_of_more_features_than_a_long_has_codes(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(200, 9)), 1)
    y = x[:, 8] + x[:, 0] / 3
    names = [f"v{k}" for k in range(9)]
    rows = spark.createDataFrame([(k, k % 2, k // 2 % 2, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y))], ["id", "fold", "inner", *names, "y"])
    grid = ({"depth": 2, "rate": 0.5, "trees": 5},)
    got = boosting.boosted_out_of_fold(rows, names, "y", "id", grid, least=5).toPandas().sort_values("id")
    for o in range(2):
        own = np.arange(200) % 2 == o
        assert np.array_equal(boosting.predict(boosting.fit(x[~own], y[~own], **grid[0], least=5), x[own]), got["pred"].to_numpy()[own])


def test_a_table_of_bins_holds_the_values_of_the_trees(monkeypatch):
    x, y = _steps(3000, 8)
    model = boosting.fit(x, y, 3, 0.1, 20)
    table = boosting.tabulated(model)
    assert table.shape == tuple(len(e) + 1 for e in model["edges"])
    assert (boosting.predict(model, x, table) == boosting.predict(model, x)).all()
    monkeypatch.setattr(boosting, "CELLS", table.size - 1)
    assert boosting.tabulated(model) is None


def test_models_without_features_are_fitted_once(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i % 7)) for i in range(30)], "id int, fold int, y double")
    fitted = []

    def middle(r):
        fitted.append("median")
        return forecast.median_out_of_fold(r, "y")

    ahead = lambda r, features: r.withColumn("pred", F.lit(float(len(features))))
    got = {(r.features, r.model): (r.n, r.mae) for r in forecast.model_grid(rows, "y", {"a": ["id"], "b": ["id", "fold"]}, {"ahead": ahead}, {"median": middle}).collect()}
    assert fitted == ["median"] and set(got) == {(s, m) for s in "ab" for m in ("ahead", "median")}
    assert got["a", "median"] == got["b", "median"] and got["a", "ahead"] != got["b", "ahead"]
