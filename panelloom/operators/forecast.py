"""Forecast baselines and fold-aware models.

Leave-one-fold-out fits of additive statistics are total minus fold; order statistics fan rows out to the folds that
train on them. Fits by iteration aggregate to a few numbers a step.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trajectory_forecasts(tuples: DataFrame) -> DataFrame:
    """Long form (method, pred, v2, v3, ...): persistence, linear (clipped at 0) and log-linear extrapolation."""
    linear = F.greatest(F.col("v2") + (F.col("v2") - F.col("v1")) / F.col("dt1") * F.col("dt2"), F.lit(0.0))
    exponent = F.least(F.log(F.col("v2") / F.col("v1")) / F.col("dt1") * F.col("dt2"), F.lit(50.0))
    log_linear = F.least(F.col("v2") * F.exp(exponent), F.lit(1e12))
    methods = {"persistence": F.col("v2"), "linear": linear, "log_linear": log_linear}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), p.alias("pred")) for m, p in methods.items()]))
    return tuples.withColumn("__m", each).select("*", "__m.method", "__m.pred").drop("__m")


def error_columns(cases: DataFrame, pred: str = "pred", target: str = "v3", previous: str = "v2", floor: float = 1.0) -> DataFrame:
    """Adds absolute and signed errors, the absolute log ratio (prediction floored) and the relative changes."""
    p, y, b = F.col(pred), F.col(target), F.col(previous)
    return cases.withColumns(
        {
            "abs_error": F.abs(p - y),
            "signed_rvd": (p - y) / y,
            "abs_rvd": F.abs(p - y) / y,
            "abs_log_ratio": F.abs(F.log(F.greatest(p, F.lit(floor)) / y)),
            "target_change": (y - b) / b,
            "predicted_change": (p - b) / b,
        }
    )


def held_out_mean(rows: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    """(fold, train_mean): the mean of `value` over all other folds."""
    per = rows.groupBy(fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = per.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return per.crossJoin(F.broadcast(total)).select(fold, ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("train_mean"))


def held_out_median(rows: DataFrame, value: str, folds: int, fold: str = "fold") -> DataFrame:
    """(fold, train_median): each row goes to the folds that train on it."""
    roles = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold).cast("int")))
    from panelloom.functions.groups import group_quantiles

    return group_quantiles(rows.select(roles.alias("test_fold"), value), ["test_fold"], value, [0.5]).select("test_fold", F.get("q", 0).alias("train_median"))


def median_out_of_fold(rows: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """Adds pred: the median of the target over the other folds."""
    folds = 1 + (rows.agg(F.max(fold)).first()[0] or 0)
    medians = held_out_median(rows, target, folds, fold).select(F.col("test_fold").cast("int").alias("__f"), F.col("train_median").alias("pred"))
    return rows.join(F.broadcast(medians), F.col(fold).cast("int") == F.col("__f"), "left").drop("__f")


def shrunk_trend(rows: DataFrame, alphas: list[float], folds: int) -> DataFrame:
    """(test_fold, alpha): the factor of rate x horizon with the least mean (over inner folds) absolute error; ties go low.

    rows: fold, inner, x, y. One pass over (row, test fold, alpha) combinations, aggregated at once.
    """
    grid = F.explode(F.array(*[F.lit(a) for a in alphas]))
    roles = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold").cast("int")))
    scored = rows.select(roles.alias("test_fold"), "inner", "x", "y").withColumn("alpha", grid)
    inner = scored.groupBy("test_fold", "alpha", "inner").agg(F.avg(F.abs(F.col("y") - F.col("alpha") * F.col("x"))).alias("mae"))
    mean = inner.groupBy("test_fold", "alpha").agg(F.round(F.avg("mae"), 9).alias("score"))
    return mean.groupBy("test_fold").agg(F.min(F.struct("score", "alpha")).alias("best")).select("test_fold", "best.alpha", "best.score")


def gram_sums(rows: DataFrame, features: list[str], target: str, fold: str = "fold") -> dict[int, np.ndarray]:
    """Per fold the sums of products of (1, features, target): a (p + 2) square matrix; one aggregation."""
    names = ["__one", *features, target]
    wide = rows.withColumn("__one", F.lit(1.0))
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    out = {}
    for r in wide.groupBy(fold).agg(*sums).collect():
        g = np.zeros((len(names), len(names)))
        for i in range(len(names)):
            for j in range(i, len(names)):
                g[i, j] = g[j, i] = r[f"{i}_{j}"] or 0.0
        out[int(r[fold])] = g
    return out


def ridge_from_gram(gram: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and slopes of a ridge fit with standardised features (ddof 0) and a free intercept."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0)) + 1e-9
    a = cov[:-1, :-1] / np.outer(scale, scale) * n + penalty * np.eye(len(scale))
    beta = np.linalg.solve(a, cov[:-1, -1] / scale * n) / scale
    return np.concatenate([[mean[-1] - beta @ mean[:-1]], beta])


def ridge_out_of_fold(rows: DataFrame, features: list[str], target: str, penalty: float, fold: str = "fold") -> DataFrame:
    """Adds pred: each fold predicted by the ridge fit of the others (grams by subtraction)."""
    grams = gram_sums(rows, features, target, fold)
    total = sum(grams.values())
    fits = [(f, [float(x) for x in ridge_from_gram(total - g, penalty)]) for f, g in grams.items() if (total - g)[0, 0] > 0]
    table = rows.sparkSession.createDataFrame(fits, f"{fold} int, __beta array<double>")
    pred = F.get("__beta", 0)
    for i, c in enumerate(features):
        pred = pred + F.get("__beta", i + 1) * F.col(c)
    return rows.withColumn(fold, F.col(fold).cast("int")).join(F.broadcast(table), fold).withColumn("pred", pred).drop("__beta")


def ridge_with_inner_cv(rows: DataFrame, features: list[str], target: str, penalties: list[float], fold: str = "fold", inner: str = "inner") -> DataFrame:
    """Adds pred; each outer fold's penalty is the one with the least mean inner-fold absolute error."""
    keyed = rows.withColumn("__both", (F.col(fold) * 1000 + F.col(inner)).cast("int"))
    grams = gram_sums(keyed, features, target, "__both")
    outer = sorted({k // 1000 for k in grams})
    fits = []
    for o in outer:
        mine = {k: g for k, g in grams.items() if k // 1000 != o}
        for i in sorted({k % 1000 for k in mine}):
            train = sum(g for k, g in mine.items() if k % 1000 != i)
            fits += [(o, i, p, [float(x) for x in ridge_from_gram(train, p)]) for p in penalties]
    table = rows.sparkSession.createDataFrame(fits, f"__test int, {inner} int, penalty double, __beta array<double>")
    pred = F.get("__beta", 0)
    for i, c in enumerate(features):
        pred = pred + F.get("__beta", i + 1) * F.col(c)
    scored = rows.withColumn(inner, F.col(inner).cast("int")).join(F.broadcast(table), inner).where(F.col("__test") != F.col(fold)).withColumn("e", F.abs(pred - F.col(target)))
    per = scored.groupBy("__test", "penalty", inner).agg(F.avg("e").alias("mae")).groupBy("__test", "penalty").agg(F.avg("mae").alias("score"))
    best = {r["__test"]: r.b.penalty for r in per.groupBy("__test").agg(F.min(F.struct("score", "penalty")).alias("b")).collect()}
    total = sum(grams.values())
    final = [(o, best[o], [float(x) for x in ridge_from_gram(total - sum(g for k, g in grams.items() if k // 1000 == o), best[o])]) for o in outer]
    chosen = rows.sparkSession.createDataFrame(final, f"{fold} int, penalty double, __beta array<double>")
    return rows.withColumn(fold, F.col(fold).cast("int")).join(F.broadcast(chosen), fold).withColumn("pred", pred).drop("__beta")


def entity_sums(points: DataFrame) -> DataFrame:
    """(entity_id, n, sx, sxx, sy, sxy, syy) of (entity_id, x, y): all that a linear mixed model needs of an entity."""
    x, y = F.col("x"), F.col("y")
    return points.groupBy("entity_id").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(k) for k, c in (("sx", x), ("sxx", x * x), ("sy", y), ("sxy", x * y), ("syy", y * y))])


def _information(frame, factor: np.ndarray) -> np.ndarray:
    """Sums over entities of X'WX (3), X'Wy (2), y'Wy and log |I + L'X'XL| for a (complex) Cholesky factor (l11, l21, l22)."""
    n, sx, sxx, sy, sxy, syy = (frame[c].to_numpy(np.float64) for c in ("n", "sx", "sxx", "sy", "sxy", "syy"))
    l11, l21, l22 = factor
    # P = X'X L, v = L'X'y, K = I + L'X'X L.
    p11, p12, p21, p22 = n * l11 + sx * l21, sx * l22, sx * l11 + sxx * l21, sxx * l22
    k11, k12, k22 = 1 + l11 * p11 + l21 * p21, l11 * p12 + l21 * p22, 1 + l22 * p22
    det = k11 * k22 - k12 * k12
    v1, v2 = l11 * sy + l21 * sxy, l22 * sxy
    inner = lambda a1, a2, b1, b2: (k22 * a1 * b1 - k12 * (a1 * b2 + a2 * b1) + k11 * a2 * b2) / det
    parts = (n - inner(p11, p12, p11, p12), sx - inner(p11, p12, p21, p22), sxx - inner(p21, p22, p21, p22), sy - inner(p11, p12, v1, v2), sxy - inner(p21, p22, v1, v2), syy - inner(v1, v2, v1, v2), np.log(det))
    return np.array([x.sum() for x in parts])


def _restricted(sums: np.ndarray, total: float) -> tuple[complex, np.ndarray, complex]:
    """-2 x the restricted log likelihood (without constants), the fixed effects and the residual variance."""
    a11, a12, a22, b1, b2, c, logs = sums
    det = a11 * a22 - a12 * a12
    beta = np.array([(a22 * b1 - a12 * b2) / det, (a11 * b2 - a12 * b1) / det])
    rest = c - beta[0] * b1 - beta[1] * b2
    return (total - 2) * np.log(rest) + logs + np.log(det), beta, rest / (total - 2)


def mixed_model(points: DataFrame, iterations: int = 40, tolerance: float = 1e-6) -> tuple[dict, DataFrame]:
    """Random intercept and slope of y on x per entity by restricted maximum likelihood; (parameters, sums per entity).

    The covariance of the random effects is s2 L L' with a lower triangular L, so it is never indefinite; s2 and the fixed
    effects are profiled out. A job evaluates the criterion at several factors at once over one row per entity and returns
    seven sums for each; derivatives come from complex steps. Newton steps are damped until the Hessian is positive
    definite and tried at several lengths together; where none improves, steps down the gradient and along single
    parameters are. Parameters: a, b (fixed), s2, d11, d12, d22, criterion, converged. Fewer than three points raise.
    """
    from panelloom.functions.spread import checkpointed

    sums = checkpointed(entity_sums(points.where("x is not null and y is not null")))
    total = sums.agg(F.sum("n")).first()[0] or 0.0
    if total < 3:
        raise ValueError("a mixed model needs three points or more")
    narrow = sums.drop("entity_id")

    def evaluated(factors: list[np.ndarray]) -> list[tuple[complex, np.ndarray, complex]]:
        def run(frames):
            import pandas as pd

            found = np.zeros((len(factors), 7), dtype=complex)
            for frame in frames:
                found += np.array([_information(frame, f) for f in factors])
            yield pd.DataFrame({"factor": np.arange(len(factors)), **{f"{part}{i}": getattr(found[:, i], part) for part in ("real", "imag") for i in range(7)}})

        columns = [f"{part}{i}" for part in ("real", "imag") for i in range(7)]
        rows = narrow.mapInPandas(run, "factor int, " + ", ".join(f"{c} double" for c in columns)).groupBy("factor").agg(*[F.sum(c).alias(c) for c in columns]).collect()
        by_factor = {r["factor"]: np.array([complex(r[f"real{i}"], r[f"imag{i}"]) for i in range(7)]) for r in rows}
        return [_restricted(by_factor[i], total) for i in range(len(factors))]

    tiny, apart = 1e-20, 1e-4
    unit = np.eye(3)
    theta, value, converged = np.array([1.0, 0.0, 0.5]), math.inf, False
    for _ in range(iterations):
        centres = [theta, *[theta + sign * apart * unit[k] for k in range(3) for sign in (1, -1)]]
        slopes = evaluated([c + 1j * tiny * unit[k] for c in centres for k in range(3)])
        gradients = np.array([s[0].imag / tiny for s in slopes]).reshape(-1, 3)
        value, gradient = slopes[0][0].real, gradients[0]
        if np.abs(gradient).max() < tolerance * (1 + abs(value)):
            converged = True
            break
        hessian = (gradients[1::2] - gradients[2::2]) / (2 * apart)
        hessian = (hessian + hessian.T) / 2
        bend, axes = np.linalg.eigh(hessian)
        step = -axes @ ((axes.T @ gradient) / np.maximum(np.abs(bend), 1e-8 * max(1.0, np.abs(bend).max())))
        downhill = -gradient / max(np.abs(gradient).max(), 1e-300)
        tries = [theta + step * 0.5**k for k in range(12)] + [theta + downhill * 0.1**k for k in range(1, 8)] + [theta + sign * 0.1**k * u for u in unit for sign in (1, -1) for k in range(1, 6)]
        values = np.array([e[0].real for e in evaluated([t.astype(complex) for t in tries])])
        values[~np.isfinite(values)] = math.inf
        newton = np.flatnonzero(values[:12] < value)
        best = int(newton[0]) if len(newton) else int(values.argmin())
        if values[best] >= value:
            # Nothing near is better to within rounding.
            converged = bool(np.abs(gradient).max() < 1e-3 * (1 + abs(value)))
            break
        theta = tries[best]
    ((value, beta, s2),) = evaluated([theta.astype(complex)])
    l11, l21, l22 = theta
    s2 = s2.real
    covariance = {"d11": s2 * l11 * l11, "d12": s2 * l11 * l21, "d22": s2 * (l21 * l21 + l22 * l22)}
    return {"a": beta[0].real, "b": beta[1].real, "s2": s2, **{k: float(v) for k, v in covariance.items()}, "criterion": value.real, "converged": converged}, sums


def blup(sums: DataFrame, par: dict) -> DataFrame:
    """Adds the predicted random effects u0, u1, their posterior covariance and the expected residual sum of squares."""
    det = par["d11"] * par["d22"] - par["d12"] ** 2 + 1e-12
    p11, p12, p22 = par["d22"] / det, -par["d12"] / det, par["d11"] / det
    s2, a, b = par["s2"], par["a"], par["b"]
    m11, m12, m22 = F.col("n") / s2 + p11, F.col("sx") / s2 + p12, F.col("sxx") / s2 + p22
    r0 = F.col("sy") - a * F.col("n") - b * F.col("sx")
    r1 = F.col("sxy") - a * F.col("sx") - b * F.col("sxx")
    rr = F.col("syy") + a * a * F.col("n") + b * b * F.col("sxx") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + 2 * a * b * F.col("sx")
    d = m11 * m22 - m12 * m12
    c11, c12, c22 = m22 / d, -m12 / d, m11 / d
    out = sums.withColumns({"c11": c11, "c12": c12, "c22": c22, "r0": r0, "r1": r1, "rr": rr})
    u0 = (F.col("c11") * F.col("r0") + F.col("c12") * F.col("r1")) / s2
    u1 = (F.col("c12") * F.col("r0") + F.col("c22") * F.col("r1")) / s2
    out = out.withColumns({"u0": u0, "u1": u1})
    fit = F.col("u0") * F.col("u0") * F.col("n") + 2 * F.col("u0") * F.col("u1") * F.col("sx") + F.col("u1") * F.col("u1") * F.col("sxx")
    trace = F.col("c11") * F.col("n") + 2 * F.col("c12") * F.col("sx") + F.col("c22") * F.col("sxx")
    return out.withColumn("rss", F.col("rr") - 2 * (F.col("u0") * F.col("r0") + F.col("u1") * F.col("r1")) + fit + trace)


def _polygamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma of x > 0, by ten steps of recurrence and the asymptotic series."""
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(10):
        first, second, x = first - 1 / x, second + 1 / x**2, x + 1
    y = 1 / x**2
    return first + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252)), second + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y / 42))


def cox(survival: DataFrame, covariates: list[str], penalty: float = 0.05, steps: int = 25, ticks: float | None = None) -> list[tuple[str, float, float, float, float]]:
    """(covariate, coefficient, standard error, hazard ratio, p) of Cox's model with Efron ties, by rows of (time_yr, event).

    Covariates are standardised, so a hazard ratio is that of one standard deviation; the L2 penalty is on the mean
    likelihood; p is of Wald's test. Times are taken as they stand, or in whole `ticks` of a year. A Newton step sums risks,
    weighted covariates and their products by time, deals the times by ranges, and takes the sums over risk sets as running
    totals inside the ranges: the driver gets one row of totals per range, then p + p^2 numbers. The sums over d events of
    one time have closed forms in the digamma and trigamma functions. Null times, events or covariates are left out.
    """
    from panelloom.functions.spread import checkpointed

    survival = survival.where(F.col("time_yr").isNotNull() & F.col("event").isNotNull() & sum((F.col(c).isNull().cast("int") for c in covariates), F.lit(0)).eqNullSafe(0))
    stats = survival.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(covariates) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [((F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] + 1e-9)).alias(f"z{i}") for i, c in enumerate(covariates)]
    time = F.col("time_yr").cast("double") if ticks is None else F.round(F.col("time_yr") * ticks).cast("double")
    rows = checkpointed(survival.select(time.alias("time"), F.col("event").cast("int").alias("event"), *z))
    p, n = len(covariates), max(1, stats.n)
    names = ["", *[f"_{i}" for i in range(p)], *[f"_{i}_{j}" for i in range(p) for j in range(i, p)]]
    own, events = [f"w{k}" for k in names], [f"v{k}" for k in names]
    beta, hessian = np.zeros(p), np.eye(p)
    for _ in range(steps):
        risk = F.exp(sum((F.col(f"z{i}") * float(beta[i]) for i in range(p)), F.lit(0.0)))
        parts = {"": risk, **{f"_{i}": risk * F.col(f"z{i}") for i in range(p)}, **{f"_{i}_{j}": risk * F.col(f"z{i}") * F.col(f"z{j}") for i in range(p) for j in range(i, p)}}
        sums = [F.sum("event").alias("d"), *[F.sum(c).alias(f"w{k}") for k, c in parts.items()], *[F.sum(F.col("event") * c).alias(f"v{k}") for k, c in parts.items()], *[F.sum(F.col("event") * F.col(f"z{i}")).alias(f"e{i}") for i in range(p)]]
        dealt = checkpointed(rows.groupBy("time").agg(*sums).repartitionByRange(F.desc("time")).sortWithinPartitions(F.desc("time")).withColumn("__r", F.spark_partition_id()))
        totals = dealt.groupBy("__r").agg(*[F.sum(c).alias(c) for c in own]).orderBy("__r").toPandas()
        later = dict(zip(totals["__r"], (totals[own].cumsum() - totals[own]).to_numpy()))
        score = np.zeros(p)
        bend = np.zeros((p, p))
        shape = ", ".join(f"g{i} double" for i in range(p)) + ", " + ", ".join(f"h{i}_{j} double" for i in range(p) for j in range(p))
        for r in dealt.mapInPandas(_cox_terms(p, own, events, later), shape).collect():
            score += np.array([r[f"g{i}"] for i in range(p)])
            bend += np.array([[r[f"h{i}_{j}"] for j in range(p)] for i in range(p)])
        hessian = bend + penalty * n * np.eye(p)
        step = np.linalg.solve(hessian, score - penalty * n * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    error = np.sqrt(np.diag(np.linalg.inv(hessian)))
    return [(c, float(b), float(e), math.exp(b), math.erfc(abs(b / e) / math.sqrt(2))) for c, b, e in zip(covariates, beta, error)]


def _cox_terms(p: int, own: list[str], events: list[str], later: dict):
    """One row of score and information sums per range of times, in descending order; `later`: risk sums before a range."""

    def run(frames):
        import pandas as pd

        score, bend, seen = np.zeros(p), np.zeros((p, p)), None
        place = {k: i for i, k in enumerate(own)}
        for g in frames:
            if not len(g):
                continue
            if seen is None:
                seen = later[g["__r"].iloc[0]].copy()
            at_risk = g[own].to_numpy().cumsum(axis=0) + seen
            seen = at_risk[-1]
            score += g[[f"e{i}" for i in range(p)]].sum().to_numpy()
            use = (g["d"] > 0).to_numpy()
            if not use.any():
                continue
            at_risk, dying, d = at_risk[use], g[events].to_numpy()[use], g["d"].to_numpy(float)[use]
            w, v = at_risk[:, 0], dying[:, 0]
            w1, v1 = at_risk[:, 1 : p + 1], dying[:, 1 : p + 1]
            # Over l = 0 .. d - 1: sums of 1 / (w - v l / d) and of its square.
            top, low = _polygamma(w * d / v + 1), _polygamma(np.maximum(w * d / v - d, 0) + 1)
            t1, t2 = d / v * (top[0] - low[0]), (d / v) ** 2 * (low[1] - top[1])
            share, rest = v1 / v[:, None], w1 - v1 * (w / v)[:, None]
            score -= (d[:, None] * share + rest * t1[:, None]).sum(axis=0)
            for i in range(p):
                for j in range(i, p):
                    k = place[f"w_{i}_{j}"]
                    w2, v2 = at_risk[:, k], dying[:, k]
                    second = d * v2 / v + (w2 - v2 * w / v) * t1
                    product = d * share[:, i] * share[:, j] + (share[:, i] * rest[:, j] + share[:, j] * rest[:, i]) * t1 + rest[:, i] * rest[:, j] * t2
                    bend[i, j] += (second - product).sum()
                    bend[j, i] = bend[i, j]
        yield pd.DataFrame({**{f"g{i}": [score[i]] for i in range(p)}, **{f"h{i}_{j}": [bend[i, j]] for i in range(p) for j in range(p)}})

    return run


def triple_design(tuples: DataFrame, clinical: list[str] | None = None) -> DataFrame:
    """Adds the six history features of a triple (and keeps the clinical ones): log volume, log change, its rate per year,
    the horizon in years, rate times horizon, log first interval."""
    rate = F.log(F.col("v2") / F.col("v1")) / (F.col("dt1") / 365.25)
    horizon = F.col("dt2") / 365.25
    features = {"log_v2": F.log("v2"), "log_change": F.log(F.col("v2") / F.col("v1")), "rate_yr": rate, "horizon_yr": horizon, "rate_x_horizon": rate * horizon, "log_dt1": F.log(F.col("dt1") / 365.25)}
    return tuples.withColumns(features).select(*tuples.columns, *[c for c in features if c not in tuples.columns], *[c for c in clinical or [] if c not in tuples.columns])


def predict_from_two(tuples: DataFrame, par: dict) -> DataFrame:
    """Adds pred: the volume at the third time by the mixed model, its random effects taken from the first two points.

    par: a, b, s2, d11, d12, d22 as mixed_model() gives them. The effects are blup() of the two points' sums.
    """
    x2, x3 = F.col("dt1") / 365.25, (F.col("dt1") + F.col("dt2")) / 365.25
    y1, y2 = F.log("v1"), F.log("v2")
    sums = tuples.withColumns({"n": F.lit(2.0), "sx": x2, "sxx": x2 * x2, "sy": y1 + y2, "sxy": x2 * y2, "syy": y1 * y1 + y2 * y2, "__x3": x3})
    out = blup(sums, par)
    return out.withColumn("pred", F.exp(par["a"] + F.col("u0") + (par["b"] + F.col("u1")) * F.col("__x3"))).select(*tuples.columns, "pred")


def prevalence(rows: DataFrame, event: str = "event", fold: str = "fold") -> DataFrame:
    """Adds p: the event rate of the other folds."""
    rates = held_out_mean(rows.withColumn("__e", F.col(event).cast("double")), "__e", fold).withColumnRenamed("train_mean", "p")
    return rows.join(F.broadcast(rates), fold)


def model_grid(rows: DataFrame, target: str, feature_sets: dict[str, list[str]], models: dict, plain: dict | None = None) -> DataFrame:
    """(features, model, n, mae, r2): out-of-fold scores of every model with every feature set, one job after the other.

    models: functions (rows, features) -> rows with pred; plain: functions (rows) -> rows with pred of models that take no
    features, which are fitted and scored once for all sets. The rows are written once, so that models do not compute them anew.
    """
    from panelloom.functions.spread import checkpointed

    kept, out = checkpointed(rows), []
    y, e = F.col(target), F.col(target) - F.col("pred")
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)

    def scored(fitted: DataFrame, model: str, sets: list[str]) -> DataFrame:
        found = fitted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.when(spread > 0, spread)).alias("r2"))
        return found.select(F.explode(F.array(*[F.lit(s) for s in sets])).alias("features"), F.lit(model).alias("model"), "n", "mae", "r2")

    for model, fit in (plain or {}).items():
        out.append(scored(fit(kept), model, list(feature_sets)))
    for name, features in feature_sets.items():
        out += [scored(fit(kept, features), model, [name]) for model, fit in models.items()]
    return reduce(DataFrame.unionByName, out)


def logistic_with_inner_cv(rows: DataFrame, features: list[str], target: str, costs: list[float], fold: str = "fold", inner: str = "inner", steps: int = 25) -> DataFrame:
    """Adds p and cost: out-of-fold logistic regression, its cost C chosen per outer fold by inner-fold log loss (ties low).

    The penalty is |beta|^2 / (2 C) on features standardised by the outer training rows; the intercept is free. All fits,
    one per outer fold, inner fold (or none) and C, take their Newton steps together: a step is one aggregation of gradient
    and Hessian sums by fit. Outer folds whose training rows have one class are skipped.
    """
    from panelloom.functions.spread import checkpointed

    spark = rows.sparkSession
    p = len(features)
    kept = checkpointed(rows.withColumn(fold, F.col(fold).cast("int")).withColumn(inner, F.col(inner).cast("int")).withColumn("__y", F.col(target).cast("double")))
    folds = sorted(r[0] for r in kept.select(fold).distinct().collect())
    inners = sorted(r[0] for r in kept.select(inner).distinct().collect())
    grams = gram_sums(kept, features, "__y", fold)
    total = sum(grams.values())
    scale, fits = {}, {}
    for o in folds:
        g = total - grams[o]
        if g[0, 0] <= 0 or not 0 < g[0, p + 1] < g[0, 0]:
            continue
        mean = g[0, 1 : p + 1] / g[0, 0]
        scale[o] = mean, np.sqrt(np.maximum(np.diag(g)[1 : p + 1] / g[0, 0] - mean**2, 0)) + 1e-9
        fits |= {(o, i, c): np.zeros(p + 1) for i in [*inners, -1] for c in range(len(costs))}
    z = [F.lit(1.0), *[(F.col(f) - F.get("__m", i)) / F.get("__s", i) for i, f in enumerate(features)]]

    def with_fits(chosen: dict) -> DataFrame:
        table = [(o, i, c, [float(b) for b in beta], [float(x) for x in scale[o][0]], [float(x) for x in scale[o][1]]) for (o, i, c), beta in chosen.items()]
        return F.broadcast(spark.createDataFrame(table, "__o int, __i int, __c int, __b array<double>, __m array<double>, __s array<double>"))

    score = sum((F.get("__b", i) * F.col(f"__z{i}") for i in range(p + 1)), F.lit(0.0))
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), score))))
    for _ in range(steps):
        if not fits:
            break
        train = kept.join(with_fits(fits), (F.col("__o") != F.col(fold)) & (F.col("__i") != F.col(inner))).withColumns({f"__z{i}": c for i, c in enumerate(z)}).withColumn("__p", chance)
        sums = [F.sum((F.col("__y") - F.col("__p")) * F.col(f"__z{i}")).alias(f"g{i}") for i in range(p + 1)]
        sums += [F.sum(F.col("__p") * (1 - F.col("__p")) * F.col(f"__z{i}") * F.col(f"__z{j}")).alias(f"h{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
        most = 0.0
        for r in train.groupBy("__o", "__i", "__c").agg(*sums).collect():
            key = (r["__o"], r["__i"], r["__c"])
            ridge = np.diag([1e-9, *[1 / costs[key[2]]] * p])
            hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) + ridge
            step = np.linalg.solve(hessian, np.array([r[f"g{i}"] for i in range(p + 1)]) - ridge @ fits[key])
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            fits[key] = fits[key] + step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-8:
            break
    held = kept.join(with_fits({k: b for k, b in fits.items() if k[1] >= 0}), (F.col("__o") != F.col(fold)) & (F.col("__i") == F.col(inner))).withColumns({f"__z{i}": c for i, c in enumerate(z)})
    loss = -F.when(F.col("__y") == 1, F.log(chance)).otherwise(F.log(1 - chance))
    scores = held.withColumn("__l", loss).groupBy("__o", "__c", "__i").agg(F.avg("__l").alias("l")).groupBy("__o", "__c").agg(F.round(F.avg("l"), 9).alias("l"))
    best = {r["__o"]: r.b["__c"] for r in scores.groupBy("__o").agg(F.min(F.struct("l", "__c")).alias("b")).collect()}
    final = with_fits({(o, -1, c): fits[o, -1, c] for o, c in best.items()})
    out = kept.join(final, F.col("__o") == F.col(fold)).withColumns({f"__z{i}": c for i, c in enumerate(z)})
    cost = F.get(F.array(*[F.lit(float(c)) for c in costs]), F.col("__c"))
    return out.select(*rows.columns, chance.alias("p"), cost.alias("cost"))
