"""Models against numpy: sums with missing targets, penalties, scores, the gate, and a saved model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import models
from quayside.operators.stats import exact_quantiles
from quayside.plans.models import gate

FEATURES, TARGETS = ["a", "b", "c"], ["y", "z"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 7, 3]
    x[rng.random(n) < 0.1, 1] = np.nan
    y = np.stack([x[:, 0] + np.nan_to_num(x[:, 1]) / 60 + rng.normal(size=n), rng.normal(size=n) - 90 * x[:, 2]], 1)
    y[rng.random(n) < 0.2, 0] = np.nan
    y[rng.random(n) < 0.5, 1] = np.nan
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(i, i, *map(none, x[i]), *map(none, y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "ts long, place long, a double, b double, c double, y double, z double").repartition(5), x, y


def plain(x, y, end):
    """Standardiser and {target: (penalty, coefficients, intercept)} of the first ``end`` rows."""
    x, y = x[:end], y[:end]
    med = np.nanmedian(x, 0)
    xi = np.where(np.isnan(x), med, x)
    mu, sd = xi.mean(0), xi.std(0)
    z, cut, out = np.clip((xi - mu) / sd, -8, 8), end * 3 // 4, {}

    def fit(z, y, k):
        zc, yc = z - z.mean(0), y - y.mean()
        c = np.linalg.solve(zc.T @ zc + k * np.eye(3), zc.T @ yc)
        return c, y.mean() - z.mean(0) @ c

    for j, t in enumerate(TARGETS):
        m = ~np.isnan(y[:, j])
        tr, va = m & (np.arange(end) < cut), m & (np.arange(end) >= cut)
        best = models.PENALTIES[-1]
        if tr.sum() > 100 and va.sum() > 100:
            errors = []
            for k in models.PENALTIES:
                c, i = fit(z[tr], y[tr, j], k)
                errors.append(np.mean((z[va] @ c + i - y[va, j]) ** 2))
            best = models.PENALTIES[int(np.argmin(errors))]
        out[t] = (best, *fit(z[m], y[m, j], best))
    return (med, mu, sd), out


def test_ridge_of_every_target_and_fold(spark, data):
    df, x, y = data
    ends, tests = (400, 700), [(0, 410, 500), (1, 710, 900)]
    folds = models.splits(df, [(k, 0, e) for k, e in enumerate(ends)], "ts")
    params = models.standardisers(df, FEATURES, folds, "ts")
    weights = models.ridge(models.masked_sums(df, FEATURES, TARGETS, params, folds, "ts"), FEATURES)
    got = {(r.fold, r.target, r.feature): (r.penalty, r.coefficient) for r in weights.collect()}
    scores = {(r.place, r.target): r.score for r in models.fold_scores(df, params, weights, tests, "ts", ["place"]).collect()}
    for k, end in enumerate(ends):
        (med, mu, sd), want = plain(x, y, end)
        z = np.clip((np.where(np.isnan(x), med, x) - mu) / sd, -8, 8)
        for t, (penalty, c, i) in want.items():
            for f, v in zip([*FEATURES, "one"], [*c, i], strict=True):
                assert got[k, t, f][0] == penalty and got[k, t, f][1] == pytest.approx(v, rel=1e-8, abs=1e-10)
            for p in range(tests[k][1], tests[k][2]):
                assert scores[p, t] == pytest.approx(z[p] @ c + i, rel=1e-8, abs=1e-9)
    assert len(scores) == 2 * (90 + 190)
    assert {w[0] for w in want.values()} <= set(models.PENALTIES) and plain(x, y, 400)[1]["z"][0] == models.PENALTIES[-1]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [("n", float(v)) for v in rng.normal(size=3000)] + [("t", float(v)) for v in rng.integers(0, 4, 500)] + [("one", 5.0), ("none", None), ("t", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, ["g"], "x", qs).collect()}
    for g in ("n", "t", "one"):
        x = [v for k, v in rows if k == g and not np.isnan(v)]
        assert [got[g, q] for q in qs] == pytest.approx(np.quantile(x, qs))
    assert len(got) == 15
    assert exact_quantiles(df.where("g = 't'"), [], "x", [0.5]).first().value == np.median([v for k, v in rows if k == "t" and not np.isnan(v)])


def test_gate_tells_gain_from_none(spark):
    rng = np.random.default_rng(2)
    for mean, justified in ((0.3, True), (-0.3, False), (0.0, False)):
        x = rng.normal(mean, 1, 605)
        df = spark.createDataFrame([(i, float(v), 605) for i, v in enumerate(x)], "place long, gain double, rows long").repartition(3)
        r = gate(df, 60, 400).first()
        assert (r.rows, r.clusters, r.justified) == (605, 10, justified) and r.gain == pytest.approx(x.mean())


def test_saved_model_decides_in_another_session(spark, data, tmp_path):
    df, x, y = data
    path = str(tmp_path / "model")
    folds = models.splits(df, [(0, 0, 700)], "ts")
    params = models.standardisers(df, FEATURES, folds, "ts")
    weights = models.ridge(models.masked_sums(df, FEATURES, TARGETS, params, folds, "ts"), FEATURES)
    tables = {
        "about": spark.createDataFrame([("ridge", "aggressive", models.schema_digest(df, FEATURES), 0, 700, 700, 900)], models.TABLES["about"]),
        "standardiser": params.join(spark.createDataFrame(list(enumerate(FEATURES)), "position int, feature string"), "feature"), "coefficients": weights,
        "policy": spark.createDataFrame([(1, "y", 10, 0.5, 60, 0.4, 0.1, 0.2), (-1, "z", 20, -270.0, 60, 0.3, 0.1, 0.1)], models.TABLES["policy"])}
    models.save_bundle(path, tables)
    other = spark.newSession()
    rows = other.createDataFrame([tuple(r) for r in df.collect()], df.schema)
    got = {r.place: r for r in models.Bundle(other, path).decided(rows).collect()}
    (med, mu, sd), want = plain(x, y, 700)
    z = np.clip((np.where(np.isnan(x), med, x) - mu) / sd, -8, 8)
    sides = set()
    for p, r in got.items():
        s = {t: z[p] @ c + i for t, (_, c, i) in want.items()}
        assert r.score_y == pytest.approx(s["y"], rel=1e-8, abs=1e-9)
        side = 1 if s["y"] >= 0.5 else -1 if s["z"] >= -270.0 else 0
        assert (r.side, r.mu) == (side, {1: 0.4, -1: 0.3, 0: None}[side])
        sides.add(side)
    assert sides == {1, -1, 0}
    with pytest.raises(ValueError):
        models.Bundle(spark, path).scored(df.withColumn("a", F.col("a").cast("float")))


def test_policy_takes_the_best_bounded_gain(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=2000)
    r = np.where(s > 0.8, 0.02, -0.01) + rng.normal(0, 0.005, 2000)
    rows = [(i // 100, float(s[i]), float(r[i]), float(-s[i]), float(-r[i] - 0.02)) for i in range(2000)]
    df = spark.createDataFrame(rows, "b long, score_l double, l double, score_s double, s double")
    got = models.calibrated(df, {"l": (1, 10**9), "s": (-1, 10**9)}, F.col("b"), 4, 1e5, 1.645, 50).collect()
    assert [x.side for x in got] == [1] or {x.side for x in got} == {1}
    best, want = None, None
    for k in range(1, 9):
        th = np.quantile(s, 0.1 * k)
        hit = s >= th
        m = r[hit].mean()
        dev = np.array([(r[hit & (np.arange(2000) // 100 == b)] - m).sum() for b in range(20)])
        lcb = m - 1.645 * np.sqrt((dev**2).sum() * 20 / 19) / hit.sum()
        gain = min(hit.sum(), 4 * 1e5 / 2) * lcb
        if lcb > 0 and (best is None or gain > best):
            best, want = gain, (th, hit.sum(), m, lcb)
    assert (got[0].threshold, got[0].n, got[0].mean, got[0].lcb) == pytest.approx(want)


def test_isotonic_map_is_the_pooled_one(spark):
    from quayside.plans.research import isotonic_calibrate, matrix

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.f0, r.target, r.vec_id) for r in matrix(spark, sf).select("f0", "target", "vec_id").collect())
    pools = []  # sum, count, ids: equal scores first, then neighbours out of order
    for k, (x, y, i) in enumerate(rows):
        if k and rows[k - 1][0] == x:
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + 1, [*pools[-1][2], i]]
        else:
            pools.append([y, 1, [i]])
    merged = []
    for p in pools:
        merged.append(p)
        while len(merged) > 1 and merged[-2][0] / merged[-2][1] >= merged[-1][0] / merged[-1][1]:
            b, a = merged.pop(), merged.pop()
            merged.append([a[0] + b[0], a[1] + b[1], a[2] + b[2]])
    want = {i: s / n for s, n, ids in merged for i in ids}
    got = {r.vec_id: r.prediction for r in isotonic_calibrate(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_prior_latencies_follow_the_lognormal(spark):
    from quayside.plans.evaluation import prior_latency

    rows = prior_latency(spark, "/root/testdata/sf0.001").collect()
    logs = np.log([r.latency_ms for r in rows])
    n = len(rows)
    assert n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert logs.mean() == pytest.approx(np.log(400), abs=4 * 0.7 / n**0.5) and logs.std() == pytest.approx(0.7, abs=0.07)
    by = {}
    for r in rows:  # a row of the table is one latency, and later rows are longer
        assert by.setdefault(r.i, r.latency_ms) == r.latency_ms
    assert [by[i] for i in sorted(by)] == sorted(by.values())
