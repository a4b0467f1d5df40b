"""Paths over DataFrames: Spark and local rows agree, planted truth is found, all sources give the same moments."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import cox, paths
from ridgeline.operators import penalties as P
from ridgeline.operators.estimators import estimator, fit_with_orthonormalization, names
from ridgeline.operators.moments import moments
from ridgeline.operators.paths import SparkRows, Spec, adaptive_path, fit_path, reweighted_path, rows_of
from ridgeline.operators.scoring import predict
from ridgeline.operators.selection import MFDR, StabilitySelection, cross_validate, mfdr, on_path, select_by_ic, stratified_folds

X = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = rng.standard_normal((n, 6))
    eta = x[:, 0] * 1.5 - x[:, 1] * 1.0 + 0.8 * x[:, 2]
    u = rng.random(n)
    time, cut = rng.exponential(np.exp(-eta)), rng.exponential(2.0, n)
    cols = {
        "y": eta + 0.3 + 0.1 * rng.standard_normal(n),
        "y2": -eta + 0.1 * rng.standard_normal(n),
        "b": (u < 1 / (1 + np.exp(-eta))).astype(float),
        "c": rng.poisson(np.exp(0.5 * eta)).astype(float),
        "t": np.round(np.minimum(time, cut), 2),
        "d": (time <= cut).astype(int),
        "k": np.where(eta > 0.7, 2, np.where(eta > -0.7, 1, 0)),
        "w": rng.random(n) + 0.5,
        "fold": np.arange(n) % 5,
    }
    rows = [(i, *map(float, x[i]), *(c[i].item() for c in cols.values())) for i in range(n)]
    types = "id long, " + ", ".join(f"{c} double" for c in X) + ", y double, y2 double, b double, c double, t double, d int, k int, w double, fold int"
    return spark.createDataFrame(rows, types).withColumn("arr", F.array(*X)).cache()


def test_moments_narrow_wide_and_weighted_agree(frame):
    a, b = moments(frame, X, ["y"], weight="w"), moments(frame, "arr", ["y"], weight="w")
    assert np.allclose(a.centered(), b.centered()) and np.allclose(a.mean, b.mean) and a.n == b.n == 600
    parts = moments(frame, X, ["y"], by="fold")
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    whole = moments(frame, X, ["y"])
    assert np.allclose(total.centered(), whole.centered())
    rest = whole - parts[0]
    assert np.allclose(rest.centered(), moments(frame.filter("fold != 0"), X, ["y"]).centered())


def test_moments_leave_out_rows_with_nulls(spark, frame):
    more = frame.select(*X, "y").unionByName(frame.limit(5).select(F.lit(None).cast("double").alias("x0"), *X[1:], "y"))
    assert moments(more, X, ["y"]).n == 600
    assert moments(frame.filter("id < 0"), X, ["y"]).n == 0


@pytest.mark.parametrize("penalty", [P.Lasso(), P.MCP(), P.SCAD(), P.ElasticNet(0.5)])
def test_least_squares_finds_the_truth(frame, penalty):
    path = fit_path(frame, X, "y", penalty, n_lambdas=30, lambda_min_ratio=0.01)
    assert np.all(np.sign(path.coefs[-1][:3]) == [1, -1, 1]) and np.abs(path.coefs[-1][:3] - [1.5, -1, 0.8]).max() < 0.05
    assert all(d["converged"] for d in path.info) and abs(path.intercepts[-1] - 0.3) < 0.05


def test_standardizing_only_preconditions_scalar_lasso(frame):
    grid = {"lambdas": [0.5, 0.1]}
    a, b = (fit_path(frame, X, "y", P.Lasso(), standardize=s, **grid) for s in (False, True))
    assert np.allclose(a.coefs, b.coefs, atol=1e-6)


@pytest.mark.parametrize(("family", "y"), [("binomial", "b"), ("poisson", "c"), ("huber", "y")])
def test_spark_rounds_equal_local_rounds(frame, family, y, monkeypatch):
    grid = {"lambdas": [0.1, 0.02]}
    local = fit_path(frame, X, y, P.MCP(), family=family, **grid)
    monkeypatch.setattr(paths, "LOCAL_CELLS", 0)
    far = fit_path(frame, X, y, P.MCP(), family=family, **grid)
    wide = fit_path(frame, "arr", y, P.MCP(), family=family, **grid)
    assert np.allclose(local.coefs, far.coefs, atol=1e-5) and np.allclose(local.coefs, wide.coefs, atol=1e-5)
    assert np.allclose(local.intercepts, far.intercepts, atol=1e-5)
    assert np.sign(local.coefs[-1][:2]).tolist() == [1, -1]


@pytest.mark.parametrize("times", [0, 10_000])
@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_cox_spark_equals_local(frame, ties, times, monkeypatch):
    monkeypatch.setattr(cox, "LOCAL_TIMES", times)
    rows, terms = rows_of(frame, X, "t", second="d")
    far = SparkRows(frame.select(*X, F.col("t").alias("_y"), F.col("d").cast("double").alias("_second")), X, 6)
    beta = np.array([0.5, -0.2, 0.1, 0, 0, 0])
    (a, la), (b, lb) = rows.round("cox", beta, 0.0, {"ties": ties}), far.round("cox", beta, 0.0, {"ties": ties})
    assert np.allclose(a.about(0.0), b.about(0.0), rtol=1e-6) and abs(la - lb) < 1e-6 * abs(la)
    path = reweighted_path(rows, Spec(P.MCP(), terms), "cox", lambdas=[0.05], ties=ties)
    assert np.sign(path.coefs[0][:3]).tolist() == [1, -1, 1]


def test_concordance_counts_pairs(spark):
    rows = [(1.0, 1, 3.0), (2.0, 1, 1.0), (3.0, 0, 1.0), (2.0, 0, 5.0)]
    got = cox.concordance(spark.createDataFrame(rows, "t double, d int, s double"), "t", "d", "s").first()
    pairs = [(a, b) for a in rows for b in rows if a[1] == 1 and b[0] > a[0]]
    want = sum(1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a, b in pairs) / len(pairs)
    assert got["pairs"] == len(pairs) and abs(got["c_index"] - want) < 1e-12


@pytest.mark.parametrize("ranges", [(100_000, 1000), (40, 1000), (40, 3)])
def test_concordance_over_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(cox, "RANGE_CELLS", ranges[0])
    monkeypatch.setattr(cox, "MOST_RANGES", ranges[1])
    r = np.random.default_rng(1)
    t, s = np.round(r.exponential(3, 600), 2), np.round(r.normal(size=600), 2)
    t[r.random(600) < 0.35], s[r.random(600) < 0.33] = 2.0, 0.1
    d = (r.random(600) < 0.5).astype(int)
    df = spark.createDataFrame([*zip(t.tolist(), d.tolist(), s.tolist(), strict=True), (None, 1, 1.0), (1.0, None, 1.0), (1.0, 1, None)], "t double, d int, s double")
    got = cox.concordance(df, "t", "d", "s").first()
    pair = (d == 1)[:, None] & (t[None, :] > t[:, None])
    want = [float((pair & x).sum()) for x in (s[:, None] > s[None, :], s[:, None] == s[None, :], True)]
    assert list(got)[:3] == want
    both = cox.concordances(df.withColumn("u", -F.col("s")), "t", "d", ["s", "u"]).orderBy("score_idx").collect()
    assert list(both[0])[1:4] == want and list(both[1])[1:4] == [want[2] - want[0] - want[1], *want[1:]]
    assert cox.concordance(df.limit(0), "t", "d", "s").first()["c_index"] == 0.5


def test_groups_tasks_classes(frame):
    path = fit_path(frame, X, "y", P.GroupMCP(), groups=[0, 0, 0, 1, 1, 1], n_lambdas=20, lambda_min_ratio=0.05)
    assert not path.coefs[-1][3:].any() and path.coefs[-1][:3].all()
    tasks = fit_path(frame, X, ["y", "y2"], P.GroupLasso(), n_lambdas=10, lambda_min_ratio=0.05)
    assert tasks.coefs.shape == (10, 6, 2) and np.all(np.sign(tasks.coefs[-1][0]) == [1, -1])
    classes = fit_path(frame, X, "k", P.GroupLasso(), family="multinomial", n_lambdas=8, lambda_min_ratio=0.05)
    assert classes.labels == (0, 1, 2) and classes.coefs[-1][0, 2] > 0 > classes.coefs[-1][0, 0]
    made = predict(frame, classes).agg(F.avg((F.col("prediction") == F.col("k")).cast("double"))).first()[0]
    assert made > 0.8


def test_multinomial_spark_equals_local(frame, monkeypatch):
    args = {"family": "multinomial", "lambdas": [0.05], "max_outer": 30}
    local = fit_path(frame, X, "k", P.GroupLasso(), **args)
    monkeypatch.setattr(paths, "LOCAL_CELLS", 0)
    assert np.allclose(local.coefs, fit_path(frame, X, "k", P.GroupLasso(), **args).coefs, atol=1e-6)


def test_cross_validation_and_criteria(frame):
    cv = cross_validate(frame, X, "y", P.MCP(), "fold", n_lambdas=20, lambda_min_ratio=0.01)
    assert cv.scores.shape == (5, 20) and np.nanmin(cv.scores.mean(axis=0)) < 0.02
    direct = cross_validate(frame, X, "b", P.Lasso(), "fold", family="binomial", n_lambdas=5, lambda_min_ratio=0.05)
    assert np.isfinite(direct.scores).all()
    surv = cross_validate(frame, X, "t", P.MCP(), "fold", family="cox", event="d", n_lambdas=4, lambda_min_ratio=0.1)
    assert surv.higher_is_better and surv.scores[:, surv.best].mean() > 0.7
    m = moments(frame, X, ["y"])
    assert (np.abs(cv.path.coefs[select_by_ic(cv.path, m.n, m, "ebic")]) > 0).tolist() == [True] * 3 + [False] * 3
    rates = mfdr(cv.path, m.n, m)
    assert ((rates >= 0) & (rates <= 1)).all()


def test_adaptive_orthonormal_stability(frame):
    path = adaptive_path(frame, X, "y", P.Lasso(), n_lambdas=20, lambda_min_ratio=0.01)
    assert (np.abs(path.coefs[10]) > 0).tolist()[3:] == [False] * 3
    ortho = fit_with_orthonormalization(frame, X, "y", P.GroupLasso(), [0, 0, 1, 1, 2, 2], lambdas=[1e-6])
    assert np.abs(ortho.coefs[0][:3] - [1.5, -1, 0.8]).max() < 0.05
    stable = StabilitySelection(P.Lasso(), resamples=20, lambda_min_ratio=0.2).fit(frame, X, "y", "id")
    assert stable.stable_.tolist()[:3] == [True] * 3
    again = StabilitySelection(P.Lasso(), resamples=20, lambda_min_ratio=0.2).fit(frame, X, "y", "id")
    assert np.array_equal(stable.probabilities_, again.probabilities_)


def test_working_sets_reach_the_same_path(frame):
    from ridgeline.operators.wide import wide_path

    for penalty in (P.Lasso(), P.MCP()):
        grid = {"n_lambdas": 6, "lambda_min_ratio": 0.05}
        far, near = wide_path(frame, "arr", "y", penalty, add=2, **grid), fit_path(frame, "arr", "y", penalty, **grid)
        assert np.allclose(far.coefs, near.coefs, atol=1e-6) and np.allclose(far.intercepts, near.intercepts, atol=1e-6)


def test_stratified_folds_are_even(frame):
    sizes = stratified_folds(frame, "d", ["id"]).groupBy("d", "fold").count().collect()
    for d in (0, 1):
        own = [r["count"] for r in sizes if r["d"] == d]
        assert len(own) == 5 and max(own) - min(own) <= 1


def test_every_named_estimator_can_be_made():
    found = names()
    assert len(found) == len(set(found)) > 140
    for n in found:
        estimator(n, groups=[0, 0, 1])


@pytest.mark.parametrize("name", ["MCPRegressor", "BridgePathRegressor", "CompositeMCPPathRegressor", "GroupExponentialPathRegressor", "SparseGroupSCADPathCV", "AdaptiveMCPPathCV", "MultiTaskMCPPathCV"])
def test_named_estimators_fit(frame, name):
    # Bridge starts from weights far above 1, so its path opens far below the top.
    grid = {} if name == "MCPRegressor" else {"n_lambdas": 8, "lambda_min_ratio": 1e-4 if "Bridge" in name else 0.05}
    est = estimator(name, **({"groups": [0, 0, 0, 1, 1, 1]} if "Group" in name or "Composite" in name else {}), **grid)
    y = ["y", "y2"] if "MultiTask" in name else "y"
    est.fit(frame, X, y, fold="fold" if est.cv else None)
    assert est.coefficients(frame).count() > 0 and est.predict(frame).count() == 600
    assert est.result_.coefs[-1][0].any()


def test_narrow_and_wide_moments_leave_out_the_same_rows(spark):
    rows = [(float(i), float(i * i % 7), float(i % 5), i % 3) for i in range(30)] + [(float("inf"), 1.0, 1.0, 0), (1.0, float("nan"), 1.0, 1), (1.0, 1.0, None, 2), (2.0, 2.0, 2.0, None), (1.0, 1.0, float("-inf"), 1)]
    df = spark.createDataFrame(rows, "a double, b double, y double, f int").withColumn("arr", F.array("a", "b"))
    narrow, wide = moments(df, ["a", "b"], ["y"]), moments(df, "arr", ["y"])
    assert narrow.n == wide.n == 31 and np.allclose(narrow.centered(), wide.centered())  # the row without a fold counts where no fold is used
    narrow, wide = moments(df, ["a", "b"], ["y"], by="f"), moments(df, "arr", ["y"], by="f")
    assert set(narrow) == set(wide) == {0, 1, 2}
    assert all(narrow[k].n == wide[k].n == 10 and np.allclose(narrow[k].centered(), wide[k].centered()) for k in narrow)


@pytest.mark.parametrize("features", [X[:3], "far"])
def test_rows_far_from_zero_give_the_same_path_in_both_places(spark, frame, features):
    far = frame.select("b", "k", *[(F.col(c) + 1e6).alias(c) for c in X[:3]]).withColumn("far", F.array(*X[:3]))
    frame.count()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for family, y, penalty in (("binomial", "b", P.MCP()), ("multinomial", "k", P.GroupLasso())):
        one, two = (fit_path(far, features, y, penalty, family=family, lambdas=[0.03], max_outer=3, driver_cells=cells) for cells in (20_000_000, 0))
        assert np.abs(one.coefs).max() > 0.05 and np.allclose(one.coefs, two.coefs, atol=1e-6)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before  # nothing stays behind


@pytest.mark.parametrize("name", ["AdaptiveMCPPathCV", "AdaptiveLassoPathCV"])
def test_adaptive_cross_validation_takes_the_pilot_options(frame, name):
    est = estimator(name, n_lambdas=5, eta=2.0, eps=1e-4, pilot_index="last").fit(frame, X, "y", fold="fold")
    assert est.cv_.scores.shape == (5, 5) and np.abs(est.result_.coefs[-1][:3]).min() > 0.3


def test_a_penalty_of_ones_own_is_asked_for_its_map():
    from ridgeline.operators.solver import Problem, solve

    class Ridge:
        kind, l1, gamma = "scalar", 1.0, 3.0  # an attribute that another penalty has, too

        def prox(self, z, t, lam, w):
            return z / (1 + t * lam * w)

    beta, _, ok = solve(Problem(np.eye(2), np.array([2.0, 1.0]), Ridge(), np.ones(2)), 1.0, np.zeros(2))
    assert ok and np.allclose(beta, [1.0, 0.5])


@pytest.mark.parametrize("family", ["binomial", "poisson", "cox", "multinomial", "tasks"])
def test_stability_of_other_families_finds_the_planted_features(spark, family):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 5))
    eta = 1.5 * x[:, 0] - 1.5 * x[:, 1]
    y = {
        "binomial": (rng.random(600) < 1 / (1 + np.exp(-eta))).astype(float),
        "poisson": rng.poisson(np.exp(eta / 3)).astype(float),
        "cox": rng.exponential(np.exp(-eta)),
        "multinomial": np.argmax(np.column_stack([eta, np.zeros(600), -eta]) + rng.gumbel(size=(600, 3)), axis=1).astype(float),
        "tasks": eta + rng.standard_normal(600),
    }[family]
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(5)]).assign(y=y, y2=y + x[:, 0], event=1.0, id=range(600))
    features = [f"f{i}" for i in range(5)]
    row_groups = family in ("multinomial", "tasks")
    sel = StabilitySelection(P.GroupLasso() if row_groups else P.Lasso(), resamples=6, n_lambdas=4, lambda_min_ratio=0.4, family="gaussian" if family == "tasks" else family)
    sel.fit(spark.createDataFrame(pdf), features, ["y", "y2"] if family == "tasks" else "y", "id", event="event" if family == "cox" else None)
    assert sel.probabilities_.shape == (4, 5) and (sel.probabilities_[0] <= sel.probabilities_[-1]).all()
    assert sel.stable_[:2].all() and not sel.stable_[2:].any()


def test_groups_are_stable_as_a_whole():
    coefs = np.array([[0.0, 1.0, 0.0], [0.0, 0.0, 0.0]])
    assert on_path(coefs, np.array([0, 0, 1])).tolist() == [[True, True, False], [False] * 3]
    assert on_path(coefs[:, :, None] * np.array([0.0, 1.0])).tolist() == [[False, True, False], [False] * 3]


def test_mfdr_selects_the_densest_lambda_within_the_target(frame):
    path = fit_path(frame, X, "y", P.Lasso(), n_lambdas=20, lambda_min_ratio=0.01)
    rates = MFDR(path).fit(frame, X, "y")
    index, rate = rates.select(0.1)
    assert rate <= 0.1 and (rates.mfdr_[index + 1 :] > 0.1).all()
    with pytest.raises(ValueError):
        rates.select(-1.0)
