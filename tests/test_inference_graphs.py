"""Debiased intervals, graphs, ordinal correlations, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import normal
from ridgeline.functions import testing as T
from ridgeline.operators import graphs as G
from ridgeline.operators import ordinal as O
from ridgeline.operators import penalties as P
from ridgeline.operators.inference import debiased_glm, debiased_lasso
from ridgeline.operators.moments import moments


@pytest.fixture(scope="module")
def normals(spark):
    rng = np.random.default_rng(5)
    theta = np.eye(5) + 0.4 * (np.eye(5, k=1) + np.eye(5, k=-1))
    x = rng.multivariate_normal(np.zeros(5), np.linalg.inv(theta), 1500)
    y = 1.0 * x[:, 0] - 0.7 * x[:, 3] + rng.standard_normal(1500)
    b = (rng.random(1500) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    t = rng.exponential(np.exp(-x[:, 0]))
    rows = [(i, *map(float, x[i]), float(y[i]), float(b[i]), float(t[i]), 1, i % 2) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y double, z double, t double, ev int, pop int").cache()


F5 = ["a", "b", "c", "d", "e"]


def test_debiased_intervals_cover(spark, normals):
    rows = {r["term"]: r for r in debiased_lasso(normals, F5, "y").table(spark).collect()}
    for term, truth in (("a", 1.0), ("b", 0.0), ("d", -0.7)):
        assert rows[term]["lower"] - 0.05 <= truth <= rows[term]["upper"] + 0.05
    assert rows["a"]["p_value"] < 1e-6
    for family, y in (("binomial", "z"), ("cox", "t")):
        got = debiased_glm(normals, F5, y, family, event="ev" if family == "cox" else None)
        assert abs(got.estimate[0] - 1.0) < 0.25 and np.isfinite(got.std_error).all()


def test_graphical_lasso_finds_the_chain(normals):
    model = G.GraphicalLasso(0.08, diag_offset=0.0).fit(normals, F5)
    edges = np.abs(model.precision_) > 1e-8
    assert all(edges[i, i + 1] for i in range(4)) and model.converged_
    off = G.glasso(np.array([[1.0, 0.5], [0.5, 1.0]]), 0.1)[0]
    assert np.allclose(off, np.linalg.inv([[1.1, 0.4], [0.4, 1.1]]), atol=1e-6)
    assert np.allclose(G.GraphicalMCP(1e-9, diag_offset=0.0).fit(normals, F5).precision_, np.linalg.inv(model.sample_covariance_), atol=1e-3)


def test_joint_selection_bootstrap(spark, normals):
    joint = G.JointGraphicalLasso(30.0).fit(normals, F5, "pop")
    assert len(joint.precisions_) == 2 and all(np.linalg.eigvalsh(t)[0] > 0 for t in joint.precisions_)
    m = moments(normals, F5)
    path = G.ebic_path(spark, m, [0.3, 0.1, 0.05], P.Lasso()).orderBy("lambda_idx").collect()
    assert [r["edges"] for r in path] == sorted(r["edges"] for r in path)
    boot = G.GraphicalBootstrap(0.05, resamples=40).fit(normals, F5, "id")
    kept = {(r["i"], r["j"]) for r in boot.fdr_threshold(0.1).filter("edge").collect()}
    assert {(0, 1), (1, 2), (2, 3), (3, 4)} <= kept
    assert boot.summary().count() == 15 and boot.fwer_threshold().count() == 10
    stable = G.GraphicalStabilitySelection([0.15], resamples=20).fit(normals, F5, "id")
    assert stable.probabilities_[0, 1] > 0.9 and 0.5 < stable.mb_threshold(5.0) <= 1.0


def test_normal_functions():
    assert abs(normal.bivariate_cdf(0, 0, 0.5) - (0.25 + np.arcsin(0.5) / (2 * np.pi))) < 1e-10
    assert abs(normal.bivariate_cdf(0.3, -0.4, 0.0) - normal.cdf(0.3) * normal.cdf(-0.4)) < 1e-12
    assert abs(normal.cdf(normal.quantile(0.975)) - 0.975) < 1e-12


def test_ordinal_correlations(spark):
    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 4000)
    rows = [(int(np.digitize(a, [-1, 0, 1])), int(np.digitize(b, [-0.5, 0.5])), float(b)) for a, b in x] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "o int, p int, c double")
    assert abs(O.polychoric_correlation(df, ["o", "p"])[0, 1] - 0.6) < 0.04
    assert abs(O.polyserial_correlation(df, "o", "c") - 0.6) < 0.04
    mixed = O.mixed_correlation(df, ["o", "c"])
    assert np.allclose(mixed, mixed.T) and abs(mixed[0, 1] - 0.6) < 0.04
    assert np.isnan(O.polyserial_correlation(df.limit(2), "o", "c"))


def test_polyserial_keeps_far_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_t(1.2, 6000)
    o = np.digitize(np.sign(x) * np.log1p(np.abs(x)) + rng.standard_normal(6000), [-1, 0, 1])
    z = (x - x.mean()) / x.std(ddof=1)
    assert np.abs(z).max() > 30
    cuts = np.concatenate([[-8.0], O.thresholds(np.bincount(o)), [8.0]])

    def loss(rho):
        root = np.sqrt(1 - rho * rho)
        chance = normal.cdf_array((cuts[o + 1] - rho * z) / root) - normal.cdf_array((cuts[o] - rho * z) / root)
        return -np.log(np.maximum(chance, 1e-12)).sum()

    df = spark.createDataFrame(list(zip(o.tolist(), x.tolist(), strict=True)), "o int, x double")
    assert abs(O.polyserial_correlation(df, "o", "x") - normal.minimize_bounded(loss, -1 + 1e-6, 1 - 1e-6)) < 1e-4


@pytest.mark.parametrize("by", [[], ["family"]])
def test_adjusted_p_values(spark, by):
    rng = np.random.default_rng(0)
    rows = [(i, ["a", "b", None][i % 3], float(np.round(rng.random() ** 3, 2))) for i in range(900)]
    rows += [(1000, "a", None), (1001, "b", float("nan")), (1002, "a", 0.0), (1003, "alone", 0.5)]
    df = spark.createDataFrame(rows, "id int, family string, p double")
    families = {}
    for i, f, p in rows:
        if p is not None and p == p:
            families.setdefault(f if by else 0, []).append((p, i))
    want = {"bh": {}, "holm": {}, "bonferroni": {}}
    for tests in families.values():
        tests.sort()
        m, held = len(tests), 1.0
        for k in range(m, 0, -1):
            held = min(held, tests[k - 1][0] * m / k)
            want["bh"][tests[k - 1][1]] = held
        held = 0.0
        for k, (p, i) in enumerate(tests, 1):
            held = max(held, p * (m - k + 1))
            want["holm"][i], want["bonferroni"][i] = min(1.0, held), min(1.0, p * m)
    for name, adjust in (("bh", T.bh_adjust), ("holm", T.holm_adjust), ("bonferroni", T.bonferroni_adjust)):
        made = adjust(df, "p", "q", by)
        assert made.columns == ["id", "family", "p", "q"] and adjust(df.limit(0), "p", "q", by).count() == 0
        got = {r["id"]: r["q"] for r in made.collect()}
        assert len(got) == len(rows) and got[1000] is None and got[1001] is None
        assert all(abs(got[i] - q) < 1e-12 for i, q in want[name].items())


def test_raw_matrices_and_triples(spark, tmp_path):
    from ridgeline.sources.readers import from_triples, read_matrix

    x = np.random.default_rng(0).standard_normal((50, 3))
    for name, dtype, order in (("a", "f8", "F"), ("b", "f4", "F"), ("c", "f8", "C")):
        x.astype(dtype).ravel(order=order).tofile(tmp_path / name)
        got = np.array([r["x"] for r in read_matrix(spark, str(tmp_path / name), 50, 3, dtype, order).orderBy("row").collect()])
        assert np.allclose(got, x, atol=1e-6)
    both = read_matrix(spark, [str(tmp_path / "a")] * 2, [50, 50], 3)
    assert both.count() == 100 and both.agg(F.max("row")).first()[0] == 99
    with pytest.raises(ValueError):
        read_matrix(spark, str(tmp_path / "a"), 51, 3)
    t = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, 1.0)], "row long, col int, value double")
    assert [r["x"] for r in from_triples(t, 2).orderBy("row").collect()] == [[0.0, 5.0], [1.0, 0.0]]
    want = [[0.0, 5.0], [1.0, 0.0], [0.0, 0.0]]
    assert [r["x"] for r in from_triples(t, 2, rows=3).orderBy("row").collect()] == want
    assert [r["x"] for r in from_triples(t, 2, rows=spark.range(3).withColumnRenamed("id", "row")).orderBy("row").collect()] == want


def test_streamed_moments_equal_batch(spark, normals, tmp_path):
    from ridgeline.streaming.running import RunningMoments

    normals.select(*F5, "y").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(normals.select(*F5, "y").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = RunningMoments(F5, ["y"], str(tmp_path / "sums"))
    running.start(stream, str(tmp_path / "check")).awaitTermination()
    whole = moments(normals, F5, ["y"])
    assert running.total(spark).n == whole.n and np.allclose(running.total(spark).centered(), whole.centered())
    again = RunningMoments(F5, ["y"], str(tmp_path / "sums"))  # as after a restart
    again.update(normals.limit(0), 2)  # the last batch once more, now empty, replaces itself
    assert again.total(spark).n < whole.n
    normals.select(*F5, "y").limit(7).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    n = again.total(spark).n
    again.start(stream, str(tmp_path / "check")).awaitTermination()
    assert again.total(spark).n == n + 7
    assert abs(running.fit(spark, P.Lasso(), lambdas=[0.01]).coefs[0][0] - 1.0) < 0.1


def test_public_surface(spark, normals):
    from ridgeline import api

    assert all(getattr(api, n) is not None for n in api.__all__)
    est = api.MCPPathRegressor(gamma=3.0, n_lambdas=5).fit(normals, F5, "y")
    assert est.result_.coefs.shape == (5, 5)
    rows = api.DebiasedLassoRegressor(alpha=0.1).fit(normals, F5, "y").confidence_intervals(normals)
    assert rows.count() == 5
    with pytest.raises(AttributeError):
        _ = api.NoSuchRegressor


def test_queries_use_the_whole_embedding_and_all_resamples(spark, monkeypatch):
    from ridgeline import queries
    from ridgeline.operators import graphs, selection

    seen = []
    for cls in (graphs.GraphicalBootstrap, graphs.GraphicalStabilitySelection, selection.StabilitySelection):
        fit = cls.fit
        monkeypatch.setattr(cls, "fit", lambda self, *a, fit=fit, **k: seen.append((type(self).__name__, self.resamples)) or fit(self, *a, **k))
    for name in ("graph_bootstrap", "graph_stability", "stability_probabilities"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [("GraphicalBootstrap", 200), ("GraphicalStabilitySelection", 100), ("StabilitySelection", 100)]
    assert graphs.GraphicalStabilitySelection([0.1]).resamples == 100
    assert queries.QUERIES["glasso_embeddings"](spark, "/root/testdata/sf0.001").count() == 64 * 65 // 2
