"""Sparse precision matrices: single and joint graphical models, their selection, stability and bootstrap inference."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.testing import bh_adjust, bonferroni_adjust, holm_adjust
from ridgeline.operators.moments import Moments, moments
from ridgeline.operators.penalties import MCP, SCAD, GroupLasso, GroupMCP, Lasso
from ridgeline.operators.selection import bootstrap_samples, fan_out, half_samples
from ridgeline.operators.solver import Problem, solve

EDGE_EPS = 1e-8


def covariance(m: Moments, assume_centered: bool = False) -> np.ndarray:
    """1/n covariance of the features."""
    f = m.features()
    return f.about(0.0) if assume_centered else f.centered()


def glasso(s: np.ndarray, lam: float, penalty=None, *, edge_weights: np.ndarray | None = None, diag_offset: float | None = None, tol: float = 1e-4, max_iter: int = 100, warm: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(precision, covariance estimate, converged): each column of the covariance is a penalised regression on the rest of it.

    The diagonal stays at s plus diag_offset (by default lam). Coefficients of a column start at its last ones.
    """
    penalty = penalty or Lasso()
    p = len(s)
    w = s.copy() if warm is None else warm.copy()
    if warm is None:
        w[np.diag_indices(p)] += lam if diag_offset is None else diag_offset
    if p == 1:
        return 1 / w, w, True
    weights = np.ones((p, p)) if edge_weights is None else edge_weights
    betas, rests, ok = np.zeros((p, p)), [np.delete(np.arange(p), k) for k in range(p)], False
    for _ in range(max_iter):
        before = w.copy()
        for k, rest in enumerate(rests):
            prob = Problem(w[np.ix_(rest, rest)], s[rest, k], penalty, weights[rest, k])
            b, _, _ = solve(prob, lam, betas[k, rest], tol=min(1e-7, tol * 1e-3))
            betas[k, rest] = b
            w[rest, k] = w[k, rest] = prob.gram @ b
        if np.abs(w - before).max() < tol:
            ok = True
            break
    theta = np.zeros((p, p))
    for k, rest in enumerate(rests):
        theta[k, k] = 1 / (w[k, k] - w[rest, k] @ betas[k, rest])
        theta[k, rest] = -betas[k, rest] * theta[k, k]
    return (theta + theta.T) / 2, w, ok


def logdet_prox(v: np.ndarray, rho: float, c: float) -> np.ndarray:
    """argmin of -c logdet(T) + rho/2 |T|^2 - <v, T>: eigenvalues (d + sqrt(d^2 + 4 rho c)) / (2 rho)."""
    d, q = np.linalg.eigh((v + v.T) / 2)
    return (q * ((d + np.sqrt(d * d + 4 * rho * c)) / (2 * rho))) @ q.T


def joint_glasso(covs: list[np.ndarray], ns: list[float], lam: float, penalty=None, *, diag_offset: float = 0.0, rho: float = 1.0, tol: float = 1e-5, max_iter: int = 200, edge_weights: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """(precisions, their sparse copies, converged) over populations, an edge's values being one group; alternating directions.

    The precisions are positive definite; the copies hold exact zeros and say which edges there are.
    """
    penalty = penalty or GroupLasso()
    p, k = len(covs[0]), len(covs)
    s = np.stack(covs) + diag_offset * np.eye(p)
    n = np.asarray(ns, float)
    theta, z, u = (np.stack([m] * k) for m in (np.eye(p), np.eye(p), np.zeros((p, p))))
    upper = np.triu_indices(p, 1)
    weights = np.ones(len(upper[0])) if edge_weights is None else edge_weights[upper]
    ones, ok = np.ones(k), False
    for _ in range(max_iter):
        last = z.copy()
        for i in range(k):
            theta[i] = logdet_prox(rho * (z[i] - u[i]) - n[i] * s[i], rho, n[i])
        point = theta + u
        z = point.copy()
        for e, (i, j) in enumerate(zip(*upper, strict=True)):
            z[:, i, j] = z[:, j, i] = penalty.prox_group(point[:, i, j], 1 / rho, lam, weights[e], ones)
        u += theta - z
        size = math.sqrt(k * p * p)
        if np.linalg.norm(theta - z) / size < tol and rho * np.linalg.norm(z - last) / size < tol:
            ok = True
            break
    return list(theta), list(z), ok


def log_likelihood(theta: np.ndarray, s: np.ndarray, n: float) -> float:
    return n / 2 * (np.linalg.slogdet(theta)[1] - float(np.sum(s * theta)))


def edge_count(theta: np.ndarray, eps: float = EDGE_EPS) -> int:
    return int((np.abs(theta[np.triu_indices(len(theta), 1)]) > eps).sum())


def precision_rows(spark: SparkSession, theta: np.ndarray, terms: tuple[str, ...]) -> DataFrame:
    """(i, j, term_i, term_j, value), the upper triangle with the diagonal."""
    rows = [(i, j, terms[i], terms[j], float(theta[i, j])) for i in range(len(theta)) for j in range(i, len(theta))]
    return spark.createDataFrame(rows, "i int, j int, term_i string, term_j string, value double")


@dataclass
class GraphicalModel:
    """Precision matrix of feature columns, or of a covariance given as such. penalty: Lasso(), MCP() or SCAD()."""

    lam: float = 0.1
    penalty: object = field(default_factory=Lasso)
    diag_offset: float | None = None
    assume_centered: bool = False
    tol: float = 1e-4

    def fit(self, df: DataFrame, features: list[str] | str) -> GraphicalModel:
        m = moments(df, features)
        self.n_, self.terms_ = m.n, m.names
        return self.fit_covariance(covariance(m, self.assume_centered))

    def fit_covariance(self, s: np.ndarray) -> GraphicalModel:
        self.sample_covariance_ = s
        self.precision_, self.covariance_, self.converged_ = glasso(s, self.lam, self.penalty, diag_offset=self.diag_offset, tol=self.tol)
        return self


def GraphicalLasso(alpha: float = 0.1, **kwargs) -> GraphicalModel:  # noqa: N802
    return GraphicalModel(alpha, Lasso(), **kwargs)


def GraphicalMCP(alpha: float = 0.1, gamma: float = 3.0, **kwargs) -> GraphicalModel:  # noqa: N802
    return GraphicalModel(alpha, MCP(gamma), **kwargs)


def GraphicalSCAD(alpha: float = 0.1, a: float = 3.7, **kwargs) -> GraphicalModel:  # noqa: N802
    return GraphicalModel(alpha, SCAD(a), **kwargs)


@dataclass
class JointGraphicalModel:
    """Precision matrices of several populations, numbered in a column, with edges shared by a group penalty."""

    lam: float = 0.1
    penalty: object = field(default_factory=GroupLasso)
    diag_offset: float = 0.0
    rho: float = 1.0
    tol: float = 1e-5

    def fit(self, df: DataFrame, features: list[str] | str, population: str) -> JointGraphicalModel:
        parts = moments(df, features, by=population)
        self.populations_ = sorted(parts)
        self.terms_ = parts[self.populations_[0]].names
        self.ns_ = [parts[k].n for k in self.populations_]
        self.covariances_ = [covariance(parts[k]) for k in self.populations_]
        self.precisions_, self.supports_, self.converged_ = joint_glasso(self.covariances_, self.ns_, self.lam, self.penalty, diag_offset=self.diag_offset, rho=self.rho, tol=self.tol)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(k), i, j, float(t[i, j]), bool(i == j or abs(z[i, j]) > EDGE_EPS)) for k, t, z in zip(self.populations_, self.precisions_, self.supports_, strict=True) for i in range(len(t)) for j in range(i, len(t))]
        return spark.createDataFrame(rows, "population int, i int, j int, value double, edge boolean")


def JointGraphicalLasso(lambda_2: float = 0.1, **kwargs) -> JointGraphicalModel:  # noqa: N802
    return JointGraphicalModel(lambda_2, GroupLasso(), **kwargs)


def JointGraphicalMCP(lambda_2: float = 0.1, gamma: float = 3.0, **kwargs) -> JointGraphicalModel:  # noqa: N802
    return JointGraphicalModel(lambda_2, GroupMCP(gamma), **kwargs)


def ebic_path(spark: SparkSession, m: Moments, lambdas, penalty=None, gamma: float = 0.5, **kwargs) -> DataFrame:
    """(lambda, edges, log_likelihood, ebic, best): one independent task per lambda."""
    s, n, p = covariance(m), m.n, m.p

    def one(number: int, data: bytes) -> pa.Table:
        lam = float(lambdas[number])
        theta, _, _ = glasso(s, lam, penalty, **kwargs)
        e, ll = edge_count(theta), log_likelihood(theta, s, n)
        return pa.table({"lambda_idx": pa.array([number], pa.int32()), "lambda": [lam], "edges": pa.array([e], pa.int32()), "log_likelihood": [ll], "ebic": [-2 * ll + e * math.log(n) + 4 * gamma * e * math.log(p)]})

    out = fan_out(spark, [(i, b"") for i in range(len(lambdas))], one, "lambda_idx int, lambda double, edges int, log_likelihood double, ebic double")
    return out


def joint_ebic_path(spark: SparkSession, parts: dict[int, Moments], lambdas, penalty=None, gamma: float = 0.5, **kwargs) -> DataFrame:
    """As ebic_path, with the union of the populations' edges and all their rows."""
    keys = sorted(parts)
    covs, ns, p = [covariance(parts[k]) for k in keys], [parts[k].n for k in keys], parts[keys[0]].p

    def one(number: int, data: bytes) -> pa.Table:
        lam = float(lambdas[number])
        thetas, supports, _ = joint_glasso(covs, ns, lam, penalty, **kwargs)
        e = edge_count(np.max(np.abs(supports), axis=0))
        ll = sum(log_likelihood(t, s, n) for t, s, n in zip(thetas, covs, ns, strict=True))
        return pa.table({"lambda_idx": pa.array([number], pa.int32()), "lambda": [lam], "edges": pa.array([e], pa.int32()), "log_likelihood": [ll], "ebic": [-2 * ll + e * math.log(sum(ns)) + 4 * gamma * e * math.log(p)]})

    return fan_out(spark, [(i, b"") for i in range(len(lambdas))], one, "lambda_idx int, lambda double, edges int, log_likelihood double, ebic double")


def mb_stability_threshold(p_total: int, q: float, expected_false: float) -> float:
    """Share of subsamples that keeps expected false positives at a bound: (1 + q^2 / (p E)) / 2."""
    out = 0.5 * (1 + q * q / (p_total * expected_false))
    if out > 1:
        raise ValueError("no threshold up to 1 keeps that bound")
    return out


@dataclass
class GraphicalStabilitySelection:
    lambdas: list[float]
    penalty: object = field(default_factory=Lasso)
    resamples: int = 100
    threshold: float = 0.6
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str] | str, row_id: str) -> GraphicalStabilitySelection:
        parts = moments(df, features, resamples=(half_samples(self.resamples, self.seed), F.col(row_id)))
        self.terms_ = next(iter(parts.values())).names
        lambdas, penalty = self.lambdas, self.penalty

        def one(number: int, data: bytes) -> pa.Table:
            s = pickle.loads(data)
            found = []
            for k, lam in enumerate(lambdas):
                theta, _, _ = glasso(s, lam, penalty)
                i, j = np.nonzero(np.triu(np.abs(theta) > 1e-6, 1))
                found += [(number, k, a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            return pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("sample", "lambda_idx", "i", "j"), cols, strict=True)})

        hits = fan_out(df.sparkSession, [(b, pickle.dumps(covariance(m))) for b, m in parts.items()], one, "sample int, lambda_idx int, i int, j int")
        share = hits.groupBy("lambda_idx", "i", "j").agg((F.countDistinct("sample") / self.resamples).alias("share"))
        rows = share.collect()
        self.q_ = sum(r["share"] for r in rows) / len(lambdas)
        best: dict[tuple[int, int], float] = {}
        for r in rows:
            best[r["i"], r["j"]] = max(best.get((r["i"], r["j"]), 0.0), r["share"])
        self.probabilities_ = best
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, j, float(q), q >= self.threshold) for (i, j), q in sorted(self.probabilities_.items())]
        return spark.createDataFrame(rows, "i int, j int, probability double, stable boolean")

    def mb_threshold(self, expected_false: float) -> float:
        p = len(self.terms_)
        return mb_stability_threshold(p * (p - 1) // 2, self.q_, expected_false)


@dataclass
class GraphicalBootstrap:
    lam: float = 0.1
    penalty: object = field(default_factory=Lasso)
    resamples: int = 200
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str] | str, row_id: str) -> GraphicalBootstrap:
        """replicates_: (sample, i, j, value) of every resample's precision, upper triangle with the diagonal."""
        parts = moments(df, features, resamples=(bootstrap_samples(self.resamples, self.seed), F.col(row_id)))
        lam, penalty = self.lam, self.penalty

        def one(number: int, data: bytes) -> pa.Table:
            theta, _, _ = glasso(pickle.loads(data), lam, penalty)
            i, j = np.triu_indices(len(theta))
            return pa.table({"sample": pa.array(np.full(len(i), number), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": theta[i, j]})

        self.replicates_ = fan_out(df.sparkSession, [(b, pickle.dumps(covariance(m))) for b, m in parts.items()], one, "sample int, i int, j int, value double")
        return self

    def summary(self, alpha: float = 0.05) -> DataFrame:
        return self.replicates_.groupBy("i", "j").agg(
            F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", F.lit(alpha / 2)).alias("lower"), F.percentile("value", F.lit(1 - alpha / 2)).alias("upper"), F.avg((F.abs("value") > EDGE_EPS).cast("double")).alias("edge_probability")
        )

    def fdr_threshold(self, fdr: float = 0.1, by: list[str] | None = None) -> DataFrame:
        return edge_fdr(edge_pvalues(self.replicates_), fdr, by)

    def fwer_threshold(self, fwer: float = 0.05, method: str = "holm") -> DataFrame:
        return edge_fwer(edge_pvalues(self.replicates_), fwer, method)


def edge_pvalues(replicates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(i, j, p_value): twice the smaller count of values on either side of zero over the resamples, in [2/B, 1]; 1 on the diagonal."""
    g = replicates.groupBy(*(keys or []), "i", "j").agg(F.sum((F.col("value") >= 0).cast("int")).alias("_up"), F.sum((F.col("value") <= 0).cast("int")).alias("_down"), F.count("*").alias("_b"))
    raw = F.least(F.lit(1.0), F.greatest(2 / F.col("_b"), 2 * F.least("_up", "_down") / F.col("_b")))
    return g.select(*(keys or []), "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(raw).alias("p_value"))


def edge_fdr(pvalues: DataFrame, fdr: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """Off-diagonal edges with Benjamini-Hochberg p-values; several populations are pooled unless `by` names them."""
    return bh_adjust(pvalues.filter("i < j"), by=by).withColumn("edge", F.col("p_adjusted") <= fdr)


def edge_fwer(pvalues: DataFrame, fwer: float = 0.05, method: str = "holm", by: list[str] | None = None) -> DataFrame:
    adjust = {"holm": holm_adjust, "bonferroni": bonferroni_adjust}[method]
    return adjust(pvalues.filter("i < j"), by=by).withColumn("edge", F.col("p_adjusted") <= fwer)
