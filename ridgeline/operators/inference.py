"""Debiased lassos: confidence intervals from one weighted Gram matrix and nodewise regressions on its minors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ridgeline.functions import normal
from ridgeline.operators.moments import moments
from ridgeline.operators.paths import LocalRows, Spec, path_from_moments, reweighted_path, rows_of
from ridgeline.operators.penalties import Lasso
from ridgeline.operators.solver import Problem, solve


@dataclass
class DebiasedResult:
    terms: tuple[str, ...]
    lasso: np.ndarray
    estimate: np.ndarray
    std_error: np.ndarray
    alpha: float

    def table(self, spark: SparkSession) -> DataFrame:
        q = normal.quantile(1 - self.alpha / 2)
        rows = []
        for t, b0, b, s in zip(self.terms, self.lasso, self.estimate, self.std_error, strict=True):
            z = b / s if s > 0 else 0.0
            rows.append((t, float(b0), float(b), float(s), float(b - q * s), float(b + q * s), float(2 * (1 - normal.cdf(abs(z))))))
        return spark.createDataFrame(rows, "term string, lasso double, estimate double, std_error double, lower double, upper double, p_value double")


def nodewise(gram: np.ndarray, lam: float) -> np.ndarray:
    """Approximate inverse of the Gram matrix: row j from the lasso of feature j on the others, all from minors of the Gram."""
    p = len(gram)
    theta = np.zeros((p, p))
    for j in range(p):
        rest = [i for i in range(p) if i != j]
        g, c = gram[np.ix_(rest, rest)], gram[rest, j]
        b, _, _ = solve(Problem(g, c, Lasso(), np.ones(p - 1)), lam, np.zeros(p - 1))
        tau = gram[j, j] - 2 * b @ c + b @ g @ b + lam * np.abs(b).sum()
        theta[j, j] = 1.0
        theta[j, rest] = -b
        theta[j] /= max(tau, 1e-12)
    return theta


def default_lambda(p: int, n: float) -> float:
    return math.sqrt(2 * math.log(max(p, 2)) / n)


def debiased_lasso(df: DataFrame, features: list[str] | str, y: str, *, lam: float | None = None, lam_nodewise: float | None = None, alpha: float = 0.05, standardize: bool = True, weight: str | None = None) -> DebiasedResult:
    """Least squares, from one pass: the score X'r needs no residuals, only moments."""
    m = moments(df, features, [y], weight=weight)
    n, p = m.n, m.p
    a = m.centered()
    s = np.sqrt(np.diag(a)[:p]) if standardize else np.ones(p)
    s = np.where(s > 1e-12, s, 1.0)
    gram, cross, yy = a[:p, :p] / np.outer(s, s), a[:p, p] / s, a[p, p]
    lam = default_lambda(p, n) if lam is None else lam
    beta, _, _ = solve(Problem(gram, cross, Lasso(), np.ones(p)), lam, np.zeros(p))
    theta = nodewise(gram, default_lambda(p, n) if lam_nodewise is None else lam_nodewise)
    sigma2 = max(yy - 2 * beta @ cross + beta @ gram @ beta, 0.0) * n / max(n - np.count_nonzero(beta), 1)
    estimate = beta + theta @ (cross - gram @ beta)
    error = np.sqrt(sigma2 * np.diag(theta @ gram @ theta.T) / n)
    return DebiasedResult(m.names, beta / s, estimate / s, error / s, alpha)


def debiased_glm(df: DataFrame, features: list[str] | str, y: str, family: str, *, event: str | None = None, offset: str | None = None, ties: str = "breslow", lam: float | None = None, lam_nodewise: float | None = None, alpha: float = 0.05, standardize: bool = True) -> DebiasedResult:
    """Logistic, Poisson and Cox: the working weights' Gram matrix and score at the lasso fit, from one more round."""
    rows, names = rows_of(df, features, y, second=event, offset=offset)
    p = len(names)
    spec = Spec(Lasso(), names, standardize=standardize)
    options = {"ties": ties} if family == "cox" else {}
    m, _ = rows.round(family, np.zeros(p), 0.0, options)
    lam = default_lambda(p, m.n) if lam is None else lam
    if standardize:
        scale = rows.x.std(axis=0) if isinstance(rows, LocalRows) else np.sqrt(np.diag(moments(rows.df, rows.features, names=names).centered())[:p])
        scale = np.where(scale > 1e-12, scale, 1.0)
        spec.w = scale  # the penalty is on standardized coefficients
    else:
        scale = np.ones(p)
    path = reweighted_path(rows, spec, family, lambdas=[lam], max_outer=20, **options)
    beta, b0 = path.coefs[0], path.intercepts[0]
    m, _ = rows.round(family, beta, b0, options)
    a = m.about(0.0) if family == "cox" else m.centered()
    gram = a[:p, :p] / np.outer(scale, scale)
    # Weighted residuals of the working response are the score.
    score = (a[:p, p] - a[:p, :p] @ beta) / scale
    theta = nodewise(gram, default_lambda(p, m.n) if lam_nodewise is None else lam_nodewise)
    estimate = beta * scale + theta @ score
    error = np.sqrt(np.maximum(np.diag(theta @ gram @ theta.T), 0.0) / m.n)
    return DebiasedResult(names, beta, estimate / scale, error / scale, alpha)


def refit_unpenalized(df: DataFrame, features: list[str], y: str) -> np.ndarray:
    """Least squares on chosen features, for comparison."""
    return path_from_moments(moments(df, features, [y]), Spec(Lasso(), tuple(features)), lambdas=[0.0]).coefs[0]
