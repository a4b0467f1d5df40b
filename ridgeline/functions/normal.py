"""Normal distribution on the driver: Spark SQL has neither erf nor its inverse."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_STANDARD = NormalDist()
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def quantile(p: float) -> float:
    return _STANDARD.inv_cdf(min(max(p, 1e-15), 1 - 1e-15))


def cdf_array(x: np.ndarray) -> np.ndarray:
    return np.vectorize(cdf, otypes=[float])(x)


def bivariate_cdf(h: float, k: float, rho: float) -> float:
    """P(X <= h, Y <= k) at correlation rho: Plackett's derivative in rho integrated by Gauss-Legendre over the arcsine."""
    h, k = max(min(h, 8.0), -8.0), max(min(k, 8.0), -8.0)
    top = math.asin(max(min(rho, 1 - 1e-12), -1 + 1e-12))
    angle = top / 2 * (_NODES + 1)
    sine, cosine2 = np.sin(angle), np.cos(angle) ** 2
    inner = np.exp(-(h * h + k * k - 2 * h * k * sine) / (2 * cosine2))
    return cdf(h) * cdf(k) + float(top / 2 * (_WEIGHTS * inner).sum()) / (2 * math.pi)


def minimize_bounded(f, low: float, high: float, tol: float = 1e-6, steps: int = 200) -> float:
    """Golden-section search; f has one minimum in [low, high]."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if b - a < tol:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2
