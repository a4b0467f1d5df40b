"""Paths over so many features that their products don't fit the driver: gradients of all, moments of a working set."""

from __future__ import annotations

import time as clock
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.moments import _sum_blocks, feature_names, matrix, moments
from ridgeline.operators.paths import PathResult, _vector
from ridgeline.operators.solver import Problem, lambda_grid, solve

#: Numbers in one piece of a vector that a partition sends.
PIECE = 1 << 17
MAX_ROUNDS = 50


def _column_sums(rows: DataFrame, p: int, of) -> np.ndarray:
    """The sum over rows of a (k, p) array that `of` makes of a batch's (x, y); vectors travel in pieces and are added per piece."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(matrix(batch.column("_x"), p), batch.column("_y").to_numpy(zero_copy_only=False))
            total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            for b in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([b // PIECE], pa.int32()), pa.array([flat[b : b + PIECE].tobytes()], pa.binary())], names=["key", "block", "part"])

    found = {r["block"]: np.frombuffer(r["part"], np.float64) for r in _sum_blocks(rows.mapInArrow(partial, "key long, block int, part binary")).collect()}
    return np.concatenate([found[b] for b in sorted(found)]).reshape(-1, p) if found else np.zeros((0, p))


def wide_path(df: DataFrame, features: str, y: str, penalty, *, lambdas=None, n_lambdas: int = 20, lambda_min_ratio: float = 0.05, weights=None, add: int = 100, tol: float = 1e-9) -> PathResult:
    """Least squares with a scalar penalty over an array column, in memory of working set squared plus features.

    At each lambda the problem is solved on a working set, from moments of those columns alone; a pass over all
    columns gives the gradient, and the worst offenders against the optimality conditions join the set until there is none.
    """
    terms = feature_names(df, features)
    p = len(terms)
    w = _vector(weights, p) * penalty.l1
    rows = df.select(F.col(features).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    rows = rows.filter((F.size("_x") == p) & ~F.exists("_x", lambda v: v.isNull())).persist()
    n, mean_y = rows.agg(F.count("*"), F.avg("_y")).first()
    first = _column_sums(rows, p, lambda x, v: np.vstack([x.sum(axis=0), x.T @ (v - mean_y)]))
    mean_x, grad = first[0] / n, first[1] / n
    top = float(np.max(np.abs(grad)[w > 0] / w[w > 0], initial=0.0))
    grid = np.sort(np.asarray(lambdas, float))[::-1] if lambdas is not None else lambda_grid(top, n_lambdas, lambda_min_ratio)

    def gradient(beta: np.ndarray) -> np.ndarray:
        b0 = mean_y - mean_x @ beta
        return _column_sums(rows, p, lambda x, v: (x.T @ (v - b0 - x @ beta))[None])[0] / n

    beta, work, coefs, info, m = np.zeros(p), np.flatnonzero(w == 0), [], [], None
    for lam in grid:
        began, total, ok = clock.perf_counter_ns(), 0, False
        for _ in range(MAX_ROUNDS):
            if len(work):
                if m is None:
                    pick = F.array(*[F.get("_x", F.lit(int(j))) for j in work]).alias("_w")
                    m = moments(rows.select(pick, "_y"), "_w", ["_y"], names=tuple(terms[j] for j in work))
                a, k = m.centered(), len(work)
                b, iters, _ = solve(Problem(a[:k, :k], a[:k, k], penalty, _vector(weights, p)[work]), float(lam), beta[work], tol=tol)
                beta = np.zeros(p)
                beta[work] = b
                total += iters
                grad = gradient(beta)
            over = np.abs(grad) - lam * w
            over[work] = -np.inf
            bad = np.flatnonzero(over > 1e-9 * max(1.0, top))
            if not len(bad):
                ok = True
                break
            work, m = np.sort(np.concatenate([work, bad[np.argsort(-over[bad])][:add]])), None
        coefs.append(beta)
        info.append({"iters": total, "converged": ok, "loss": float("nan"), "ns": clock.perf_counter_ns() - began})
    rows.unpersist()
    coefs = np.array(coefs)
    return PathResult("gaussian", terms, grid, coefs, mean_y - coefs @ mean_x, info)
