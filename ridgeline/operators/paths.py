"""Regularization paths: moments from Spark, solved on the driver; one more pass over the data per reweighting round."""

from __future__ import annotations

import math
import time as clock
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import links
from ridgeline.operators import cox
from ridgeline.operators.moments import NARROW, Moments, _partials, _sum_blocks, _wide, _wide_means, feature_names, matrix, moments, narrow_pass
from ridgeline.operators.solver import Problem, convex_min_index, lambda_grid, solve

#: Reweighted fits of at most this many numbers run on rows held by the driver; larger ones make a Spark pass per round.
LOCAL_CELLS = 20_000_000
MAX_OUTER = 50
OUTER_TOL = 1e-7


@dataclass
class PathResult:
    """Coefficients along descending lambdas: coefs (L, p), or (L, p, K) for K tasks or classes."""

    datafit: str
    terms: tuple[str, ...]
    lambdas: np.ndarray
    coefs: np.ndarray
    intercepts: np.ndarray
    info: list[dict]
    labels: tuple = ()
    convex_min: int | None = None
    options: dict = field(default_factory=dict)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(lambda_idx, lambda, term, coef), with the column label for tasks and classes; the intercept is the term "(intercept)"."""
        rows = []
        for i, lam in enumerate(self.lambdas):
            c, b = self.coefs[i], self.intercepts[i]
            for k in range(c.shape[1] if c.ndim == 2 else 1):
                head = (i, float(lam)) + ((str(self.labels[k]),) if c.ndim == 2 else ())
                rows.append((*head, "(intercept)", float(b[k] if c.ndim == 2 else b)))
                rows += [(*head, t, float(v)) for t, v in zip(self.terms, c[:, k] if c.ndim == 2 else c, strict=True)]
        label = "label string, " if self.coefs.ndim == 3 else ""
        return spark.createDataFrame(rows, f"lambda_idx int, lambda double, {label}term string, coef double")

    def path_info(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(lam), d["iters"], bool(d["converged"]), float(d["loss"]), int(np.count_nonzero(np.abs(self.coefs[i]).reshape(len(self.terms), -1).any(axis=1))), int(d["ns"])) for i, (lam, d) in enumerate(zip(self.lambdas, self.info, strict=True))]
        return spark.createDataFrame(rows, "lambda_idx int, lambda double, iters int, converged boolean, loss double, n_active int, time_ns long")

    def at(self, index: int) -> dict[str, float]:
        return dict(zip(self.terms, self.coefs[index].tolist(), strict=True))


def _vector(value, p: int) -> np.ndarray:
    out = np.ones(p) if value is None else np.asarray(value, float)
    if out.shape != (p,) or (out < 0).any() or not np.isfinite(out).all():
        raise ValueError(f"weights must be {p} finite non-negative numbers")
    return out


def group_numbers(groups, terms: tuple[str, ...]) -> np.ndarray:
    """Labels 0..G-1 for each feature, from a sequence or a mapping by term; every number must occur."""
    labels = np.array([groups[t] for t in terms] if isinstance(groups, dict) else groups, int)
    if len(labels) != len(terms) or (len(labels) and sorted(set(labels)) != list(range(labels.max() + 1))):
        raise ValueError("groups must label every feature with 0..G-1 and leave no number out")
    return labels


@dataclass
class Spec:
    """Penalty and its structure, apart from data."""

    penalty: object
    terms: tuple[str, ...]
    weights: object = None
    groups: object = None
    coord_weights: object = None
    fit_intercept: bool = True
    standardize: bool = False

    def __post_init__(self):
        p = len(self.terms)
        self.by_group = self.penalty.kind == "group" or (self.penalty.kind == "lla" and hasattr(self.penalty, "tau")) or hasattr(self.penalty, "gamma1")
        self.number = group_numbers(self.groups, self.terms) if self.groups is not None else None
        if self.by_group and self.number is None:
            raise ValueError("this penalty needs groups")
        self.w = _vector(self.weights, int(self.number.max()) + 1 if self.by_group else p)
        self.v = _vector(self.coord_weights, p)

    def problem(self, gram: np.ndarray, cross: np.ndarray, scale: np.ndarray) -> Problem:
        """In scaled coefficients. Scalar weights are divided by the scale, so the penalty acts on original ones; group weights are not."""
        gram = gram / np.outer(scale, scale)
        cross = cross / (scale if cross.ndim == 1 else scale[:, None])
        scalar = not self.by_group and self.penalty.kind != "group"
        if self.penalty.kind == "lla":
            groups = self.number if self.number is not None else np.zeros(len(scale), int)
            w = self.w if self.by_group else np.ones(int(groups.max()) + 1)
            v = (self.v if self.by_group else self.w) / scale
            return Problem(gram, cross, self.penalty, w, groups, v)
        return Problem(gram, cross, self.penalty, self.w / scale if scalar else self.w, self.number, self.v)


def scales(m: Moments, standardize: bool) -> np.ndarray:
    if not standardize:
        return np.ones(m.p)
    s = np.sqrt(np.maximum(np.diag(m.centered())[: m.p] * m.n / m.mass, 0.0))
    return np.where(s > 1e-12, s, 1.0)


def _grid(prob_top: float, lambdas, n_lambdas: int, ratio: float) -> np.ndarray:
    if lambdas is not None:
        return np.sort(np.asarray(lambdas, float))[::-1]
    return lambda_grid(prob_top, n_lambdas, ratio)


def path_from_moments(m: Moments, spec: Spec, *, lambdas=None, n_lambdas: int = 100, lambda_min_ratio: float = 1e-3, tol: float = 1e-9, max_iter: int = 10_000) -> PathResult:
    """Least-squares path for one response, warm-started downwards. No pass over data."""
    a = m.centered() if spec.fit_intercept else m.about(0.0)
    s = scales(m, spec.standardize)
    gram, cross, yy = a[: m.p, : m.p], a[: m.p, m.p], a[m.p, m.p]
    prob = spec.problem(gram, cross, s)
    grid = _grid(prob.lambda_max() if lambdas is None else 0.0, lambdas, n_lambdas, lambda_min_ratio)
    beta, coefs, info = np.zeros(m.p), [], []
    for lam in grid:
        began = clock.perf_counter_ns()
        beta, iters, ok = solve(prob, float(lam), beta, tol=tol, sweeps=max_iter)
        b = beta / s
        coefs.append(b)
        info.append({"iters": iters, "converged": ok, "loss": float(yy - 2 * cross @ b + b @ gram @ b) / 2, "ns": clock.perf_counter_ns() - began})
    coefs = np.array(coefs).reshape(len(grid), m.p)
    mean = m.mean
    intercepts = mean[m.p] - coefs @ mean[: m.p] if spec.fit_intercept else np.zeros(len(grid))
    low = convex_min_index(prob.gram, coefs * s, spec.penalty, prob.groups if spec.penalty.kind == "group" else None)
    return PathResult("gaussian", spec.terms, grid, coefs, intercepts, info, convex_min=low)


def tasks_from_moments(m: Moments, spec: Spec, labels: tuple, *, lambdas=None, n_lambdas: int = 100, lambda_min_ratio: float = 1e-3, tol: float = 1e-9, max_iter: int = 10_000) -> PathResult:
    """Several responses with penalties on the rows of the coefficient matrix. The loss is divided by rows times tasks."""
    k = len(m.shift) - m.p
    a = (m.centered() if spec.fit_intercept else m.about(0.0)) / k
    s = scales(m, spec.standardize)
    prob = Problem(a[: m.p, : m.p] / np.outer(s, s), a[: m.p, m.p :] / s[:, None], spec.penalty, spec.w / s if spec.standardize else spec.w)
    grid = _grid(prob.lambda_max() if lambdas is None else 0.0, lambdas, n_lambdas, lambda_min_ratio)
    beta, coefs, info = np.zeros((m.p, k)), [], []
    for lam in grid:
        began = clock.perf_counter_ns()
        beta, iters, ok = solve(prob, float(lam), beta, tol=tol, sweeps=max_iter)
        b = beta / s[:, None]
        coefs.append(b)
        rss = np.trace(a[m.p :, m.p :]) - 2 * np.sum(b * a[: m.p, m.p :]) + np.sum(b * (a[: m.p, : m.p] @ b))
        info.append({"iters": iters, "converged": ok, "loss": float(rss) / 2, "ns": clock.perf_counter_ns() - began})
    coefs, mean = np.array(coefs), m.mean
    intercepts = mean[m.p :] - np.einsum("lpk,p->lk", coefs, mean[: m.p]) if spec.fit_intercept else np.zeros((len(grid), k))
    return PathResult("multitask", spec.terms, grid, coefs, intercepts, info, labels)


# --- reweighted fits -------------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def working(family: str, eta: np.ndarray, y: np.ndarray, offset: np.ndarray, options: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, weight, response) of rows; eta includes the offset, the response doesn't."""
    if family == "binomial":
        p = _sigmoid(eta)
        w = np.maximum(p * (1 - p), links.WEIGHT_FLOOR)
        return np.logaddexp(0, eta) - y * eta, w, eta - offset + (y - p) / w
    if family == "poisson":
        mu = np.exp(np.clip(eta, -links.ETA_CLAMP, links.ETA_CLAMP))
        w = np.maximum(mu, links.WEIGHT_FLOOR)
        return mu - y * eta, w, eta - offset + (y - mu) / w
    delta = options.get("delta", 1.35)
    r = np.abs(y - eta)
    return np.where(r <= delta, r * r / 2, delta * r - delta * delta / 2), np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-300)), y


class LocalRows:
    """Rows on the driver; their number is checked before."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: np.ndarray, second: np.ndarray | None = None):
        self.x, self.y, self.weight, self.offset, self.second = x, y, weight, offset, second
        self.centered = self.mean = None

    def close(self) -> None:
        self.centered = None

    def round(self, family: str, beta: np.ndarray, intercept: float, options: dict) -> tuple[Moments, float]:
        if self.centered is None:
            self.mean = self.x.mean(axis=0) if len(self.x) else np.zeros(self.x.shape[1])
            self.centered = self.x - self.mean
        x, p = self.centered, self.x.shape[1]
        eta = x @ beta + (self.mean @ beta + intercept) + self.offset
        if family == "cox":
            loss, w, z = cox.local_surrogate(eta, self.y, self.second, options.get("ties", "breslow"))
        else:
            rows, w, z = working(family, eta, self.y, self.offset, options)
            loss, w = float((self.weight * rows).sum()), w * self.weight
        wx, wz = x * w[:, None], w * z
        second = np.empty((p + 1, p + 1))
        second[:p, :p] = x.T @ wx
        second[:p, p] = second[p, :p] = x.T @ wz
        second[p, p] = wz @ z
        return Moments(len(z), w.sum(), np.append(self.mean, 0.0), np.append(wx.sum(axis=0), wz.sum()), second, p), loss


class SparkRows:
    """Rows as a persisted projection; every round is one aggregation (for Cox, with windows over distinct times)."""

    def __init__(self, df: DataFrame, features: list[str] | str, p: int):
        self.df, self.features, self.p = df, features, p
        self.narrow = not isinstance(features, str) and p <= NARROW
        self._center = None

    def close(self) -> None:
        self.df.unpersist()

    def center(self) -> np.ndarray:
        """A point near the rows, about which sums are taken, so that features far from 0 keep their digits."""
        if self._center is None:
            if self.narrow:
                self._center = np.array([x or 0.0 for x in self.df.agg(*[F.avg(c) for c in self.features]).first()])
            else:
                self._center = _wide_means(self.df.select(*_wide(self.features, [F.col("_y")])), self.p, 0)
        return self._center

    def round(self, family: str, beta: np.ndarray, intercept: float, options: dict) -> tuple[Moments, float]:
        if family == "cox":
            eta = self._eta(beta, 0.0)
            rows = cox.surrogate(self.df, "_y", "_second", eta, options.get("ties", "breslow"))
            m = moments(rows, self.features, ["_z"], weight="_w", names=tuple(map(str, range(self.p))))
            return m, cox.loss(self.df, "_y", "_second", eta, options.get("ties", "breslow")) * m.n
        if self.narrow:
            eta = self._eta(beta, intercept) + F.col("_offset")
            y = F.col("_y")
            made = links.binomial(eta, y) if family == "binomial" else links.poisson(eta, y, F.col("_offset")) if family == "poisson" else links.huber(eta, y, options.get("delta", 1.35))
            response = made.response - F.col("_offset") if family == "binomial" else made.response
            rows = self.df.withColumn("_w", made.weight * F.col("_weight")).withColumn("_z", response).withColumn("_l", made.loss * F.col("_weight"))
            return narrow_pass(rows, list(self.features), [F.col("_z")], F.col("_w"), np.append(self.center(), 0.0), F.col("_l"))
        p, center = self.p, self.center()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def reweighted():
                for batch in batches:
                    x, r = matrix(batch.column("_x"), p), matrix(batch.column("_r"), 3)
                    loss, w, z = working(family, x @ beta + intercept + r[:, 2], r[:, 0], r[:, 2], options)
                    w = w * r[:, 1]
                    # The loss is a second response with unit effect: its weighted sum is kept by dividing by the weight.
                    extra = np.column_stack([z, loss * r[:, 1] / np.maximum(w, 1e-300), w])
                    rows = pa.array(list(extra))
                    yield pa.RecordBatch.from_arrays([batch.column("_x"), rows, pa.array(np.zeros(len(x), np.int64))], names=["_x", "_r", "_key"])

            yield from _partials(reweighted(), p, 2, np.append(center, [0.0, 0.0]), None)

        rows = self.df.select(*_wide(self.features, [F.col("_y"), F.col("_weight"), F.col("_offset")]))
        blocks = {r["block"]: np.frombuffer(r["part"], np.float64) for r in _sum_blocks(rows.mapInArrow(sums, "key long, block int, part binary")).collect()}
        m = np.concatenate([blocks[b] for b in sorted(blocks)]).reshape(p + 4, p + 3)
        keep = np.arange(p + 1)
        return Moments(m[-1, 0], m[0, 0], np.append(center, 0.0), m[0, 1 : p + 2], m[1:-1, 1:][np.ix_(keep, keep)], p), float(m[0, p + 2])

    def _eta(self, beta: np.ndarray, intercept: float):
        if isinstance(self.features, str):
            terms = F.zip_with(F.col(self.features).cast("array<double>"), F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b)
            return F.aggregate(terms, F.lit(float(intercept)), lambda s, v: s + v)
        return links.linear(dict(zip(self.features, beta.tolist(), strict=True)), intercept)


def rows_of(df: DataFrame, features: list[str] | str, y: str, *, weight: str | None = None, offset: str | None = None, second: str | None = None, driver_cells: int = LOCAL_CELLS) -> tuple[LocalRows | SparkRows, tuple[str, ...]]:
    """Rows without nulls in any used column. Tables of at most driver_cells numbers, counted first, come to the driver; 0: none does.

    Both kinds take the same sums about a point near the data, so the place changes the time and not the result.
    """
    names = feature_names(df, features)
    one, none = F.lit(1.0), F.lit(0.0)
    extra = [F.col(y).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else one).alias("_weight"), (F.col(offset).cast("double") if offset else none).alias("_offset"), (F.col(second).cast("double") if second else none).alias("_second")]
    x = [F.col(features).cast("array<double>").alias(features)] if isinstance(features, str) else [F.col(c).cast("double").alias(c) for c in features]
    rows = df.select(*x, *extra).dropna()
    if isinstance(features, str):
        rows = rows.filter((F.size(features) == len(names)) & ~F.exists(features, lambda v: v.isNull()))
    limit = driver_cells // (len(names) + 4)
    if limit and rows.limit(limit + 1).count() <= limit:
        table = rows.toArrow()
        r = [table.column(c).to_numpy() for c in ("_y", "_weight", "_offset", "_second")]
        data = np.array(table.column(features).combine_chunks().flatten(), float).reshape(-1, len(names)) if isinstance(features, str) else np.column_stack([table.column(c).to_numpy() for c in features]) if len(table) else np.empty((0, len(names)))
        return LocalRows(data, *r), names
    return SparkRows(rows.persist(StorageLevel.MEMORY_AND_DISK), features, len(names)), names


def reweighted_path(rows: LocalRows | SparkRows, spec: Spec, family: str, *, lambdas=None, n_lambdas: int = 100, lambda_min_ratio: float = 1e-3, tol: float = 1e-9, max_iter: int = 10_000, max_outer: int = MAX_OUTER, outer_tol: float = OUTER_TOL, **options) -> PathResult:
    """GLM, Huber and Cox paths: rounds of working weights and responses, each solved on its moments to the end.

    The automatic grid starts where the gradient at zero coefficients and zero intercept puts it.
    """
    p = len(spec.terms)
    intercept_on = spec.fit_intercept and family != "cox"
    m, loss = rows.round(family, np.zeros(p), 0.0, options)
    s = _row_scales(rows, spec, m)
    start = spec.problem(m.about(0.0)[:p, :p], m.about(0.0)[:p, p], s)
    grid = _grid(start.lambda_max() if lambdas is None else 0.0, lambdas, n_lambdas, lambda_min_ratio)
    beta, b0, coefs, intercepts, info = np.zeros(p), 0.0, [], [], []
    gram = None
    for lam in grid:
        began, total = clock.perf_counter_ns(), 0
        ok = False
        for _ in range(max_outer):
            if intercept_on:
                a, mean = m.centered(), m.mean
            else:
                a, mean = m.about(0.0), np.zeros(p + 1)
            prob = spec.problem(a[:p, :p], a[:p, p], s)
            new, iters, _ = solve(prob, float(lam), beta * s, tol=tol, sweeps=max_iter)
            new = new / s
            c0 = float(mean[p] - mean[:p] @ new) if intercept_on else 0.0
            moved = max(np.abs(new - beta).max(initial=0.0), abs(c0 - b0))
            beta, b0, total, gram = new, c0, total + iters, prob.gram
            m, loss = rows.round(family, beta, b0, options)
            if moved < outer_tol * max(1.0, np.abs(beta).max(initial=0.0)):
                ok = True
                break
        coefs.append(beta)
        intercepts.append(b0)
        info.append({"iters": total, "converged": ok, "loss": loss / max(m.n, 1), "ns": clock.perf_counter_ns() - began})
    rows.close()
    coefs = np.array(coefs).reshape(len(grid), p)
    low = convex_min_index(gram, coefs * s, spec.penalty, spec.number if spec.penalty.kind == "group" else None) if gram is not None else None
    return PathResult(family, spec.terms, grid, coefs, np.array(intercepts), info, convex_min=low, options=options)


def _row_scales(rows: LocalRows | SparkRows, spec: Spec, m: Moments) -> np.ndarray:
    if not spec.standardize:
        return np.ones(m.p)
    if isinstance(rows, LocalRows):
        s = rows.x.std(axis=0)
        return np.where(s > 1e-12, s, 1.0)
    return scales(moments(rows.df, rows.features, names=spec.terms), True)


def multinomial_path(df: DataFrame, features: list[str] | str, y: str, spec: Spec, *, driver_cells: int = LOCAL_CELLS, lambdas=None, n_lambdas: int = 100, lambda_min_ratio: float = 1e-3, tol: float = 1e-9, max_iter: int = 10_000, max_outer: int = 200, outer_tol: float = 1e-7) -> PathResult:
    """Symmetric K-class model with penalties on rows. The curvature bound 1/2 makes one Gram matrix serve all rounds; a round only needs X'(Y - P)."""
    classes = sorted(r[0] for r in df.select(y).dropna().distinct().collect())
    if len(classes) < 2:
        raise ValueError("at least two classes")
    k, p = len(classes), len(spec.terms)
    code = F.coalesce(*[F.when(F.col(y) == c, i) for i, c in enumerate(classes)])
    rows, _ = rows_of(df.withColumn("_code", code), features, "_code", driver_cells=driver_cells)
    if isinstance(rows, SparkRows):
        m = moments(rows.df, features, names=spec.terms)
    else:
        shift = rows.x.mean(axis=0)
        d = rows.x - shift
        m = Moments(len(d), float(len(d)), shift, d.sum(axis=0), d.T @ d, p)
    s, mean = scales(m, spec.standardize), m.mean[:p]
    a = (m.centered() if spec.fit_intercept else m.about(0.0)) / (2 * k)
    gram = a[:p, :p]
    beta, b0 = np.zeros((p, k)), np.zeros(k)

    def residual(beta: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(X'(Y - P) / n, mean of Y - P, loss)."""
        if isinstance(rows, LocalRows):
            return _class_sums(rows.x, rows.y.astype(int), beta, b0, k, len(rows.y))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p * k + k + 1)
            for batch in batches:
                g, e, loss = _class_sums(matrix(batch.column("_x"), p), matrix(batch.column("_r"), 1)[:, 0].astype(int), beta, b0, k, 1)
                total += np.concatenate([g.ravel(), e, [loss]])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["key", "block", "part"])

        made = _sum_blocks(rows.df.select(*_wide(features, [F.col("_y")])).mapInArrow(sums, "key long, block int, part binary")).first()["part"]
        v = np.frombuffer(made, np.float64) / m.n
        return v[: p * k].reshape(p, k), v[p * k : -1], float(v[-1])

    grad, error, loss = residual(beta, b0)
    top = Problem(gram / np.outer(s, s), grad / k / s[:, None], spec.penalty, spec.w / s if spec.standardize else spec.w)
    grid = _grid(top.lambda_max() if lambdas is None else 0.0, lambdas, n_lambdas, lambda_min_ratio)
    coefs, intercepts, info = [], [], []
    for lam in grid:
        began, total, ok = clock.perf_counter_ns(), 0, False
        for _ in range(max_outer):
            step = error * 2 if spec.fit_intercept else np.zeros(k)
            cross = gram @ beta + (grad - (np.outer(mean, error) if spec.fit_intercept else 0.0)) / k
            prob = Problem(gram / np.outer(s, s), cross / s[:, None], spec.penalty, top.weights)
            new, iters, _ = solve(prob, float(lam), beta * s[:, None], tol=tol, sweeps=max_iter)
            new = new / s[:, None]
            c0 = b0 + step - mean @ (new - beta) if spec.fit_intercept else b0
            moved = max(np.abs(new - beta).max(initial=0.0), np.abs(c0 - b0).max(initial=0.0))
            beta, b0, total = new, c0, total + iters
            grad, error, loss = residual(beta, b0)
            if moved < outer_tol:
                ok = True
                break
        coefs.append(beta)
        intercepts.append(b0)
        info.append({"iters": total, "converged": ok, "loss": loss, "ns": clock.perf_counter_ns() - began})
    rows.close()
    return PathResult("multinomial", spec.terms, grid, np.array(coefs), np.array(intercepts), info, tuple(classes))


def _class_sums(x: np.ndarray, code: np.ndarray, beta: np.ndarray, b0: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    eta = x @ beta + b0
    top = eta.max(axis=1, keepdims=True)
    e = np.exp(eta - top)
    total = e.sum(axis=1, keepdims=True)
    r = -e / total
    r[np.arange(len(code)), code] += 1
    loss = float((np.log(total[:, 0]) + top[:, 0] - eta[np.arange(len(code)), code]).sum())
    return x.T @ r / n, r.sum(axis=0) / n, loss / n


def fit_path(df: DataFrame, features: list[str] | str, y: str | list[str], penalty, *, family: str = "gaussian", groups=None, weights=None, coord_weights=None, sample_weight: str | None = None, offset: str | None = None, event: str | None = None, fit_intercept: bool = True, standardize: bool = False, driver_cells: int = LOCAL_CELLS, **grid) -> PathResult:
    """A path for any family and penalty.

    family: gaussian, huber, binomial, poisson, cox (y the time, event the indicator), multinomial, or gaussian with a list
    of responses for several tasks. Rows with a null in a used column are left out.
    """
    if family in ("multinomial",) or isinstance(y, list):
        spec = Spec(penalty, feature_names(df, features), weights, np.arange(len(feature_names(df, features))), None, fit_intercept, standardize)
        if family == "multinomial":
            return multinomial_path(df, features, y, spec, driver_cells=driver_cells, **grid)
        return tasks_from_moments(moments(df, features, y, weight=sample_weight), spec, tuple(y), **grid)
    if family == "gaussian":
        m = moments(df, features, [y], weight=sample_weight)
        return path_from_moments(m, Spec(penalty, m.names, weights, groups, coord_weights, fit_intercept, standardize), **grid)
    if family == "cox" and (event is None or sample_weight):
        raise ValueError("cox needs an event column and takes no sample weights")
    rows, names = rows_of(df, features, y, weight=sample_weight, offset=offset, second=event, driver_cells=driver_cells)
    return reweighted_path(rows, Spec(penalty, names, weights, groups, coord_weights, fit_intercept, standardize), family, **grid)


def pilot_weights(beta: np.ndarray, eta: float = 1.0, eps: float = 1e-6, groups: np.ndarray | None = None) -> np.ndarray:
    """Adaptive weights 1 / max(|b|, eps)^eta, of coefficients or of group norms."""
    size = np.abs(beta) if groups is None else np.sqrt(np.bincount(groups, beta**2))
    return 1 / np.maximum(size, eps) ** eta


def adaptive_weights(df: DataFrame, features: list[str] | str, y: str, penalty, *, pilot_index: str | int = "mid", eta: float = 1.0, eps: float = 1e-6, groups=None, pilot=None, **kwargs) -> np.ndarray:
    """Weights from a lasso (or group lasso) pilot path over all rows, at its middle, last or a numbered lambda."""
    from ridgeline.operators.penalties import GroupLasso, Lasso

    first = fit_path(df, features, y, pilot or (GroupLasso() if penalty.kind == "group" else Lasso()), groups=groups, **{k: v for k, v in kwargs.items() if k != "lambdas"})
    at = {"mid": len(first.lambdas) // 2, "last": len(first.lambdas) - 1}.get(pilot_index, pilot_index)
    number = group_numbers(groups, first.terms) if penalty.kind == "group" else None
    return pilot_weights(first.coefs[at], eta, eps, number)


def adaptive_path(df: DataFrame, features: list[str] | str, y: str, penalty, *, pilot_index: str | int = "mid", eta: float = 1.0, eps: float = 1e-6, groups=None, pilot=None, **kwargs) -> PathResult:
    """The path with adaptive_weights."""
    weights = adaptive_weights(df, features, y, penalty, pilot_index=pilot_index, eta=eta, eps=eps, groups=groups, pilot=pilot, **kwargs)
    return fit_path(df, features, y, penalty, groups=groups, weights=weights, **kwargs)


def log_choose(p: int, k: int) -> float:
    return math.lgamma(p + 1) - math.lgamma(k + 1) - math.lgamma(p - k + 1)
