"""Choosing a lambda: cross-validation, information criteria, marginal false discovery rates, stability."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import normal
from ridgeline.operators import cox, scoring
from ridgeline.operators.moments import Moments, moments
from ridgeline.operators.paths import PathResult, Spec, fit_path, group_numbers, log_choose, path_from_moments, tasks_from_moments


def fold_column(keys: list[str], k: int = 5, seed: int = 0) -> Column:
    """A fold number from 0 by a seeded hash of the keys: the same rows fall together on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in keys]), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, by: str, keys: list[str], k: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds of even size within each value of `by`: counts per cell of (value, hash bucket) give offsets, so no window takes a whole value."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in keys])
    rows = df.withColumn("_h", h).withColumn("_cell", F.pmod(F.col("_h"), F.lit(1024)).cast("int"))
    cells = rows.groupBy(by, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("_before", before).drop("_n").withColumnRenamed(by, "_by").withColumnRenamed("_cell", "_c")
    joined = rows.join(starts, rows[by].eqNullSafe(starts["_by"]) & (rows["_cell"] == starts["_c"]))
    place = F.row_number().over(Window.partitionBy(by, "_cell").orderBy("_h", *keys)) - 1 + F.col("_before")
    return joined.withColumn(name, F.pmod(place, F.lit(k)).cast("int")).drop("_h", "_cell", "_by", "_c", "_before")


@dataclass
class CVResult:
    path: PathResult
    scores: np.ndarray  # (folds, lambdas); NaN where a fold can't be scored
    best: int
    higher_is_better: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        mean, std = np.nanmean(self.scores, axis=0), np.nanstd(self.scores, axis=0)
        rows = [(i, float(lam), float(m), float(s), i == self.best) for i, (lam, m, s) in enumerate(zip(self.path.lambdas, mean, std, strict=True))]
        return spark.createDataFrame(rows, "lambda_idx int, lambda double, mean_score double, std_score double, best boolean")


def _best(path: PathResult, scores: np.ndarray, higher: bool) -> CVResult:
    mean = np.nanmean(scores, axis=0)
    return CVResult(path, scores, int(np.nanargmax(mean) if higher else np.nanargmin(mean)), higher)


def fold_mse(path: PathResult, fold: Moments) -> np.ndarray:
    """Mean squared error at each lambda on a fold, from its moments alone."""
    a = fold.about(0.0) * fold.n / fold.mass
    mean, p = fold.mean, fold.p
    out = []
    for b, b0 in zip(path.coefs, path.intercepts, strict=True):
        if b.ndim == 2:
            each = np.diag(a[p:, p:]) - 2 * np.sum(b * a[:p, p:], axis=0) + np.einsum("pk,pq,qk->k", b, a[:p, :p], b) - 2 * b0 * (mean[p:] - mean[:p] @ b) + b0**2
            out.append(each.mean())
        else:
            out.append(a[p, p] - 2 * b @ a[:p, p] + b @ a[:p, :p] @ b - 2 * b0 * (mean[p] - mean[:p] @ b) + b0**2)
    return np.array(out)


def cross_validate(df: DataFrame, features: list[str] | str, y: str | list[str], penalty, fold: str, *, family: str = "gaussian", event: str | None = None, offset: str | None = None, **kwargs) -> CVResult:
    """Path on all rows, refitted on its lambdas without each fold (a column of numbers) and scored on it.

    Least squares needs one pass: moments by fold, and training moments as differences. Other families refit per
    fold; their scores over all lambdas of a fold are one aggregation.
    """
    grid = {k: kwargs.pop(k) for k in ("lambdas", "n_lambdas", "lambda_min_ratio", "tol", "max_iter") if k in kwargs}
    if family == "gaussian":
        ys = y if isinstance(y, list) else [y]
        parts = moments(df, features, ys, by=fold, weight=kwargs.pop("sample_weight", None))
        whole = None
        for m in parts.values():
            whole = m if whole is None else whole + m
        groups = np.arange(whole.p) if isinstance(y, list) else kwargs.get("groups")
        spec = Spec(penalty, whole.names, kwargs.get("weights"), groups, kwargs.get("coord_weights"), kwargs.get("fit_intercept", True), kwargs.get("standardize", False))
        fit = (lambda m, **g: tasks_from_moments(m, spec, tuple(y), **g)) if isinstance(y, list) else (lambda m, **g: path_from_moments(m, spec, **g))
        path = fit(whole, **grid)
        again = {k: v for k, v in grid.items() if k in ("tol", "max_iter")} | {"lambdas": path.lambdas}
        return _best(path, np.array([fold_mse(fit(whole - parts[f], **again), parts[f]) for f in sorted(parts)]), False)
    path = fit_path(df, features, y, penalty, family=family, event=event, offset=offset, **kwargs, **grid)
    again = {k: v for k, v in grid.items() if k in ("tol", "max_iter")} | {"lambdas": path.lambdas}
    scores = []
    for f in sorted(r[0] for r in df.select(fold).dropna().distinct().collect()):
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        if family == "cox" and not train.filter(F.col(event) == 1).head(1):
            scores.append(np.full(len(path.lambdas), np.nan))
            continue
        if family == "multinomial" and train.select(y).distinct().count() < len(path.labels):
            continue
        part = fit_path(train, features, y, penalty, family=family, event=event, offset=offset, **kwargs, **again)
        scores.append(score_path(test, part, features if isinstance(features, str) else None, y, event, offset))
    return _best(path, np.array(scores), family == "cox")


def score_path(df: DataFrame, path: PathResult, features: str | None, y: str, event: str | None = None, offset: str | None = None) -> np.ndarray:
    """The family's score at every lambda: deviance, log loss, or for Cox the concordance (higher is better)."""
    some = range(len(path.lambdas))
    if path.datafit == "cox":
        rows = df.select(y, event, *[scoring.linear_predictor(path, i, features).alias(f"_s{i}") for i in some])
        found = cox.concordances(rows, y, event, [f"_s{i}" for i in some]).collect()
        return np.array([r["c_index"] for r in sorted(found, key=lambda r: r["score_idx"])])
    target = F.col(y).cast("double") if path.datafit != "multinomial" else F.coalesce(*[F.when(F.col(y) == c, i) for i, c in enumerate(path.labels)])
    metric = scoring.multinomial_loss if path.datafit == "multinomial" else scoring.METRICS[path.datafit]
    return np.array([x if x is not None else np.nan for x in df.agg(*[metric(target, scoring.linear_predictor(path, i, features, offset)).alias(f"_m{i}") for i in some]).first()], float)


# --- information criteria and marginal false discovery ----------------------------------------------------------------


def _negative_log_likelihoods(path: PathResult, m: Moments | None, n: float) -> np.ndarray:
    if path.datafit in ("gaussian", "huber", "multitask"):
        rss = fold_mse(path, m) * n
        return n / 2 * np.log(np.maximum(rss, 1e-300) / n)
    return np.array([d["loss"] for d in path.info]) * n


def information_criteria(path: PathResult, n: float, m: Moments | None = None, gamma: float = 0.5, eps: float = 1e-12) -> list[tuple]:
    """(lambda_idx, lambda, df, nll, aic, bic, ebic) rows. Least squares takes its residuals from moments; other families their losses."""
    nll = _negative_log_likelihoods(path, m, n)
    p = len(path.terms)
    rows = []
    for i, b in enumerate(path.coefs):
        k = int((np.abs(b) > eps).any(axis=1).sum() if b.ndim == 2 else (np.abs(b) > eps).sum())
        bic = math.log(n) * k + 2 * nll[i]
        rows.append((i, float(path.lambdas[i]), k, float(nll[i]), float(2 * k + 2 * nll[i]), float(bic), float(bic + 2 * gamma * log_choose(p, k))))
    return rows


def ic_table(spark: SparkSession, path: PathResult, n: float, m: Moments | None = None, **kwargs) -> DataFrame:
    return spark.createDataFrame(information_criteria(path, n, m, **kwargs), "lambda_idx int, lambda double, df int, nll double, aic double, bic double, ebic double")


def select_by_ic(path: PathResult, n: float, m: Moments | None = None, criterion: str = "bic", gamma: float = 0.5) -> int:
    column = {"aic": 4, "bic": 5, "ebic": 6}[criterion]
    return min(information_criteria(path, n, m, gamma), key=lambda r: r[column])[0]


def mfdr(path: PathResult, n: float, m: Moments | None = None) -> np.ndarray:
    """Expected share of false features at each lambda: p * 2(1 - Phi(lambda sqrt(n) / sigma)) over the number selected, in [0, 1]."""
    if path.coefs.ndim == 3:
        raise ValueError("not defined for several responses or classes")
    if path.datafit in ("gaussian", "huber"):
        sigma = np.sqrt(np.maximum(fold_mse(path, m), 1e-15))
    else:
        sigma = np.sqrt(np.maximum(2 * np.array([d["loss"] for d in path.info]), 1e-15))
    chosen = (np.abs(path.coefs) > 1e-12).sum(axis=1)
    false = len(path.terms) * 2 * (1 - normal.cdf_array(path.lambdas * math.sqrt(n) / sigma))
    return np.clip(false / np.maximum(chosen, 1), 0.0, 1.0)


def select_by_mfdr(path: PathResult, n: float, m: Moments | None = None, target: float = 0.1) -> int | None:
    ok = np.flatnonzero(mfdr(path, n, m) <= target)
    return int(ok[-1]) if len(ok) else None


class MFDR:
    """The curve of marginal false discovery rates of a fitted path on its rows, and the densest lambda within a target."""

    def __init__(self, path: PathResult):
        self.path = path

    def fit(self, df: DataFrame, features: list[str] | str, y: str, event: str | None = None) -> MFDR:
        m = moments(df, features, [y, *([event] if event else [])])
        self.mfdr_, self.lambdas_ = mfdr(self.path, m.n, m), self.path.lambdas
        return self

    def select(self, target: float = 0.1) -> tuple[int, float]:
        """(lambda_idx, rate) of the last lambda with a rate of at most target; an error where none has."""
        ok = np.flatnonzero(self.mfdr_ <= target)
        if not len(ok):
            raise ValueError(f"no lambda has a rate of {target} or less; give a longer grid")
        return int(ok[-1]), float(self.mfdr_[ok[-1]])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(lam), float(r)) for i, (lam, r) in enumerate(zip(self.lambdas_, self.mfdr_, strict=True))]
        return spark.createDataFrame(rows, "lambda_idx int, lambda double, mfdr double")


# --- resampling --------------------------------------------------------------------------------------------------------


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    h = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(multiplier)
    return h ^ (h >> np.uint64(31))


def half_samples(count: int, seed: int = 0, share: float = 0.5):
    """Membership of each row in each of `count` subsamples, by seeded hashes of its id."""

    def plan(ids: np.ndarray, w: np.ndarray):
        for b in range(count):
            on = _mixed(ids, seed * 1_000_003 + b) < np.uint64(share * 2**64)
            yield b, np.where(on, w, 0.0), int(on.sum())

    return plan


def bootstrap_samples(count: int, seed: int = 0):
    """Poisson(1) multiplicities, the large-n form of drawing with replacement."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def plan(ids: np.ndarray, w: np.ndarray):
        for b in range(count):
            k = np.searchsorted(steps, _mixed(ids, seed * 1_000_003 + b).astype(np.float64) / 2**64)
            yield b, w * k, int(k.sum())

    return plan


def fan_out(spark: SparkSession, tasks: list[tuple[int, bytes]], function, schema: str) -> DataFrame:
    """Independent small problems (number, bytes) as tasks; function gives an Arrow table for each."""
    parts = max(1, min(len(tasks), spark.sparkContext.defaultParallelism * 2))
    frame = spark.createDataFrame(tasks, "task int, data binary").repartition(parts, "task")

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("task").to_pylist(), batch.column("data").to_pylist(), strict=True):
                yield from function(number, data).to_batches()

    return frame.mapInArrow(run, schema)


def half_sample(row_id: str, number: int, seed: int = 0, share: float = 0.5) -> Column:
    """Membership of a row in one subsample, by a seeded hash of its id; a null id is in none."""
    return F.col(row_id).isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), F.lit(number), F.col(row_id)), F.lit(1 << 30)) < int(share * (1 << 30)))


def on_path(coefs: np.ndarray, groups: np.ndarray | None = None, eps: float = 1e-8) -> np.ndarray:
    """(lambdas, features): whether a feature, any of its classes or any feature of its group has a coefficient."""
    on = np.abs(coefs) > eps
    on = on.any(axis=2) if on.ndim == 3 else on
    if groups is None:
        return on
    return np.stack([on[:, groups == g].any(axis=1) for g in range(int(groups.max()) + 1)], axis=1)[:, groups]


@dataclass
class StabilitySelection:
    """Share of half-samples in which each feature is on the path, at every lambda of a shared grid.

    Least squares takes the moments of all samples in one pass over the rows. The other families (and several responses)
    refit each sample by rounds of their own, `at_once` of them at a time, on the used columns, which are kept.
    """

    penalty: object
    resamples: int = 100
    threshold: float = 0.6
    seed: int = 0
    n_lambdas: int = 20
    lambda_min_ratio: float = 0.05
    options: dict = field(default_factory=dict)
    family: str = "gaussian"
    share: float = 0.5
    at_once: int = 4

    def __post_init__(self):
        if not 0.5 < self.threshold <= 1 or not 0 < self.share < 1 or self.resamples < 1:
            raise ValueError("threshold must be in (0.5, 1], share in (0, 1), resamples 1 or more")

    def fit(self, df: DataFrame, features: list[str] | str, y: str | list[str], row_id: str, *, event: str | None = None, offset: str | None = None) -> StabilitySelection:
        if self.family == "gaussian" and not isinstance(y, list):
            counts = self._by_moments(df, features, y, row_id)
        else:
            counts = self._by_refits(df, features, y, row_id, event, offset)
        self.probabilities_ = counts / self.resamples
        self.stable_ = self.probabilities_.max(axis=0) >= self.threshold
        return self

    def _groups(self) -> np.ndarray | None:
        groups = self.options.get("groups")
        return None if groups is None else group_numbers(groups, self.terms_)

    def _by_moments(self, df: DataFrame, features: list[str] | str, y: str, row_id: str) -> np.ndarray:
        whole = moments(df, features, [y])
        spec = Spec(self.penalty, whole.names, **self.options)
        grid = path_from_moments(whole, spec, n_lambdas=self.n_lambdas, lambda_min_ratio=self.lambda_min_ratio).lambdas
        self.lambdas_, self.terms_ = grid, whole.names
        parts = moments(df, features, [y], resamples=(half_samples(self.resamples, self.seed, self.share), F.col(row_id)), names=whole.names)
        groups = self._groups()
        import pickle

        def solve_one(number: int, data: bytes) -> pa.Table:
            i, j = np.nonzero(on_path(path_from_moments(pickle.loads(data), spec, lambdas=grid).coefs, groups))
            return pa.table({"sample": pa.array(np.full(len(i), number), pa.int32()), "lambda_idx": pa.array(i, pa.int32()), "feature": pa.array(j, pa.int32())})

        hits = fan_out(df.sparkSession, [(b, pickle.dumps(m)) for b, m in parts.items()], solve_one, "sample int, lambda_idx int, feature int")
        out = np.zeros((len(grid), whole.p))
        for r in hits.groupBy("lambda_idx", "feature").agg(F.countDistinct("sample").alias("n")).collect():
            out[r["lambda_idx"], r["feature"]] = r["n"]
        return out

    def _by_refits(self, df: DataFrame, features: list[str] | str, y: str | list[str], row_id: str, event: str | None, offset: str | None) -> np.ndarray:
        used = dict.fromkeys([*([features] if isinstance(features, str) else features), *(y if isinstance(y, list) else [y]), row_id, *(c for c in (event, offset) if c)])
        rows = df.select(*used).persist()
        columns = {"family": self.family, **({"event": event} if event else {}), **({"offset": offset} if offset else {})}
        try:
            whole = fit_path(rows, features, y, self.penalty, n_lambdas=self.n_lambdas, lambda_min_ratio=self.lambda_min_ratio, **columns, **self.options)
            self.lambdas_, self.terms_ = whole.lambdas, whole.terms
            groups = self._groups()

            def mask(number: int) -> np.ndarray:
                part = rows.filter(half_sample(row_id, number, self.seed, self.share))
                return on_path(fit_path(part, features, y, self.penalty, lambdas=whole.lambdas, **columns, **self.options).coefs, groups)

            with ThreadPoolExecutor(self.at_once) as pool:
                return sum(pool.map(mask, range(self.resamples)), np.zeros((len(whole.lambdas), len(whole.terms))))
        finally:
            rows.unpersist()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, float(q), bool(s)) for t, q, s in zip(self.terms_, self.probabilities_.max(axis=0), self.stable_, strict=True)]
        return spark.createDataFrame(rows, "term string, probability double, stable boolean")

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        return df.select(*keep, *[t for t, s in zip(self.terms_, self.stable_, strict=True) if s])
