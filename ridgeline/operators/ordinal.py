"""Polychoric and polyserial correlations: counts and sums from Spark, one-dimensional likelihoods on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import normal

RHO_EDGE = 1e-6


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_i, level_i, col_j, level_j, n) of all pairs of columns, from one scan; rows with a null in either are left out of a pair."""
    pairs = [F.struct(F.lit(a).alias("col_i"), F.col(a).cast("double").alias("level_i"), F.lit(b).alias("col_j"), F.col(b).cast("double").alias("level_j")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*").filter(F.col("level_i").isNotNull() & F.col("level_j").isNotNull())
    return each.groupBy("col_i", "level_i", "col_j", "level_j").agg(F.count("*").alias("n"))


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, level, n) over each column's own rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("level")) for c in columns])).alias("_c")
    return df.select(cells).select("_c.*").filter(F.col("level").isNotNull()).groupBy("col", "level").agg(F.count("*").alias("n"))


def thresholds(counts: np.ndarray) -> np.ndarray:
    """Normal quantiles of cumulative shares; an empty level counts as half a row."""
    c = np.where(counts <= 0, 0.5, counts).astype(float)
    return np.array([normal.quantile(x) for x in np.cumsum(c)[:-1] / c.sum()])


def polychoric(table: np.ndarray, cuts_i: np.ndarray, cuts_j: np.ndarray) -> float:
    """Correlation that makes a table of level counts likeliest, the thresholds being given (two-step estimate)."""
    a, b = (np.concatenate([[-8.0], c, [8.0]]) for c in (cuts_i, cuts_j))

    def loss(rho: float) -> float:
        grid = np.array([[normal.bivariate_cdf(x, y, rho) for y in b] for x in a])
        cell = np.diff(np.diff(grid, axis=0), axis=1)
        return -float((table * np.log(np.maximum(cell, 1e-12))).sum())

    return normal.minimize_bounded(loss, -1 + RHO_EDGE, 1 - RHO_EDGE)


def polychoric_correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Matrix of pairwise polychoric correlations; NaN where a pair has fewer than two rows."""
    own: dict[str, dict[float, int]] = {c: {} for c in columns}
    for r in level_counts(df, columns).collect():
        own[r["col"]][r["level"]] = r["n"]
    levels = {c: sorted(v) for c, v in own.items()}
    cuts = {c: thresholds(np.array([own[c][v] for v in levels[c]])) if own[c] else np.array([]) for c in columns}
    tables = {(a, b): np.zeros((len(levels[a]), len(levels[b]))) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    for r in pair_counts(df, columns).collect():
        a, b = r["col_i"], r["col_j"]
        tables[a, b][levels[a].index(r["level_i"]), levels[b].index(r["level_j"])] = r["n"]
    out = np.eye(len(columns))
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            t = tables[a, columns[j]]
            out[i, j] = out[j, i] = polychoric(t, cuts[a], cuts[columns[j]]) if t.sum() >= 2 else np.nan
    return out


def polyserial_correlation(df: DataFrame, ordinal: str, continuous: str, *, bins: int = 4096) -> float:
    """Correlation of an ordinal and a continuous column, by the likelihood of levels given standard scores.

    The standard scores are binned and counted by level in one aggregation; the likelihood then costs nothing per row. Bins are
    16 / bins wide up to 8 standard deviations and as wide in log units beyond, and stand for the mean of their scores.
    NaN for fewer than three rows or a constant column.
    """
    rows = df.select(F.col(ordinal).cast("double").alias("o"), F.col(continuous).cast("double").alias("x")).dropna()
    n, mean, std = rows.agg(F.count("*"), F.avg("x"), F.stddev_samp("x")).first()
    if n < 3 or not std or std <= 0:
        return math.nan
    width = 16.0 / bins
    z = (F.col("x") - mean) / std
    far = F.signum(z) * (bins / 2 + 1 + F.floor(F.log(F.abs(z) / 8) / width))
    place = F.when(F.abs(z) < 8, F.floor(z / width)).otherwise(far).cast("long")
    cells = rows.groupBy("o", place.alias("bin")).agg(F.count("*").alias("n"), F.avg(z).alias("z")).collect()
    levels = sorted({r["o"] for r in cells})
    cuts = np.concatenate([[-8.0], thresholds(np.array([sum(r["n"] for r in cells if r["o"] == v) for v in levels])), [8.0]])
    at = np.array([levels.index(r["o"]) for r in cells])
    zs, ns = np.array([r["z"] for r in cells]), np.array([r["n"] for r in cells])

    def loss(rho: float) -> float:
        root = math.sqrt(1 - rho * rho)
        chance = normal.cdf_array((cuts[at + 1] - rho * zs) / root) - normal.cdf_array((cuts[at] - rho * zs) / root)
        return -float((ns * np.log(np.maximum(chance, 1e-12))).sum())

    return normal.minimize_bounded(loss, -1 + RHO_EDGE, 1 - RHO_EDGE)


def mixed_correlation(df: DataFrame, columns: list[str], *, ordinal_cutoff: int = 10, continuous: list[str] | None = None) -> np.ndarray:
    """Pearson, polyserial or polychoric by pair; a column with more than ordinal_cutoff distinct values is continuous."""
    if continuous is None:
        found = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
        continuous = [c for c in columns if found[c] > ordinal_cutoff]
    discrete = [c for c in columns if c not in continuous]
    out = np.eye(len(columns))
    if len(discrete) > 1:
        r = polychoric_correlation(df, discrete)
        at = [columns.index(c) for c in discrete]
        out[np.ix_(at, at)] = r
    pairs = [(i, j) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j and a in continuous and b in continuous]
    if pairs:
        row = df.agg(*[F.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"_r{k}") for k, (i, j) in enumerate(pairs)]).first()
        for (i, j), v in zip(pairs, row, strict=True):
            out[i, j] = out[j, i] = v
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if i < j and (a in continuous) != (b in continuous):
                o, x = (b, a) if a in continuous else (a, b)
                out[i, j] = out[j, i] = polyserial_correlation(df, o, x)
    return out


def correlation_rows(spark: SparkSession, matrix: np.ndarray, columns: list[str]) -> DataFrame:
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return spark.createDataFrame(rows, "term_i string, term_j string, value double")


def ordinal_codes(column: str, levels: list) -> Column:
    """Codes 0..L-1 in the order of levels; anything else is null."""
    return F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(levels)])
