"""Weighted first and second moments of feature and response columns: the only pass over rows that least squares needs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Feature counts up to this are summed by code-generated SQL; more by numpy over Arrow batches.
NARROW = 24
#: Numbers in a block of a partial matrix, and tasks that first add a block's parts.
BLOCK, SLOTS = 1 << 17, 1024


@dataclass(frozen=True)
class Moments:
    """Sums over n rows with weights of total mass: about `shift` for numerical safety, (p + k) long, features first."""

    n: float
    mass: float
    shift: np.ndarray
    first: np.ndarray
    second: np.ndarray
    p: int
    names: tuple[str, ...] = ()

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.first / self.mass

    def centered(self) -> np.ndarray:
        """Weighted cross products about the mean, divided by n."""
        return (self.second - np.outer(self.first, self.first) / self.mass) / self.n

    def about(self, point: np.ndarray | float = 0.0) -> np.ndarray:
        """Cross products about any point, divided by n."""
        d = self.shift - point
        return (self.second + np.outer(self.first, d) + np.outer(d, self.first) + self.mass * np.outer(d, d)) / self.n

    def __add__(self, other: Moments) -> Moments:
        return self._moved(other, 1.0)

    def __sub__(self, other: Moments) -> Moments:
        """What is left without the other's rows, e.g. training folds from all and one."""
        return self._moved(other, -1.0)

    def _moved(self, other: Moments, sign: float) -> Moments:
        d = other.shift - self.shift
        first = other.first + other.mass * d
        second = other.second + np.outer(other.first, d) + np.outer(d, other.first) + other.mass * np.outer(d, d)
        return replace(self, n=self.n + sign * other.n, mass=self.mass + sign * other.mass, first=self.first + sign * first, second=self.second + sign * second)

    def select(self, index: list[int]) -> Moments:
        """Some of the features, and all responses."""
        keep = [*index, *range(self.p, len(self.shift))]
        return replace(self, shift=self.shift[keep], first=self.first[keep], second=self.second[np.ix_(keep, keep)], p=len(index), names=tuple(self.names[i] for i in index) if self.names else ())

    def features(self) -> Moments:
        return replace(self, shift=self.shift[: self.p], first=self.first[: self.p], second=self.second[: self.p, : self.p])


def feature_names(df: DataFrame, features: list[str] | str) -> tuple[str, ...]:
    """Names of the columns, or of the entries of one array column."""
    if isinstance(features, str):
        size = df.select(F.max(F.size(features))).first()[0] or 0
        return tuple(f"{features}[{i}]" for i in range(size))
    return tuple(features)


def _wide(columns: list[str] | str, extra: list[Column]) -> list[Column]:
    x = F.col(columns).cast("array<double>") if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    return [x.alias("_x"), F.array(*extra).alias("_r") if extra else F.array().cast("array<double>").alias("_r")]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, width) if width else np.empty((len(column), 0))


def _add_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of each (key, block), whose rows come one after the other; one block is held at a time."""
    at, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["key", "block", "part"])

    for batch in batches:
        for key, block, part in zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), batch.column("part"), strict=True):
            own = np.frombuffer(part.as_buffer(), np.float64)
            if at == (key, block):
                total += own
                continue
            if at is not None:
                yield row()
            at, total = (key, block), own.copy()
    if at is not None:
        yield row()


def _sum_blocks(parts: DataFrame) -> DataFrame:
    """(key, block, part): sums of partial matrices that come as rows of bytes (key, block, part).

    Two rounds, as a tree: the parts of a block are added in up to SLOTS tasks by the partition they come from, then those sums in one. Tasks
    read their parts one by one, so none holds more than a block and a batch.
    """
    schema = "key long, block int, part binary"
    slot = F.pmod(F.spark_partition_id(), F.lit(SLOTS))
    near = parts.withColumn("_slot", slot).repartition("key", "block", "_slot").sortWithinPartitions("key", "block", "_slot").drop("_slot").mapInArrow(_add_sorted, schema)
    return near.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_add_sorted, schema)


def _partials(batches: Iterator[pa.RecordBatch], p: int, k: int, shift: np.ndarray, multiplicity: Callable | None) -> Iterator[pa.RecordBatch]:
    """One partition's sums per key, in row blocks of about BLOCK numbers."""
    width = p + k
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        values = np.hstack([matrix(batch.column("_x"), p), matrix(batch.column("_r"), k + 1)])
        keys = batch.column("_key").to_numpy(zero_copy_only=False)
        z, w = values[:, :width] - shift, values[:, width]
        one = np.column_stack([np.ones(len(z)), z])
        plan = ((int(key), np.where(keys == key, w, 0.0), (keys == key).sum()) for key in np.unique(keys)) if multiplicity is None else multiplicity(batch.column("_id").to_numpy(zero_copy_only=False), w)
        for key, weight, n in plan:
            at = np.flatnonzero(weight)
            part = one[at].T @ (one[at] * weight[at, None])
            held = sums.setdefault(key, np.zeros((width + 2, width + 1)))
            held[:-1] += part
            held[-1, 0] += n
    step = max(1, BLOCK // (width + 1))
    for key, m in sums.items():
        for b in range(0, width + 2, step):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([b], pa.int32()), pa.array([m[b : b + step].tobytes()], pa.binary())], names=["key", "block", "part"])


def moments(df: DataFrame, features: list[str] | str, responses: list[str | Column] = (), *, weight: str | Column | None = None, by: str | None = None, resamples: tuple[Callable, Column] | None = None, names: tuple[str, ...] | None = None) -> Moments | dict[int, Moments]:
    """Moments of the rows in which all used columns are there and finite: a null, NaN or infinity in any of them, or a null key or
    resample id, leaves the row out, however many features there are.

    by: an integer column; gives a dict of Moments, from the same single pass. resamples: (function of row ids and weights
    giving (key, weights, rows) triples, id column); also a dict. Two passes are made: means, then products about them, which
    keeps the digits that plain sums of squares lose.
    """
    names = names or feature_names(df, features)
    p = len(names)
    cols = [F.col(c) if isinstance(c, str) else c for c in responses]
    ys = [c.cast("double") for c in cols]
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    if not isinstance(features, str) and p + len(ys) <= NARROW and resamples is None:
        return _narrow(df, list(features), ys, w, by, names)
    rows = df.select(*_wide(features, [*ys, w]), (F.lit(0) if by is None else F.col(by)).cast("long").alias("_key"), *([] if resamples is None else [resamples[1].cast("long").alias("_id")]))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)
    rows = rows.filter((F.size("_x") == p) & ~F.exists("_x", bad) & ~F.exists("_r", bad) & F.col("_key").isNotNull())
    if resamples is not None:
        rows = rows.filter(F.col("_id").isNotNull())
    shift = _wide_means(rows, p, len(ys))
    function = None if resamples is None else resamples[0]
    k = len(ys)
    parts = rows.mapInArrow(lambda b: _partials(b, p, k, shift, function), "key long, block int, part binary")
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in _sum_blocks(parts).collect():
        found.setdefault(r["key"], {})[r["block"]] = np.frombuffer(r["part"], np.float64)
    out = {}
    for key, blocks in found.items():
        m = np.concatenate([blocks[b] for b in sorted(blocks)]).reshape(p + k + 2, p + k + 1)
        out[key] = Moments(m[-1, 0], m[0, 0], shift, m[0, 1:], m[1:-1, 1:], p, names)
    if by is None and resamples is None:
        return out.get(0) or Moments(0.0, 0.0, shift, np.zeros(p + k), np.zeros((p + k, p + k)), p, names)
    return out


def _wide_means(rows: DataFrame, p: int, k: int) -> np.ndarray:
    """Rough centers, from the first rows: any point near the data serves."""
    some = rows.select("_x", "_r").limit(1000).toArrow().combine_chunks()
    if not len(some):
        return np.zeros(p + k)
    x, r = (some.column(c).combine_chunks() for c in ("_x", "_r"))
    return np.hstack([matrix(x, p), matrix(r, len(r[0]))[:, :k]]).mean(axis=0)


def narrow_pass(rows: DataFrame, features: list[str], responses: list[Column], weight: Column, shift: np.ndarray, extra: Column) -> tuple[Moments, float]:
    """Moments about a given point and the sum of one more column, in one job; rows has no nulls."""
    cols = [F.col(c) for c in features] + responses
    width = len(cols)
    z = [c - F.lit(float(x)) for c, x in zip(cols, shift, strict=True)]
    row = rows.agg(F.count("*"), F.sum(weight), F.sum(extra), *[F.sum(weight * a) for a in z], *[F.sum(weight * z[i] * z[j]) for i in range(width) for j in range(i + 1)]).first()
    v = np.array([x or 0.0 for x in row], np.float64)
    second = np.zeros((width, width))
    second[np.tril_indices(width)] = v[3 + width :]
    second = second + np.tril(second, -1).T
    return Moments(v[0], v[1], np.asarray(shift, float), v[3 : 3 + width], second, len(features), tuple(features)), float(v[2])


def _narrow(df: DataFrame, features: list[str], ys: list[Column], w: Column, by: str | None, names: tuple[str, ...]) -> Moments | dict[int, Moments]:
    p, width = len(features), len(features) + len(ys)
    cols = [F.col(c).cast("double") for c in features] + ys
    rows = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cols)], w.alias("_w"), *([] if by is None else [F.col(by).cast("long").alias("_key")]))
    rows = rows.dropna()
    for c in [*(f"_c{i}" for i in range(width)), "_w"]:
        rows = rows.filter(F.abs(c) != math.inf)
    shift = np.array([x or 0.0 for x in rows.agg(*[F.avg(f"_c{i}") for i in range(width)]).first()])
    z = [F.col(f"_c{i}") - F.lit(float(shift[i])) for i in range(width)]
    sums = [F.count("*"), F.sum("_w"), *[F.sum(F.col("_w") * a) for a in z], *[F.sum(F.col("_w") * z[i] * z[j]) for i in range(width) for j in range(i + 1)]]
    sums = [s.alias(f"_s{i}") for i, s in enumerate(sums)]
    found = rows.groupBy("_key").agg(*sums).collect() if by else [rows.agg(*sums).first()]
    out = {}
    low = np.tril_indices(width)
    for r in found:
        v = np.array([x or 0.0 for x in (list(r)[1:] if by else list(r))], np.float64)
        second = np.zeros((width, width))
        second[low] = v[2 + width :]
        second = second + np.tril(second, -1).T
        out[r["_key"] if by else 0] = Moments(v[0], v[1], shift, v[2 : 2 + width], second, p, names)
    return out if by else out[0]


def gram_rows(df: DataFrame, features: list[str] | str) -> DataFrame:
    """(i, j, value): raw sums of products of the upper triangle, one row per pair."""
    m = moments(df, features)
    g = m.about(0.0) * m.n
    rows = [(i, j, float(g[i, j])) for i in range(m.p) for j in range(i, m.p)]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())]))
