"""Proximal maps as Spark columns. z: the point; t: step; L: lambda times weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_threshold(z: Column, t: float, level: float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - t * level, F.lit(0.0))


def elastic_net_prox(z: Column, t: float, lam: float, alpha: float, weight: float = 1.0) -> Column:
    return soft_threshold(z, t, alpha * lam * weight) / (1 + t * (1 - alpha) * lam * weight)


def mcp_prox(z: Column, t: float, level: float, gamma: float = 3.0) -> Column:
    v = 1.0 / t
    u = F.abs(z) * v
    return F.when(u <= level, F.lit(0.0)).when(u <= gamma * level, F.signum(z) * (u - level) / (v * (1 - 1 / gamma))).otherwise(z)


def scad_prox(z: Column, t: float, level: float, a: float = 3.7) -> Column:
    v = 1.0 / t
    u, s = F.abs(z) * v, F.signum(z)
    return (
        F.when(u <= level, F.lit(0.0))
        .when(u <= 2 * level, s * (u - level) / v)
        .when(u <= a * level, s * (u - a * level / (a - 1)) / (v * (1 - 1 / (a - 1))))
        .otherwise(z)
    )


def block_norm(block: Column) -> Column:
    return F.sqrt(F.aggregate(block, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def group_soft_threshold(block: Column, t: float, level: float) -> Column:
    norm = block_norm(block)
    scale = F.when(norm > t * level, 1 - t * level / norm).otherwise(F.lit(0.0))
    return F.transform(block, lambda x: x.cast("double") * scale)


def group_elastic_net_prox(block: Column, t: float, lam: float, alpha: float, weight: float = 1.0) -> Column:
    shrunk = group_soft_threshold(block, t, alpha * lam * weight)
    return F.transform(shrunk, lambda x: x / (1 + t * (1 - alpha) * lam * weight))
