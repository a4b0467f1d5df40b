"""Penalties on coefficients: what the driver's solvers need of each.

Scalar penalties give `prox(z, t, lam, w)` for arrays; group penalties give `prox_group(block, t, lam, w, v)`. Weighted-L1
families (bridge and the bilevel ones) give `surrogate(beta, lam)`, the weights of the next lasso.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def soft(z, level):
    return np.sign(z) * np.maximum(np.abs(z) - level, 0.0)


def firm(z, t, level, gamma):
    """MCP's scalar map in the curvature of the coordinate, 1 / t."""
    z = np.asarray(z, float)
    u = np.abs(z) / t
    inner = np.sign(z) * (u - level) * t / (1 - 1 / gamma)
    return np.where(u <= level, 0.0, np.where(u <= gamma * level, inner, z))


def scad_map(z, t, level, a):
    z = np.asarray(z, float)
    u, s = np.abs(z) / t, np.sign(z)
    middle = s * (u - a * level / (a - 1)) * t / (1 - 1 / (a - 1))
    return np.where(u <= level, 0.0, np.where(u <= 2 * level, s * (u - level) * t, np.where(u <= a * level, middle, z)))


def mcp_value(b, lam, gamma):
    b = np.abs(b)
    return np.where(b < gamma * lam, lam * b - b * b / (2 * gamma), gamma * lam * lam / 2)


def scad_value(b, lam, a):
    b = np.abs(b)
    middle = (2 * a * lam * b - b * b - lam * lam) / (2 * (a - 1))
    return np.where(b <= lam, lam * b, np.where(b <= a * lam, middle, lam * lam * (a + 1) / 2))


@dataclass(frozen=True)
class ElasticNet:
    alpha: float = 0.5
    kind = "scalar"
    convex = True

    @property
    def l1(self) -> float:
        return self.alpha

    def prox(self, z, t, lam, w):
        return soft(z, t * self.alpha * lam * w) / (1 + t * (1 - self.alpha) * lam * w)

    def value(self, beta, lam, w):
        return float(np.sum(lam * w * (self.alpha * np.abs(beta) + (1 - self.alpha) * beta**2 / 2)))


def Lasso() -> ElasticNet:  # noqa: N802
    return ElasticNet(1.0)


@dataclass(frozen=True)
class MCP:
    gamma: float = 3.0
    kind = "scalar"
    convex = False
    l1 = 1.0

    @property
    def concavity(self) -> float:
        return 1 / self.gamma

    def prox(self, z, t, lam, w):
        return firm(z, t, lam * w, self.gamma)

    def value(self, beta, lam, w):
        return float(np.sum(mcp_value(beta, lam * w, self.gamma)))


@dataclass(frozen=True)
class SCAD:
    a: float = 3.7
    kind = "scalar"
    convex = False
    l1 = 1.0

    @property
    def concavity(self) -> float:
        return 1 / (self.a - 1)

    def prox(self, z, t, lam, w):
        return scad_map(z, t, lam * w, self.a)

    def value(self, beta, lam, w):
        return float(np.sum(scad_value(beta, lam * w, self.a)))


@dataclass(frozen=True)
class Bridge:
    """|b|^q by reweighted lassos."""

    q: float = 0.5
    eps: float = 1e-6
    rounds: int = 10
    kind = "lla"
    convex = False
    l1 = 1.0

    def surrogate(self, beta, lam, groups, group_w, coord_w):
        return self.q * (np.abs(beta) + self.eps) ** (self.q - 1) * coord_w

    def lambda_max(self, grad, groups, group_w, coord_w):
        ok = coord_w > 0
        return float(np.max(np.abs(grad[ok]) / coord_w[ok], initial=0.0))


@dataclass(frozen=True)
class CompositeMCP:
    """MCP of a group's summed MCPs, by reweighted lassos."""

    gamma1: float = 3.0
    gamma2: float = 3.0
    rounds: int = 10
    kind = "lla"
    convex = False

    def surrogate(self, beta, lam, groups, group_w, coord_w):
        slope = lambda b, g: np.maximum(1 - np.abs(b) / (g * lam), 0.0)
        inner = np.bincount(groups, coord_w * mcp_value(beta, lam, self.gamma2), len(group_w))
        return (group_w * slope(inner, self.gamma1))[groups] * lam * coord_w * slope(beta, self.gamma2)

    def lambda_max(self, grad, groups, group_w, coord_w):
        w = group_w[groups] * coord_w
        return float(np.sqrt(np.max(np.abs(grad[w > 0]) / w[w > 0], initial=0.0)))


@dataclass(frozen=True)
class GroupExponential:
    """Exponential of a group's L1 norm, by reweighted lassos."""

    tau: float = 1.0
    rounds: int = 10
    kind = "lla"
    convex = False

    def surrogate(self, beta, lam, groups, group_w, coord_w):
        size = np.bincount(groups, np.abs(beta), len(group_w))
        return (group_w * np.exp(-self.tau * size / lam))[groups]

    def lambda_max(self, grad, groups, group_w, coord_w):
        w = group_w[groups]
        return float(np.max(np.abs(grad[w > 0]) / w[w > 0], initial=0.0))


def _scaled(block, norm, factor):
    return block * factor if norm > 0 else np.zeros_like(block)


def group_soft(block, level):
    norm = np.linalg.norm(block)
    return block * (1 - level / norm) if norm > level else np.zeros_like(block)


@dataclass(frozen=True)
class GroupElasticNet:
    alpha: float = 0.5
    kind = "group"
    convex = True

    @property
    def l1(self) -> float:
        return self.alpha

    def prox_group(self, block, t, lam, w, v):
        return group_soft(block, t * self.alpha * lam * w) / (1 + t * (1 - self.alpha) * lam * w)

    def value(self, norms, lam, w):
        return float(np.sum(lam * w * (self.alpha * norms + (1 - self.alpha) * norms**2 / 2)))


def GroupLasso() -> GroupElasticNet:  # noqa: N802
    return GroupElasticNet(1.0)


@dataclass(frozen=True)
class GroupMCP:
    gamma: float = 3.0
    kind = "group"
    convex = False
    l1 = 1.0

    @property
    def concavity(self) -> float:
        return 1 / self.gamma

    def prox_group(self, block, t, lam, w, v):
        level, norm = lam * w, np.linalg.norm(block)
        if norm >= self.gamma * level:
            return block
        if self.gamma <= t:
            return block if norm > np.sqrt(t * self.gamma * level**2) else np.zeros_like(block)
        return _scaled(block, norm, (1 - t * level / norm) / (1 - t / self.gamma)) if norm > t * level else np.zeros_like(block)

    def value(self, norms, lam, w):
        return float(np.sum(mcp_value(norms, lam * w, self.gamma)))


@dataclass(frozen=True)
class GroupSCAD:
    a: float = 3.7
    kind = "group"
    convex = False
    l1 = 1.0

    @property
    def concavity(self) -> float:
        return 1 / (self.a - 1)

    def prox_group(self, block, t, lam, w, v):
        a, level, norm = max(self.a, 1 + t + 1e-9), lam * w, np.linalg.norm(block)
        if norm > a * level:
            return block
        if norm <= (1 + t) * level:
            return group_soft(block, t * level)
        return block * ((a - 1) * norm - t * a * level) / ((a - 1 - t) * norm)

    def value(self, norms, lam, w):
        return float(np.sum(scad_value(norms, lam * w, self.a)))


@dataclass(frozen=True)
class SparseGroupLasso:
    alpha: float = 0.5
    kind = "group"
    convex = True
    sparse = True
    l1 = 1.0

    def prox_group(self, block, t, lam, w, v):
        return group_soft(soft(block, self.alpha * t * lam * v), (1 - self.alpha) * t * lam * w)


@dataclass(frozen=True)
class SparseGroupMCP:
    alpha: float = 0.5
    gamma: float = 3.0
    kind = "group"
    convex = False
    sparse = True
    l1 = 1.0

    @property
    def concavity(self) -> float:
        return 1 / self.gamma

    def prox_group(self, block, t, lam, w, v):
        return GroupMCP(self.gamma).prox_group(firm(block, t, self.alpha * lam * v, self.gamma), t, (1 - self.alpha) * lam, w, v)


@dataclass(frozen=True)
class SparseGroupSCAD:
    alpha: float = 0.5
    a: float = 3.7
    kind = "group"
    convex = False
    sparse = True
    l1 = 1.0

    @property
    def concavity(self) -> float:
        return 1 / (self.a - 1)

    def prox_group(self, block, t, lam, w, v):
        return GroupSCAD(self.a).prox_group(scad_map(block, t, self.alpha * lam * v, self.a), t, (1 - self.alpha) * lam, w, v)
