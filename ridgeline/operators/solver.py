"""Coordinate and block descent on moments: minimise b'Gb/2 - c'b + penalty, all on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ridgeline.operators.penalties import MCP, SCAD, ElasticNet, Lasso

MAX_SWEEPS = 10_000
TOL = 1e-9
#: Rounds of a leap from pieces to pieces, where the penalty is convex and the way can't matter; steps of its solver; sweeps before the next.
LEAPS, CONJUGATE_STEPS, SWEEPS_BETWEEN = 4, 100, 2


@dataclass
class Problem:
    """G, c and the structure of the penalty. `tasks` responses share G; then coefficients are (p, tasks) and rows are groups."""

    gram: np.ndarray
    cross: np.ndarray  # (p,) or (p, tasks)
    penalty: object
    weights: np.ndarray  # per feature for scalar penalties, per group for group ones
    groups: np.ndarray | None = None  # group number of each feature
    coord_weights: np.ndarray | None = None
    free: np.ndarray | None = None  # features without penalty
    members: list[np.ndarray] = field(default_factory=list)
    step: np.ndarray | None = None

    def __post_init__(self):
        p = len(self.cross)
        if self.coord_weights is None:
            self.coord_weights = np.ones(p)
        if self.penalty.kind == "group" and self.cross.ndim == 1:
            self.members = [np.flatnonzero(self.groups == g) for g in range(int(self.groups.max()) + 1)] if p else []
            self.step = np.array([np.linalg.eigvalsh(self.gram[np.ix_(m, m)])[-1] if len(m) > 1 else self.gram[m[0], m[0]] for m in self.members])

    def lambda_max(self) -> float:
        """The largest lambda of the automatic grid. Parts with weight 0 don't count."""
        pen = self.penalty
        if self.cross.ndim == 2:
            norms, w = np.linalg.norm(self.cross, axis=1), self.weights * pen.l1
        elif pen.kind == "scalar":
            norms, w = np.abs(self.cross), self.weights * pen.l1
        elif pen.kind == "lla":
            return pen.lambda_max(self.cross, self.groups, self.weights, self.coord_weights)
        else:
            norms, w = np.array([np.linalg.norm(self.cross[m]) for m in self.members]), self.weights * pen.l1
        ok = w > 0
        return float(np.max(norms[ok] / w[ok], initial=0.0))


def lambda_grid(top: float, n: int = 100, ratio: float = 1e-3) -> np.ndarray:
    """Geometric, both ends included; one value is the top."""
    if top <= 0 or not math.isfinite(top):
        raise ValueError("no positive lambda_max; give the lambdas")
    return np.array([top]) if n == 1 else top * ratio ** (np.arange(n) / (n - 1))


def _cells(kind: str, a: float, u: np.ndarray, d: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The piece of the penalty each coordinate is on at u = d * beta + gradient: (signed number of the piece, what it adds to the
    diagonal, what it takes from the cross products). On a fixed piece of every coordinate the minimum solves a linear system."""
    s, size = np.sign(u), np.abs(u)
    if kind == "en":
        return s * (size > a * level), (1 - a) * level, s * a * level
    if kind == "mcp":
        inner = size <= a * level
        return s * np.where(size <= level, 0, np.where(inner, 1, 2)), np.where(inner, -d / a, 0.0), np.where(inner, s * level, 0.0)
    low, middle = size <= 2 * level, size <= a * level
    number = np.where(size <= level, 0, np.where(low, 1, np.where(middle, 2, 3)))
    bend = np.where(low | ~middle, 0.0, -d / (a - 1))
    return s * number, bend, np.where(low, s * level, np.where(middle, s * a * level / (a - 1), 0.0))


def _conjugate(g: np.ndarray, rhs: np.ndarray, start: np.ndarray, bend: np.ndarray, root: np.ndarray, tol: float) -> np.ndarray | None:
    """Solves (g + diag(bend)) x = rhs by conjugate gradients from `start`; None where curvature isn't positive or steps run out."""
    scale = 1 / np.maximum(root * root + bend, 1e-300)  # Jacobi preconditioner
    x = start.copy()
    r = rhs - g @ x - bend * x
    z = scale * r
    way, size = z.copy(), r @ z
    for _ in range(CONJUGATE_STEPS):
        if (np.abs(r) / root).max(initial=0.0) < tol:
            return x
        image = g @ way + bend * way
        curve = way @ image
        if curve <= 0:
            return None
        step = size / curve
        x += step * way
        r -= step * image
        z = scale * r
        size, before = r @ z, size
        way = z + (size / before) * way
    return None


def _leap(kind: str, a: float, prob: Problem, root: np.ndarray, level: np.ndarray, beta: np.ndarray, grad: np.ndarray, among: np.ndarray, tol: float, rounds: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(coefficients, gradient) at the minimum on the present pieces of the coordinates `among`, or None unless it is found and
    lies on the same pieces, so that no coordinate's own step moves it. More rounds go on from the pieces where it lies."""
    g, c, d = prob.gram, prob.cross, root * root
    pieces, bend, shift = _cells(kind, a, d * beta + grad, d, level)
    for _ in range(rounds):
        on = np.flatnonzero((pieces != 0) & among)
        new = np.zeros_like(beta)
        if len(on):
            found = _conjugate(g[np.ix_(on, on)], c[on] - shift[on], beta[on], bend[on], root[on], tol)
            if found is None:
                return None
            new[on] = found
        grad, old = c - g @ new, pieces
        pieces, bend, shift = _cells(kind, a, d * new + grad, d, level)
        if np.array_equal(pieces[among], old[among]):
            return new, grad
        beta = new
    return None


def _scalar_descent(prob: Problem, beta: np.ndarray, lam: float, tol: float, sweeps: int) -> tuple[np.ndarray, int, bool]:
    """Cyclic descent over a working set: the coordinates in use and those that a step from the present point would move.

    All coordinates are checked at once whenever the set has settled, so none is screened away. Between sweeps the set's
    minimum on the present pieces of the penalty is solved for, and taken where it lies on them.
    """
    g, c, pen = prob.gram, prob.cross, prob.penalty
    diag, weight = np.diag(g), np.broadcast_to(prob.weights, len(c))
    able = diag > 0
    safe = np.where(able, diag, 1.0)
    root, level = np.sqrt(safe), lam * weight
    kind, a = {ElasticNet: ("en", "alpha"), MCP: ("mcp", "gamma"), SCAD: ("scad", "a")}.get(type(pen), ("other", ""))
    a = getattr(pen, a) if a else 0.0  # any other penalty is asked for its own map
    beta[~able] = 0.0
    done, leaps, grad = 0, kind != "other", c - g @ beta
    inside, leapt, settled = np.zeros(len(c), bool), False, False
    while True:
        moved = np.abs(pen.prox(beta + grad / safe, 1 / safe, lam, weight) - beta) * root
        moved[~able | (inside & settled)] = 0.0  # sweeps that settled can't do better on their own set
        if moved.max(initial=0.0) < tol:
            return beta, max(done, 1), True
        if done >= sweeps:
            return beta, done, False
        leaps = leaps and not (leapt and not (moved >= tol)[~inside].any())  # a leap that is short of tol isn't repeated
        inside = among = (beta != 0.0) | (moved >= tol)
        found = _leap(kind, a, prob, root, level, beta, grad, among, tol / 10, LEAPS if kind == "en" else 1) if leaps else None
        leapt = found is not None
        if leapt:
            beta, grad = found
            done, settled = done + 1, False
            continue
        at = np.flatnonzero(among)
        beta[at], made, settled = _sweeps(kind, a, pen, g[np.ix_(at, at)], grad[at], lam, weight[at], beta[at], tol, min(sweeps - done, SWEEPS_BETWEEN) if leaps else sweeps - done)
        grad = c - g @ beta
        done += made


def _sweeps(kind: str, a: float, pen, g: np.ndarray, grad: np.ndarray, lam: float, weight: np.ndarray, beta: np.ndarray, tol: float, sweeps: int) -> tuple[np.ndarray, int, bool]:
    """(coefficients, sweeps made, whether none moved by tol in the last) of a small problem."""
    d, level, values = np.diag(g).tolist(), (lam * weight).tolist(), beta.tolist()
    for sweep in range(1, sweeps + 1):
        largest = 0.0
        for j, old in enumerate(values):
            v, lev = d[j], level[j]
            u = grad.item(j) + v * old
            s = abs(u)
            if kind == "en":
                new = 0.0 if s <= a * lev else math.copysign(s - a * lev, u) / (v + (1 - a) * lev)
            elif kind == "mcp":
                new = 0.0 if s <= lev else math.copysign(s - lev, u) / (v * (1 - 1 / a)) if s <= a * lev else u / v
            elif kind == "scad":
                new = 0.0 if s <= lev else math.copysign(s - lev, u) / v if s <= 2 * lev else math.copysign(s - a * lev / (a - 1), u) / (v * (1 - 1 / (a - 1))) if s <= a * lev else u / v
            else:
                new = float(pen.prox(np.float64(u / v), 1 / v, lam, weight[j]))
            if new != old:
                grad -= g[j] * (new - old)
                values[j] = new
                largest = max(largest, abs(new - old) * math.sqrt(v))
        if largest < tol:
            return np.array(values), sweep, True
    return np.array(values), sweeps, False


def _block_descent(prob: Problem, beta: np.ndarray, lam: float, tol: float, sweeps: int) -> tuple[np.ndarray, int, bool]:
    g, pen, v = prob.gram, prob.penalty, prob.coord_weights
    grad = prob.cross - g @ beta
    settled, active = False, []
    every = [k for k, s in enumerate(prob.step) if s > 0]
    rows = [g[m] for m in prob.members]
    for sweep in range(1, sweeps + 1):
        full = sweep == 1 or settled or not active
        settled, largest = False, 0.0
        for k in every if full else active:
            m, lip = prob.members[k], prob.step[k]
            old = beta[m]
            new = pen.prox_group(old + grad[m] / lip, 1 / lip, lam, prob.weights[k], v[m])
            moved = new - old
            size = np.abs(moved).max()
            if size > 0:
                grad -= moved @ rows[k]
                beta[m] = new
                largest = max(largest, size * math.sqrt(lip))
        if largest < tol:
            if full:
                return beta, sweep, True
            settled = True
        if full:
            active = [k for k in every if beta[prob.members[k]].any()]
    return beta, sweeps, False


def _task_descent(prob: Problem, beta: np.ndarray, lam: float, tol: float, sweeps: int) -> tuple[np.ndarray, int, bool]:
    """beta is (p, tasks): a row is a block, and its curvature is the same for all tasks."""
    g, pen = prob.gram, prob.penalty
    grad = prob.cross - g @ beta
    diag = np.diag(g)
    ones = np.ones(beta.shape[1])
    every = np.flatnonzero(diag > 0).tolist()
    settled, active = False, []
    for sweep in range(1, sweeps + 1):
        full = sweep == 1 or settled or not active
        settled, largest = False, 0.0
        for j in every if full else active:
            v = diag[j]
            old = beta[j].copy()
            z = old + grad[j] / v
            new = pen.prox_group(z, 1 / v, lam, prob.weights[j], ones)
            moved = new - old
            size = np.abs(moved).max()
            if size > 0:
                grad -= np.outer(g[j], moved)
                beta[j] = new
                largest = max(largest, size * math.sqrt(v))
        if largest < tol:
            if full:
                return beta, sweep, True
            settled = True
        if full:
            active = [j for j in every if beta[j].any()]
    return beta, sweeps, False


def solve(prob: Problem, lam: float, start: np.ndarray, *, tol: float = TOL, sweeps: int = MAX_SWEEPS) -> tuple[np.ndarray, int, bool]:
    """Minimiser from `start` at one lambda, sweeps made, whether changes fell below tol. Cyclic order."""
    beta = start.copy()
    scale = tol * max(1.0, math.sqrt(abs(prob.gram).max()) * 1e-3) if prob.gram.size else tol
    if prob.cross.ndim == 2:
        return _task_descent(prob, beta, lam, scale, sweeps)
    if prob.penalty.kind == "scalar":
        return _scalar_descent(prob, beta, lam, scale, sweeps)
    if prob.penalty.kind == "group":
        return _block_descent(prob, beta, lam, scale, sweeps)
    total = 0
    lasso = Problem(prob.gram, prob.cross, Lasso(), prob.weights)
    weights = prob.penalty.surrogate(beta, lam, prob.groups, prob.weights, prob.coord_weights)
    for _ in range(prob.penalty.rounds):
        lasso.weights = weights
        beta, n, ok = _scalar_descent(lasso, beta, lam, scale, sweeps)
        total += n
        new = prob.penalty.surrogate(beta, lam, prob.groups, prob.weights, prob.coord_weights)
        if np.abs(new - weights).max(initial=0.0) < 1e-8:
            return beta, total, ok
        weights = new
    return beta, total, False


def kkt_residual(prob: Problem, beta: np.ndarray, lam: float) -> float:
    """How far one prox step from beta moves, largest over coordinates or blocks; 0 at a stationary point."""
    grad = prob.cross - prob.gram @ beta
    pen = prob.penalty
    if pen.kind == "scalar" and beta.ndim == 1:
        d = np.diag(prob.gram)
        ok = d > 0
        z = beta[ok] + grad[ok] / d[ok]
        w = np.broadcast_to(prob.weights, len(beta))[ok]
        return float(max((abs(float(pen.prox(zi, 1 / di, lam, wi)) - b) for zi, di, wi, b in zip(z, d[ok], w, beta[ok], strict=True)), default=0.0))
    if beta.ndim == 2:
        d = np.diag(prob.gram)
        return float(max((np.abs(pen.prox_group(beta[j] + grad[j] / d[j], 1 / d[j], lam, prob.weights[j], np.ones(beta.shape[1])) - beta[j]).max() for j in range(len(beta)) if d[j] > 0), default=0.0))
    return float(max((np.abs(pen.prox_group(beta[m] + grad[m] / s, 1 / s, lam, prob.weights[k], prob.coord_weights[m]) - beta[m]).max() for k, (m, s) in enumerate(zip(prob.members, prob.step, strict=True)) if s > 0), default=0.0))


def convex_min_index(gram: np.ndarray, coefs: np.ndarray, penalty, groups: np.ndarray | None = None) -> int | None:
    """First place on the path where a nonzero coordinate (or group) has less curvature than the penalty takes away; None if nowhere."""
    bend = getattr(penalty, "concavity", None)
    if bend is None:
        return None
    if groups is None:
        curve = np.diag(gram)
        for i, b in enumerate(coefs):
            if (curve[np.abs(b) > 1e-8] < bend).any():
                return i
        return None
    members = [np.flatnonzero(groups == g) for g in range(int(groups.max()) + 1)]
    curve = np.array([np.linalg.eigvalsh(gram[np.ix_(m, m)])[0] for m in members])
    for i, b in enumerate(coefs):
        on = np.array([np.linalg.norm(b[m]) > 1e-8 for m in members])
        if (curve[on] < bend).any():
            return i
    return None


def orthonormalize(gram: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Block matrix T with T'GT the identity within each group; coefficients go back by T."""
    out = np.zeros_like(gram)
    for g in range(int(groups.max()) + 1):
        m = np.flatnonzero(groups == g)
        block = gram[np.ix_(m, m)]
        values = np.linalg.eigvalsh(block)
        if values[0] <= 1e-10 * max(values[-1], 1e-300):
            raise ValueError(f"group {g} is rank deficient")
        out[np.ix_(m, m)] = np.linalg.inv(np.linalg.cholesky(block)).T
    return out
