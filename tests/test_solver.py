"""Driver-side solvers: closed forms, limit identities and stationarity."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.operators import penalties as P
from ridgeline.operators.solver import Problem, kkt_residual, lambda_grid, orthonormalize, solve


def problem(penalty, p=6, seed=0, groups=None, weights=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((200, p))
    beta = np.zeros(p)
    beta[:3] = 1.5, -2.0, 0.8
    y = x @ beta + 0.1 * rng.standard_normal(200)
    size = p if groups is None else max(groups) + 1
    return Problem(x.T @ x / 200, x.T @ y / 200, penalty, np.ones(size) if weights is None else weights, None if groups is None else np.array(groups))


GROUPS = [0, 0, 1, 1, 2, 2]
ALL = [P.Lasso(), P.ElasticNet(0.5), P.MCP(3.0), P.SCAD(3.7)]
BLOCK = [P.GroupLasso(), P.GroupElasticNet(0.4), P.GroupMCP(3.0), P.GroupSCAD(3.7), P.SparseGroupLasso(), P.SparseGroupMCP(), P.SparseGroupSCAD()]


@pytest.mark.parametrize("penalty", ALL)
def test_scalar_solutions_are_stationary(penalty):
    prob = problem(penalty)
    beta = np.zeros(6)
    for lam in lambda_grid(prob.lambda_max(), 20, 0.01):
        beta, _, ok = solve(prob, lam, beta)
        assert ok and kkt_residual(prob, beta, lam) < 1e-7


@pytest.mark.parametrize("penalty", BLOCK)
def test_block_solutions_are_stationary(penalty):
    prob = problem(penalty, groups=GROUPS)
    beta = np.zeros(6)
    for lam in lambda_grid(prob.lambda_max(), 15, 0.01):
        beta, _, ok = solve(prob, lam, beta)
        assert ok and kkt_residual(prob, beta, lam) < 1e-7


def test_nothing_is_active_at_the_top():
    for penalty in ALL:
        prob = problem(penalty)
        assert not solve(prob, prob.lambda_max() * 1.000001, np.zeros(6))[0].any()


def test_limits():
    lasso = solve(problem(P.Lasso()), 0.2, np.zeros(6))[0]
    assert np.allclose(solve(problem(P.MCP(1e9)), 0.2, np.zeros(6))[0], lasso, atol=1e-7)
    assert np.allclose(solve(problem(P.ElasticNet(1.0)), 0.2, np.zeros(6))[0], lasso)
    assert np.allclose(solve(problem(P.GroupLasso(), groups=range(6)), 0.2, np.zeros(6))[0], lasso, atol=1e-7)
    assert np.allclose(solve(problem(P.SparseGroupLasso(1.0), groups=GROUPS), 0.2, np.zeros(6))[0], lasso, atol=1e-7)
    group = solve(problem(P.GroupLasso(), groups=GROUPS), 0.2, np.zeros(6))[0]
    assert np.allclose(solve(problem(P.GroupElasticNet(1.0), groups=GROUPS), 0.2, np.zeros(6))[0], group)
    bridge = Problem(problem(P.Lasso()).gram, problem(P.Lasso()).cross, P.Bridge(1.0), np.ones(1), np.zeros(6, int), np.ones(6))
    assert np.allclose(solve(bridge, 0.2, np.zeros(6))[0], lasso, atol=1e-6)


def test_orthonormal_design_is_the_prox_of_least_squares():
    c = np.array([1.0, -0.3, 0.05, 2.0])
    for penalty in ALL:
        got = solve(Problem(np.eye(4), c, penalty, np.ones(4)), 0.1, np.zeros(4))[0]
        assert np.allclose(got, penalty.prox(c, 1.0, 0.1, np.ones(4)))


def test_bilevel_penalties_keep_the_signal():
    for penalty in (P.CompositeMCP(), P.GroupExponential()):
        base = problem(P.Lasso())
        prob = Problem(base.gram, base.cross, penalty, np.ones(3), np.array(GROUPS), np.ones(6))
        beta, _, _ = solve(prob, prob.lambda_max() * 0.05, np.zeros(6))
        assert np.sign(beta[:3]).tolist() == [1, -1, 1]
        assert not solve(prob, prob.lambda_max() * 1.0001, np.zeros(6))[0].any()


@given(st.integers(0, 10_000))
@settings(max_examples=20, deadline=None)
def test_permuting_features_permutes_coefficients(seed):
    prob = problem(P.Lasso(), seed=seed)
    order = np.random.default_rng(seed).permutation(6)
    turned = Problem(prob.gram[np.ix_(order, order)], prob.cross[order], P.Lasso(), np.ones(6))
    assert np.allclose(solve(turned, 0.1, np.zeros(6))[0], solve(prob, 0.1, np.zeros(6))[0][order], atol=1e-7)


def test_orthonormalize():
    prob = problem(P.Lasso())
    t = orthonormalize(prob.gram, np.array(GROUPS))
    turned = t.T @ prob.gram @ t
    assert np.allclose(turned[:2, :2], np.eye(2)) and np.allclose(turned[4:, 4:], np.eye(2))
    with pytest.raises(ValueError):
        orthonormalize(np.ones((2, 2)), np.array([0, 0]))


def plain_descent(prob, lam, beta, sweeps):
    """Coordinate descent by the penalty's own map, one coordinate after the other."""
    for _ in range(sweeps):
        for j in range(len(beta)):
            v = prob.gram[j, j]
            if v > 0:
                z = beta[j] + (prob.cross[j] - prob.gram[j] @ beta) / v
                beta[j] = float(prob.penalty.prox(np.float64(z), 1 / v, lam, prob.weights[j]))
    return beta


@pytest.mark.parametrize("penalty", [P.Lasso(), P.ElasticNet(0.3), P.MCP(3.0), P.SCAD(3.7)])
@pytest.mark.parametrize("kind", ["tall", "wide", "collinear"])
def test_descent_with_leaps_ends_where_plain_descent_does(penalty, kind):
    rng = np.random.default_rng(len(kind))
    n, p = (30, 60) if kind == "wide" else (200, 25)
    x = rng.standard_normal((n, p)) * np.exp(rng.uniform(-2, 2, p))
    x[:, 3] = 0.0
    if kind == "collinear":
        x[:, 5] = x[:, 4] + 1e-3 * rng.standard_normal(n)
        x[:, 7] = x[:, 6]
    y = x[:, :5] @ rng.standard_normal(5) + rng.standard_normal(n)
    weights = np.ones(p)
    weights[1] = 0.0  # without penalty
    prob = Problem(x.T @ x / n, x.T @ y / n, penalty, weights)
    beta = np.zeros(p)
    for lam in prob.lambda_max() * np.array([0.8, 0.3, 0.1, 0.03]):
        beta, _, ok = solve(prob, lam, beta, tol=1e-11)
        assert ok and kkt_residual(prob, beta, lam) < 1e-6
        if type(penalty) is P.ElasticNet:
            other = plain_descent(prob, lam, np.zeros(p), 3000)
            goal = lambda b: b @ prob.gram @ b / 2 - prob.cross @ b + penalty.value(b, lam, weights)
            assert goal(beta) <= goal(other) + 1e-9
        else:
            assert np.allclose(plain_descent(prob, lam, beta.copy(), 50), beta, atol=1e-6)


def test_tolerance_below_rounding_still_ends():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((100, 8)) * 1e4
    prob = Problem(x.T @ x / 100, x.T @ (x[:, 0] * 1e3 + rng.standard_normal(100)) / 100, P.Lasso(), np.ones(8))
    _, sweeps, ok = solve(prob, prob.lambda_max() / 50, np.zeros(8), tol=1e-16)
    assert ok and sweeps < 1000
