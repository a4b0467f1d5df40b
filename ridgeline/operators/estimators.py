"""Named estimators: a family, a penalty and a mode (one lambda, path, cross-validated, adaptive) each, made by rule.

estimator("LogisticGroupMCPPathRegressor") or `from ridgeline.operators.estimators import LogisticGroupMCPPathRegressor`.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from ridgeline.operators import penalties as pen
from ridgeline.operators.graphs import GraphicalLasso, GraphicalMCP, GraphicalSCAD, JointGraphicalLasso, JointGraphicalMCP  # noqa: F401
from ridgeline.operators.moments import moments
from ridgeline.operators.paths import PathResult, adaptive_weights, fit_path
from ridgeline.operators.scoring import predict
from ridgeline.operators.selection import CVResult, cross_validate

FAMILIES = {"": "gaussian", "Logistic": "binomial", "Poisson": "poisson", "Cox": "cox", "Huber": "huber", "Multinomial": "multinomial", "MultiTask": "gaussian"}

#: Penalty name -> (class, parameter names).
PENALTIES = {
    "Lasso": (pen.Lasso, ()),
    "ElasticNet": (pen.ElasticNet, ("alpha",)),
    "MCP": (pen.MCP, ("gamma",)),
    "SCAD": (pen.SCAD, ("a",)),
    "Bridge": (pen.Bridge, ("q", "eps")),
    "GroupLasso": (pen.GroupLasso, ()),
    "GroupElasticNet": (pen.GroupElasticNet, ("alpha",)),
    "GroupMCP": (pen.GroupMCP, ("gamma",)),
    "GroupSCAD": (pen.GroupSCAD, ("a",)),
    "SparseGroupLasso": (pen.SparseGroupLasso, ("alpha",)),
    "SparseGroupMCP": (pen.SparseGroupMCP, ("alpha", "gamma")),
    "SparseGroupSCAD": (pen.SparseGroupSCAD, ("alpha", "a")),
    "CompositeMCP": (pen.CompositeMCP, ("gamma1", "gamma2")),
    "GroupExponential": (pen.GroupExponential, ("tau",)),
}

_NAME = re.compile(f"(Adaptive)?({'|'.join(f for f in FAMILIES if f)})?({'|'.join(sorted(PENALTIES, key=len, reverse=True))})(Path)?(Regressor|Classifier|CV)")


class Estimator:
    """fit(df, features, y, ...) then coefficients(), predict(); CV modes also cv_table() and best_index_."""

    def __init__(self, name: str, **options):
        found = _NAME.fullmatch(name)
        if not found:
            raise AttributeError(name)
        adaptive, family, penalty, path, _ = found.groups()
        self.name, self.adaptive, self.family, self.cv = name, bool(adaptive), FAMILIES[family or ""], name.endswith("CV")
        self.row_groups = family in ("Multinomial", "MultiTask")
        kind = f"Group{penalty}" if self.row_groups else penalty
        make, parameters = PENALTIES[kind]
        given = {k: options.pop(k) for k in parameters if k in options}
        self.penalty = make(**given)
        self.lambda_ = options.pop("lambda_", 0.1) if not path and not self.cv else None
        self.groups = options.pop("groups", None)
        self.options = options

    def fit(self, df: DataFrame, features: list[str] | str, y: str | list[str], *, event: str | None = None, fold: str | None = None, sample_weight: str | None = None, offset: str | None = None) -> Estimator:
        kwargs = dict(self.options)
        if self.lambda_ is not None:
            kwargs["lambdas"] = [self.lambda_]
        common = {"family": self.family, **({"groups": self.groups} if self.groups is not None else {}), **({"event": event} if event else {}), **({"offset": offset} if offset else {}), **({"sample_weight": sample_weight} if sample_weight else {})}
        self.array_column_ = features if isinstance(features, str) else None
        if self.adaptive:  # the pilot's weights are fixed over folds
            pilot = {k: kwargs.pop(k) for k in ("pilot_index", "eta", "eps", "pilot") if k in kwargs}
            kwargs["weights"] = adaptive_weights(df, features, y, self.penalty, **pilot, **common, **kwargs)
        if self.cv:
            self.cv_ = cross_validate(df, features, y, self.penalty, fold, **common, **kwargs)
            path = self.cv_.path
        else:
            path = fit_path(df, features, y, self.penalty, **common, **kwargs)
        self.result_: PathResult = path
        self.best_index_ = self.cv_.best if self.cv else len(path.lambdas) - 1
        return self

    def coefficients(self, df: DataFrame) -> DataFrame:
        return self.result_.coefficients(df.sparkSession)

    def cv_table(self, df: DataFrame) -> DataFrame:
        result: CVResult = self.cv_
        return result.table(df.sparkSession)

    def predict(self, df: DataFrame, index: int | None = None, offset: str | None = None) -> DataFrame:
        return predict(df, self.result_, self.best_index_ if index is None else index, features=self.array_column_, offset=offset)


_ROW = ("Lasso", "MCP", "SCAD", "ElasticNet")
_GLM = ("MCP", "SCAD", "ElasticNet", "Lasso", "GroupLasso", "GroupMCP", "SparseGroupLasso", "SparseGroupMCP", "SparseGroupSCAD")
_LS = ("MCP", "SCAD", "ElasticNet", "Bridge", "GroupLasso", "GroupElasticNet", "GroupMCP", "GroupSCAD", "SparseGroupLasso", "SparseGroupMCP", "SparseGroupSCAD")


def names() -> list[str]:
    """Every combination of family, penalty and mode."""
    out = [f"{p}{m}" for p in _LS for m in ("Regressor", "PathRegressor", "PathCV")] + ["CompositeMCPPathRegressor", "GroupExponentialPathRegressor"]
    out += [f"{f}{p}{m}" for f in ("Logistic", "Poisson") for p in _GLM for m in ("Regressor", "PathRegressor", "PathCV")]
    out += [f"Cox{p}{m}" for p in _GLM if p not in ("ElasticNet", "Lasso") for m in ("Regressor", "PathRegressor", "PathCV")]
    out += [f"Huber{p}{m}" for p in ("MCP", "SCAD") for m in ("Regressor", "PathRegressor")]
    out += [f"Adaptive{f}{p}Path{m}" for f in ("", "Logistic", "Poisson", "Cox") for p in ("Lasso", "MCP", "SCAD") for m in ("Regressor", "CV")]
    out += [f"AdaptiveGroup{p}Path{m}" for p in ("Lasso", "MCP", "SCAD") for m in ("Regressor", "CV")]
    out += [f"MultiTask{p}{m}" for p in _ROW for m in ("Regressor", "PathRegressor", "PathCV")]
    out += [f"Multinomial{p}{m}" for p in _ROW for m in ("Classifier", "PathClassifier", "PathCV")]
    return out


def estimator(name: str, **options) -> Estimator:
    return Estimator(name, **options)


def __getattr__(name: str):
    if _NAME.fullmatch(name):
        return lambda **options: Estimator(name, **options)
    raise AttributeError(name)


def fit_with_orthonormalization(df: DataFrame, features: list[str], y: str, penalty, groups, **grid) -> PathResult:
    """A group path in a basis where each group's columns are orthonormal, with coefficients of the original columns."""
    from ridgeline.operators.moments import Moments
    from ridgeline.operators.paths import Spec, group_numbers, path_from_moments
    from ridgeline.operators.solver import orthonormalize

    m = moments(df, features, [y])
    number = group_numbers(groups, m.names)
    t = orthonormalize(m.centered()[: m.p, : m.p], number)
    whole = np.eye(m.p + 1)
    whole[: m.p, : m.p] = t
    turned = Moments(m.n, m.mass, whole.T @ m.shift, whole.T @ m.first, whole.T @ m.second @ whole, m.p, m.names)
    path = path_from_moments(turned, Spec(penalty, m.names, groups=number), **grid)
    path.coefs = path.coefs @ t.T
    return path
