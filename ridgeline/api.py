"""The public surface in one place: every named estimator, function and class.

`from ridgeline.api import LogisticMCPPathCV, debiased_lasso, select_by_ic`.
"""

from __future__ import annotations

from functools import partial

from ridgeline.operators import estimators as _estimators
from ridgeline.operators.estimators import estimator, fit_with_orthonormalization, names
from ridgeline.operators.graphs import (
    GraphicalBootstrap,
    GraphicalLasso,
    GraphicalMCP,
    GraphicalSCAD,
    GraphicalStabilitySelection,
    JointGraphicalLasso,
    JointGraphicalMCP,
    ebic_path,
    edge_pvalues,
    joint_ebic_path,
    mb_stability_threshold,
)
from ridgeline.operators.graphs import edge_fdr as edge_fdr_threshold
from ridgeline.operators.graphs import edge_fwer as edge_fwer_threshold
from ridgeline.operators.inference import debiased_glm, debiased_lasso
from ridgeline.operators.moments import Moments, moments
from ridgeline.operators.ordinal import mixed_correlation as polychoric_covariance_matrix
from ridgeline.operators.ordinal import polychoric_correlation, polyserial_correlation
from ridgeline.operators.paths import PathResult, adaptive_path, fit_path
from ridgeline.operators.scoring import predict, predict_all
from ridgeline.operators.selection import MFDR, StabilitySelection, cross_validate, select_by_ic, select_by_mfdr, stratified_folds
from ridgeline.operators.selection import mfdr as estimate_mfdr
from ridgeline.operators.solver import orthonormalize as orthonormalize_groups
from ridgeline.operators.wide import wide_path
from ridgeline.sources.readers import from_triples, read_matrix, read_table
from ridgeline.streaming.running import RunningMoments

debiased_logistic_lasso = partial(debiased_glm, family="binomial")
debiased_poisson_lasso = partial(debiased_glm, family="poisson")
debiased_cox_lasso = partial(debiased_glm, family="cox")


class DebiasedRegressor:
    """fit(df, features, y, ...) then result_.table(spark): a debiased lasso of one family with fixed options."""

    def __init__(self, family: str, **options):
        self.family, self.options = family, options

    def fit(self, df, features, y, **columns) -> DebiasedRegressor:
        own = self.options | columns
        self.result_ = debiased_lasso(df, features, y, **own) if self.family == "gaussian" else debiased_glm(df, features, y, self.family, **own)
        return self

    def confidence_intervals(self, df):
        return self.result_.table(df.sparkSession)


DebiasedLassoRegressor = partial(DebiasedRegressor, "gaussian")
DebiasedLogisticLassoRegressor = partial(DebiasedRegressor, "binomial")
DebiasedPoissonLassoRegressor = partial(DebiasedRegressor, "poisson")
DebiasedCoxLassoRegressor = partial(DebiasedRegressor, "cox")

__all__ = [
    "DebiasedCoxLassoRegressor", "DebiasedLassoRegressor", "DebiasedLogisticLassoRegressor", "DebiasedPoissonLassoRegressor", "DebiasedRegressor", "GraphicalBootstrap", "GraphicalLasso", "GraphicalMCP",
    "GraphicalSCAD", "GraphicalStabilitySelection", "JointGraphicalLasso", "JointGraphicalMCP", "MFDR", "Moments", "PathResult", "RunningMoments", "StabilitySelection", "adaptive_path", "cross_validate",
    "debiased_cox_lasso", "debiased_glm", "debiased_lasso", "debiased_logistic_lasso", "debiased_poisson_lasso", "ebic_path", "edge_fdr_threshold", "edge_fwer_threshold", "edge_pvalues", "estimate_mfdr",
    "estimator", "fit_path", "fit_with_orthonormalization", "from_triples", "joint_ebic_path", "mb_stability_threshold", "moments", "names", "orthonormalize_groups", "polychoric_correlation",
    "polychoric_covariance_matrix", "polyserial_correlation", "predict", "predict_all", "read_matrix", "read_table", "select_by_ic", "select_by_mfdr", "stratified_folds", "wide_path",
]


def __getattr__(name: str):
    return getattr(_estimators, name)
