"""Scores of a fitted path, and errors of its predictions, as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import links
from ridgeline.operators.paths import PathResult


def linear_predictor(result: PathResult, index: int = -1, features: str | None = None, offset: str | None = None) -> Column | list[Column]:
    """eta at one lambda; a list over tasks or classes. features: the name of an array column, if the model was fitted to one."""

    def one(coefs, intercept) -> Column:
        if features is None:
            eta = links.linear(dict(zip(result.terms, map(float, coefs), strict=True)), float(intercept))
        else:
            terms = F.zip_with(F.col(features).cast("array<double>"), F.array(*[F.lit(float(c)) for c in coefs]), lambda a, b: a * b)
            eta = F.aggregate(terms, F.lit(float(intercept)), lambda s, v: s + v)
        return eta if offset is None else eta + F.col(offset)

    c, b = result.coefs[index], result.intercepts[index]
    return [one(c[:, k], b[k]) for k in range(c.shape[1])] if c.ndim == 2 else one(c, b)


def predict(df: DataFrame, result: PathResult, index: int = -1, *, features: str | None = None, offset: str | None = None) -> DataFrame:
    """df with eta and, by family, prediction: the value, P(y = 1) and the label, the mean count, the relative risk score, the class."""
    eta = linear_predictor(result, index, features, offset)
    if result.datafit == "multinomial":
        probs = links.softmax(eta)
        best = F.array_position(F.array(*probs), F.array_max(F.array(*probs)))
        return df.withColumn("probabilities", F.array(*probs)).withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in result.labels]), best.cast("int")))
    if result.datafit == "multitask":
        return df.withColumn("prediction", F.array(*eta))
    out = df.withColumn("eta", eta)
    if result.datafit == "binomial":
        return out.withColumn("probability", links.sigmoid(F.col("eta"))).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    if result.datafit == "poisson":
        return out.withColumn("prediction", F.exp("eta"))
    return out.withColumn("prediction", F.col("eta"))


def predict_all(df: DataFrame, result: PathResult, keys: list[str], *, features: str | None = None) -> DataFrame:
    """(keys, lambda_idx, eta): one row per row and lambda, from one scan of the features."""
    etas = F.array(*[F.struct(F.lit(i).alias("lambda_idx"), linear_predictor(result, i, features).alias("eta")) for i in range(len(result.lambdas))])
    return df.select(*keys, F.explode(etas).alias("_e")).select(*keys, "_e.*")


def mse(y: Column, eta: Column) -> Column:
    return F.avg((y - eta) * (y - eta))


def logistic_deviance(y: Column, eta: Column) -> Column:
    p = F.greatest(F.least(links.sigmoid(eta), F.lit(1 - 1e-15)), F.lit(1e-15))
    return -2 * F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))


def poisson_deviance(y: Column, eta: Column) -> Column:
    mu = F.greatest(F.exp(eta), F.lit(1e-12))
    return 2 * F.avg(F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))


def multinomial_loss(code: Column, etas: list[Column]) -> Column:
    """Mean negative log likelihood; code is the class number from 0."""
    own = F.element_at(F.array(*etas), code.cast("int") + 1)
    return F.avg(links.log_sum_exp(etas) - own)


METRICS = {"gaussian": mse, "huber": mse, "binomial": logistic_deviance, "poisson": poisson_deviance}
