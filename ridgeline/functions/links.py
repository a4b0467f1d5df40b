"""Links, losses and working quantities of generalized linear models as Spark columns of eta and y."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least working weight, and largest size of eta inside an exponential. Fixed values.
WEIGHT_FLOOR = 1e-4
ETA_CLAMP = 30.0


def clamp(eta: Column) -> Column:
    return F.greatest(F.least(eta, F.lit(ETA_CLAMP)), F.lit(-ETA_CLAMP))


def sigmoid(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def softplus(eta: Column) -> Column:
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))


def log_sum_exp(etas: list[Column]) -> Column:
    top = F.greatest(*etas) if len(etas) > 1 else etas[0]
    total = F.lit(0.0)
    for e in etas:
        total = total + F.exp(e - top)
    return top + F.log(total)


def softmax(etas: list[Column]) -> list[Column]:
    norm = log_sum_exp(etas)
    return [F.exp(e - norm) for e in etas]


@dataclass(frozen=True)
class Surrogate:
    """loss of one row, working weight and working response at eta."""

    loss: Column
    weight: Column
    response: Column


def gaussian(eta: Column, y: Column) -> Surrogate:
    return Surrogate((y - eta) * (y - eta) / 2, F.lit(1.0), y)


def binomial(eta: Column, y: Column) -> Surrogate:
    p = sigmoid(eta)
    w = F.greatest(p * (1 - p), F.lit(WEIGHT_FLOOR))
    return Surrogate(softplus(eta) - y * eta, w, eta + (y - p) / w)


def poisson(eta: Column, y: Column, offset: Column | None = None) -> Surrogate:
    """eta includes the offset; the working response doesn't."""
    off = F.lit(0.0) if offset is None else offset
    mu = F.exp(clamp(eta))
    w = F.greatest(mu, F.lit(WEIGHT_FLOOR))
    return Surrogate(mu - y * eta, w, eta - off + (y - mu) / w)


def huber(eta: Column, y: Column, delta: float = 1.35) -> Surrogate:
    r = F.abs(y - eta)
    loss = F.when(r <= delta, r * r / 2).otherwise(delta * r - delta * delta / 2)
    return Surrogate(loss, F.when(r <= delta, F.lit(1.0)).otherwise(delta / r), y)


def linear(terms: dict[str, float], intercept: float = 0.0) -> Column:
    """x'beta + intercept over named columns; terms at zero are left out, so the scan doesn't read them."""
    out = F.lit(float(intercept))
    for name, b in terms.items():
        if b != 0.0:
            out = out + F.col(name).cast("double") * F.lit(float(b))
    return out
