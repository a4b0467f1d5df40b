"""Fitted paths with DuckDB equivalents: small problems that a recursive query solves by the same iteration or to the same optimum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import penalties as P
from ridgeline.operators import selection
from ridgeline.operators.moments import moments
from ridgeline.operators.paths import Spec, adaptive_path, fit_path, path_from_moments
from ridgeline.operators.wide import wide_path
from ridgeline.queries import _LI, PRICE, X2, lineitem, query, rounded, table

_X = "x AS (SELECT l_quantity AS a, l_tax * 100 AS b, l_extendedprice / 10000 + 0.4 * l_quantity - 1.5 * l_tax * 100 AS y, l_discount * 100 + 0.2 * l_quantity AS v FROM lineitem)"
_M = "m AS (SELECT var_pop(a) AS g11, var_pop(b) AS g22, covar_pop(a, b) AS g12, covar_pop(a, y) AS c1, covar_pop(b, y) AS c2, covar_pop(a, v) AS d1, covar_pop(b, v) AS d2, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x)"
_OUT = "SELECT i::INT AS lambda_idx, term, round(coef, 4) + 0.0 AS coef FROM (SELECT i, 'l_quantity' AS term, b1 AS coef FROM d WHERE k = {n} UNION ALL SELECT i, 'l_tax_pct', b2 FROM d WHERE k = {n})"


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features, and two responses that depend on them."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_tax") * 100).alias("l_tax_pct"), "l_quantity", PRICE, "l_discount")
    planted = F.col(PRICE) / 10000 + 0.4 * F.col("l_quantity") - 1.5 * F.col("l_tax_pct")
    return df.select("l_tax_pct", "l_quantity", planted.alias("y"), (F.col("l_discount") * 100 + 0.2 * F.col("l_quantity")).alias("v"))


def _values(lams: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(lams)) + ") l(i, lam)"


# --- one group of two features: the block's proximal steps --------------------------------------------------------------


def _block_sql(lams: list[float], inner: str, scale: str, n: int = 4000) -> str:
    """`inner` maps a coordinate {z} before `scale` of the block by its norm r; t is the step."""
    return f"""
WITH RECURSIVE {_X}, {_M}, p AS (SELECT *, 1 / ((g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ** 2 + g12 ** 2)) AS t FROM m),
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM {_values(lams)}
  UNION ALL
  SELECT i, lam, k + 1, y1 * s, y2 * s FROM (SELECT *, coalesce({scale}, 0) AS s FROM (SELECT *, nullif(sqrt(y1 * y1 + y2 * y2), 0) AS r FROM (
    SELECT i, lam, k, t, {inner.format(z="z1")} AS y1, {inner.format(z="z2")} AS y2 FROM (
      SELECT d.i, d.lam, d.k, p.t, b1 + (c1 - g11 * b1 - g12 * b2) * t AS z1, b2 + (c2 - g12 * b1 - g22 * b2) * t AS z2 FROM d, p WHERE k < {n}))))
)
{_OUT.format(n=n)}"""


def _block_query(name: str, penalty, scale: str, inner: str = "{z}", lams: tuple[float, ...] = (100.0, 10.0, 1.0)) -> None:
    @query(name, _block_sql(list(lams), inner, scale))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fit_path(_pair(spark, sf_dir), X2, "y", penalty, groups=[0, 0], lambdas=list(lams), tol=1e-12)
        return rounded(path.coefficients(spark).filter("term != '(intercept)'").drop("lambda"), 4)


def _mcp_scale(share: str) -> str:
    return f"CASE WHEN r >= 3 * {share} * lam THEN 1 WHEN r > t * {share} * lam THEN (1 - t * {share} * lam / r) / (1 - t / 3) ELSE 0 END"


def _scad_scale(share: str) -> str:
    return f"CASE WHEN r > 3.7 * {share} * lam THEN 1 WHEN r <= (1 + t) * {share} * lam THEN greatest(0, 1 - t * {share} * lam / r) ELSE (2.7 * r - t * 3.7 * {share} * lam) / ((2.7 - t) * r) END"


_SOFT = "sign({z}) * greatest(abs({z}) - 0.5 * t * lam, 0)"
_FIRM = "CASE WHEN abs({z}) / t <= 0.5 * lam THEN 0 WHEN abs({z}) / t <= 1.5 * lam THEN sign({z}) * (abs({z}) / t - 0.5 * lam) * t / (1 - 1 / 3.0) ELSE {z} END"
_SCAD = "CASE WHEN abs({z}) / t <= 0.5 * lam THEN 0 WHEN abs({z}) / t <= lam THEN sign({z}) * (abs({z}) / t - 0.5 * lam) * t WHEN abs({z}) / t <= 1.85 * lam THEN sign({z}) * (abs({z}) / t - 1.85 * lam / 2.7) * t / (1 - 1 / 2.7) ELSE {z} END"
_block_query("group_enet_path_pg", P.GroupElasticNet(0.5), "greatest(0, 1 - 0.5 * t * lam / r) / (1 + 0.5 * t * lam)")
_block_query("group_mcp_path_pg", P.GroupMCP(3.0), _mcp_scale("1"))
_block_query("group_scad_path_pg", P.GroupSCAD(3.7), _scad_scale("1"))
_block_query("sparse_group_lasso_path_pg", P.SparseGroupLasso(0.5), "greatest(0, 1 - 0.5 * t * lam / r)", _SOFT)
_block_query("sparse_group_mcp_path_pg", P.SparseGroupMCP(0.5, 3.0), _mcp_scale("0.5"), _FIRM)
_block_query("sparse_group_scad_path_pg", P.SparseGroupSCAD(0.5, 3.7), _scad_scale("0.5"), _SCAD)


# --- reweighted lassos ---------------------------------------------------------------------------------------------------


def _lla_sql(lams: list[float], weight: str, sweeps: int = 60, rounds: int = 10) -> str:
    """`weight` gives a coordinate's weight from its own coefficient {b} and the other {o}; coordinate descent in between."""
    n = sweeps * rounds
    w = lambda b, o, old: f"CASE WHEN k % {sweeps} = 0 THEN {weight.format(b=b, o=o)} ELSE {old} END"
    soft = lambda u, level, g: f"sign({u}) * greatest(abs({u}) - {level}, 0) / {g}"
    return f"""
WITH RECURSIVE {_X}, {_M},
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS b1, 0::DOUBLE AS b2, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM {_values(lams)}
  UNION ALL
  SELECT i, lam, k + 1, n1, {soft("(c2 - g12 * n1)", "lam * v2", "g22")}, v1, v2 FROM (SELECT *, {soft("(c1 - g12 * b2)", "lam * v1", "g11")} AS n1 FROM (
    SELECT d.*, m.*, {w("b1", "b2", "w1")} AS v1, {w("b2", "b1", "w2")} AS v2 FROM d, m WHERE k < {n}))
)
{_OUT.format(n=n)}"""


def _lla_query(name: str, penalty, lams: list[float], weight: str) -> None:
    @query(name, _lla_sql(lams, weight))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        groups = {} if isinstance(penalty, P.Bridge) else {"groups": [0, 0]}
        made = [fit_path(_pair(spark, sf_dir), X2, "y", penalty, lambdas=[lam], tol=1e-12, **groups) for lam in lams]  # each from zero
        rows = [(i, t, float(c)) for i, path in enumerate(made) for t, c in zip(path.terms, path.coefs[0], strict=True)]
        return rounded(spark.createDataFrame(rows, "lambda_idx int, term string, coef double"), 4)


_SLOPE = "greatest(1 - abs({b}) / (3 * lam), 0)"
_MCP_VALUE = "CASE WHEN abs({b}) < 3 * lam THEN lam * abs({b}) - {b} * {b} / 6 ELSE 1.5 * lam * lam END"
_INNER = f"({_MCP_VALUE.replace('{b}', '{b}')} + {_MCP_VALUE.replace('{b}', '{o}')})"
_lla_query("bridge_path_lla", P.Bridge(), [0.5, 0.05], "0.5 * pow(abs({b}) + 1e-6, -0.5)")
_lla_query("composite_mcp_path_lla", P.CompositeMCP(), [3.0, 1.0, 0.2], f"greatest(1 - {_INNER} / (3 * lam), 0) * lam * {_SLOPE}")
_lla_query("group_exponential_path_lla", P.GroupExponential(), [50.0, 5.0, 0.5], "exp(-(abs({b}) + abs({o})) / lam)")


# --- several responses, adaptive weights, working sets -------------------------------------------------------------------


@query("multitask_path_cd", f"""
WITH RECURSIVE {_X}, {_M},
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS p1, 0::DOUBLE AS q1, 0::DOUBLE AS p2, 0::DOUBLE AS q2 FROM {_values([40.0, 5.0, 0.5])}
  UNION ALL
  SELECT i, lam, k + 1, r1, s1, z2 * f2, w2 * f2 FROM (SELECT *, greatest(0, 1 - 2 * lam / g22 / nullif(sqrt(z2 * z2 + w2 * w2), 0)) AS f2 FROM (
    SELECT *, (c2 - g12 * r1) / g22 AS z2, (d2 - g12 * s1) / g22 AS w2 FROM (SELECT *, z1 * f1 AS r1, w1 * f1 AS s1 FROM (
      SELECT *, greatest(0, 1 - 2 * lam / g11 / nullif(sqrt(z1 * z1 + w1 * w1), 0)) AS f1 FROM (
        SELECT d.*, m.*, (c1 - g12 * p2) / g11 AS z1, (d1 - g12 * q2) / g11 AS w1 FROM d, m WHERE k < 200)))))
)
SELECT i::INT AS lambda_idx, label, term, round(coef, 4) + 0.0 AS coef FROM (
  SELECT i, 'y' AS label, 'l_quantity' AS term, p1 AS coef FROM d WHERE k = 200 UNION ALL SELECT i, 'y', 'l_tax_pct', p2 FROM d WHERE k = 200
  UNION ALL SELECT i, 'v', 'l_quantity', q1 FROM d WHERE k = 200 UNION ALL SELECT i, 'v', 'l_tax_pct', q2 FROM d WHERE k = 200)""")
def multitask_path_cd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fit_path(_pair(spark, sf_dir), X2, ["y", "v"], P.GroupLasso(), lambdas=[40.0, 5.0, 0.5], tol=1e-12)
    return rounded(path.coefficients(spark).filter("term != '(intercept)'").drop("lambda"), 4)


def _cd(lam1: str, lam2: str) -> tuple[str, str]:
    return f"sign(c1 - g12 * b2) * greatest(abs(c1 - g12 * b2) - {lam1}, 0) / g11", f"sign(c2 - g12 * n1) * greatest(abs(c2 - g12 * n1) - {lam2}, 0) / g22"


@query("adaptive_lasso_path_cd", f"""
WITH RECURSIVE {_X}, {_M},
f AS (
  SELECT 0 AS k, 0::DOUBLE AS b1, 0::DOUBLE AS b2 UNION ALL
  SELECT k + 1, n1, {_cd("lam", "lam")[1]} FROM (SELECT *, {_cd("lam", "lam")[0]} AS n1 FROM (SELECT f.*, m.*, greatest(abs(c1), abs(c2)) * pow(0.01, 0.5) AS lam FROM f, m WHERE k < 200))
), w AS (SELECT 1 / greatest(abs(b1), 1e-2) AS w1, 1 / greatest(abs(b2), 1e-2) AS w2 FROM f WHERE k = 200),
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM {_values([20.0, 1.0, 0.01])}
  UNION ALL
  SELECT i, lam, k + 1, n1, {_cd("lam * w1", "lam * w2")[1]} FROM (SELECT *, {_cd("lam * w1", "lam * w2")[0]} AS n1 FROM (SELECT d.*, m.*, w.* FROM d, m, w WHERE k < 200))
)
{_OUT.format(n=200)}""")
def adaptive_lasso_path_cd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = adaptive_path(_pair(spark, sf_dir), X2, "y", P.Lasso(), n_lambdas=3, lambda_min_ratio=0.01, eps=1e-2, lambdas=[20.0, 1.0, 0.01], tol=1e-12)
    return rounded(path.coefficients(spark).filter("term != '(intercept)'").drop("lambda"), 4)


@query("wide_lasso_path_cd", f"""
WITH RECURSIVE x AS (SELECT embedding[1]::DOUBLE * 8 AS a, embedding[2]::DOUBLE * 8 AS b, embedding[3]::DOUBLE * 8 + embedding[1]::DOUBLE * 4 AS y, 0 AS v FROM embeddings), {_M},
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM {_values([0.2, 0.05, 0.001])}
  UNION ALL
  SELECT i, lam, k + 1, n1, {_cd("lam", "lam")[1]} FROM (SELECT *, {_cd("lam", "lam")[0]} AS n1 FROM (SELECT d.*, m.* FROM d, m WHERE k < 200))
)
SELECT i::INT AS lambda_idx, term, round(coef, 5) + 0.0 AS coef FROM (SELECT i, 'x[0]' AS term, b1 AS coef FROM d WHERE k = 200 UNION ALL SELECT i, 'x[1]', b2 FROM d WHERE k = 200)""")
def wide_lasso_path_cd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    df = table(spark, sf_dir, "embeddings").select(F.array(e(0) * 8, e(1) * 8).alias("x"), (e(2) * 8 + e(0) * 4).alias("y"))
    path = wide_path(df, "x", "y", P.Lasso(), lambdas=[0.2, 0.05, 0.001])
    return rounded(path.coefficients(spark).filter("term != '(intercept)'").drop("lambda"), 5)


# --- reweighted families: one feature and an intercept, rounds of sums over all rows --------------------------------------


def _irls_sql(lams: list[float], y: str, weight: str, response: str, start: str = "0", n: int = 40) -> str:
    return f"""
WITH RECURSIVE x AS (SELECT l_quantity / 10 AS a, {y} AS y FROM (SELECT *, (l_linestatus = 'F')::INT::DOUBLE AS y01 FROM lineitem)),
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS b, {start}::DOUBLE AS b0 FROM {_values(lams)}
  UNION ALL
  SELECT i, lam, k + 1, b, (wz - wx * b) / w FROM (SELECT *, sign(c) * greatest(abs(c) - lam, 0) / g AS b FROM (
    SELECT *, (wxx - wx * wx / w) / n AS g, (wxz - wx * wz / w) / n AS c FROM (
      SELECT i, lam, k, count(*) AS n, sum(w) AS w, sum(w * a) AS wx, sum(w * a * a) AS wxx, sum(w * z) AS wz, sum(w * a * z) AS wxz FROM (
        SELECT *, {response} AS z FROM (SELECT *, {weight} AS w FROM (SELECT d.i, d.lam, d.k, a, y, b0 + b * a AS eta FROM d, x WHERE k < {n}))) GROUP BY i, lam, k)))
)
SELECT i::INT AS lambda_idx, term, round(coef, 5) + 0.0 AS coef FROM (SELECT i, 'q10' AS term, b AS coef FROM d WHERE k = {n} UNION ALL SELECT i, '(intercept)', b0 FROM d WHERE k = {n})"""


def _irls_query(name: str, family: str, lams: list[float], column, y: str, weight: str, response: str, **options) -> None:
    @query(name, _irls_sql(lams, y, weight, response))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lineitem(spark, sf_dir).select((F.col("l_quantity") / 10).alias("q10"), column().alias("y"))
        path = fit_path(df, ["q10"], "y", P.Lasso(), family=family, lambdas=lams, outer_tol=1e-10, max_outer=200, **options)
        return rounded(path.coefficients(spark).drop("lambda"), 5)


_S = "(1 / (1 + exp(-eta)))"
_irls_query("logistic_lasso_path_irls", "binomial", [0.05, 0.001], lambda: ((F.col("l_quantity") + F.col("l_linenumber") * 7) > 40).cast("double"), "((l_quantity + l_linenumber * 7) > 40)::INT::DOUBLE", f"greatest({_S} * (1 - {_S}), 1e-4)", f"eta + (y - {_S}) / w")
_irls_query("poisson_lasso_path_irls", "poisson", [0.05, 0.001], lambda: F.floor(F.col("l_quantity") / 8 + F.col("l_linenumber") / 3).cast("double"), "floor(l_quantity / 8 + l_linenumber / 3.0)", "greatest(exp(eta), 1e-4)", "eta + (y - exp(eta)) / w")
_irls_query("huber_lasso_path_irls", "huber", [0.2, 0.01], lambda: F.col("l_quantity") / 20 + F.col("l_linenumber"), "l_quantity / 20 + l_linenumber", "CASE WHEN abs(y - eta) <= 1.35 THEN 1.0 ELSE 1.35 / abs(y - eta) END", "y")


# --- selection by closed forms ---------------------------------------------------------------------------------------------

_CV_LAMS = [150.0, 80.0, 20.0, 0.5]


@query("cv_table_lasso", f"""
WITH {_LI}, q AS (SELECT *, price_k / 10 + l_quantity AS py FROM l), t AS (SELECT f.i AS fold, avg(l_quantity) AS mx, avg(py) AS my, var_pop(l_quantity) AS g, covar_pop(l_quantity, py) AS c FROM q, range(5) f(i) WHERE q.fold != f.i GROUP BY f.i),
b AS (SELECT fold, i, mx, my, sign(c) * greatest(abs(c) - lam, 0) / g AS b FROM t, {_values(_CV_LAMS)}),
e AS (SELECT b.fold, i, avg((py - my - b * (l_quantity - mx)) ** 2) AS mse FROM q JOIN b ON q.fold = b.fold GROUP BY b.fold, i),
s AS (SELECT i, avg(mse) AS mean_score, stddev_pop(mse) AS std_score FROM e GROUP BY i)
SELECT i::INT AS lambda_idx, round(mean_score, 5) AS mean_score, round(std_score, 5) AS std_score, mean_score = min(mean_score) OVER () AS best FROM s""")
def cv_table_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = selection.cross_validate(lineitem(spark, sf_dir).withColumn("py", F.col("price_k") / 10 + F.col("l_quantity")), ["l_quantity"], "py", P.Lasso(), "fold", lambdas=_CV_LAMS)
    return rounded(cv.table(spark).drop("lambda"), 5)


@query("mfdr_closed_form", f"""
WITH {_LI}, x AS (SELECT l_discount * 100 AS a, price_k AS y FROM l), m AS (SELECT count(*)::DOUBLE AS n, var_pop(a) AS g, covar_pop(a, y) AS c, var_pop(y) AS v FROM x),
b AS (SELECT i, lam, n, v, g, c, sign(c) * greatest(abs(c) - lam, 0) / g AS b FROM m, {_values([0.5, 0.1, 0.05, 0.02])}),
s AS (SELECT i, lam * sqrt(n) / sqrt(v - 2 * b * c + b * b * g) AS q, (b != 0)::INT AS chosen FROM b),
p AS (SELECT i, chosen, sum((CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(q * j / 2000, 2) / 2)) * q / 2000 / 3 / sqrt(2 * pi()) AS half FROM s, range(2001) r(j) GROUP BY i, chosen, q)
SELECT i::INT AS lambda_idx, round(least(1, 2 * (0.5 - half) / greatest(chosen, 1)), 5) + 0.0 AS mfdr FROM p""")
def mfdr_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir).withColumn("d100", F.col("l_discount") * 100)
    m = moments(df, ["d100"], ["price_k"])
    path = path_from_moments(m, Spec(P.Lasso(), m.names), lambdas=[0.5, 0.1, 0.05, 0.02])
    found = np.round(selection.mfdr(path, m.n, m), 5) + 0.0
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "lambda_idx int, mfdr double")
