"""Registered queries of the regression engine and their DuckDB equivalents.

Results are rounded alike on both sides, as sums of floating-point numbers depend on their order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import links, prox
from ridgeline.functions.testing import bh_adjust, holm_adjust
from ridgeline.operators import cox, graphs, ordinal, scoring, selection
from ridgeline.operators import penalties as P
from ridgeline.operators.estimators import estimator
from ridgeline.operators.inference import debiased_glm, debiased_lasso
from ridgeline.operators.moments import gram_rows, moments
from ridgeline.operators.paths import Spec, adaptive_path, fit_path, path_from_moments
from ridgeline.operators.solver import Problem, lambda_grid
from ridgeline.operators.wide import wide_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

X3 = ["l_quantity", "l_discount", "l_tax"]
PRICE = "l_extendedprice"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the features and responses used below."""
    df = table(spark, sf_dir, "lineitem")
    return df.withColumn("y01", (F.col("l_linestatus") == "F").cast("double")).withColumn("price_k", F.col(PRICE) / 1000.0).withColumn("fold", F.pmod("l_orderkey", F.lit(5)).cast("int"))


_LI = "l AS (SELECT *, (l_linestatus = 'F')::INT::DOUBLE AS y01, l_extendedprice / 1000.0 AS price_k, (l_orderkey % 5)::INT AS fold FROM lineitem)"

# --- moments and preprocessing -----------------------------------------------------------------------------------------


@query(
    "standardize_stats",
    "SELECT term, round(mean, 6) AS mean, round(std, 6) AS std FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS term, avg({c}) AS mean, stddev_pop({c}) AS std FROM lineitem" for c in [*X3, PRICE])
    + ")",
)
def standardize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments(table(spark, sf_dir, "lineitem"), [*X3, PRICE])
    std = np.sqrt(np.diag(m.centered()))
    return rounded(spark.createDataFrame([(t, float(a), float(s)) for t, a, s in zip(m.names, m.mean, std, strict=True)], "term string, mean double, std double"))


@query(
    "gram_moments",
    "SELECT i::INT AS i, j::INT AS j, round(value, 3) AS value FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum({a} * {b}) AS value FROM lineitem" for i, a in enumerate(X3) for j, b in enumerate(X3) if i <= j) + ")",
)
def gram_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gram_rows(table(spark, sf_dir, "lineitem"), X3), 3)


@query(
    "wide_gram_embeddings",
    "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) "
    "SELECT a.k::INT AS i, b.k::INT AS j, round(sum(a.v * b.v), 4) AS value FROM e a JOIN e b USING (vec_id) WHERE a.k <= b.k GROUP BY a.k, b.k",
)
def wide_gram_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gram_rows(table(spark, sf_dir, "embeddings"), "embedding"), 4)


@query("covariance_matrix", "SELECT i::INT AS i, j::INT AS j, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_pop({a}, {b}) AS value FROM lineitem" for i, a in enumerate(X3) for j, b in enumerate(X3) if i <= j) + ")")
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graphs.covariance(moments(table(spark, sf_dir, "lineitem"), X3))
    return rounded(spark.createDataFrame([(i, j, float(s[i, j])) for i in range(3) for j in range(i, 3)], "i int, j int, value double"))


@query("weighted_moments", f"WITH {_LI} SELECT round(sum(l_quantity), 4) AS mass, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean_x, round(sum(l_quantity * price_k) / sum(l_quantity), 6) AS mean_y, count(*)::DOUBLE AS n FROM l")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments(lineitem(spark, sf_dir), ["l_discount"], ["price_k"], weight="l_quantity")
    return spark.createDataFrame([(round(float(m.mass), 4), round(float(m.mean[0]), 6), round(float(m.mean[1]), 6), float(m.n))], "mass double, mean_x double, mean_y double, n double")


_TOP = f"WITH {_LI} SELECT greatest(" + ", ".join(f"abs(covar_pop({c}, price_k))" for c in X3) + ")"


@query("lambda_max_ls", f"SELECT round(({_TOP} FROM l), 6) AS lambda_max")
def lambda_max_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = moments(lineitem(spark, sf_dir), X3, ["price_k"]).centered()
    top = Problem(a[:3, :3], a[:3, 3], P.Lasso(), np.ones(3)).lambda_max()
    return spark.createDataFrame([(round(top, 6),)], "lambda_max double")


@query("lambda_grid_ls", f"SELECT i::INT AS lambda_idx, round(top * 0.001 ** (i / 99.0), 6) AS lambda FROM (SELECT ({_TOP} FROM l) AS top), range(100) r(i)")
def lambda_grid_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = moments(lineitem(spark, sf_dir), X3, ["price_k"]).centered()
    grid = lambda_grid(Problem(a[:3, :3], a[:3, 3], P.Lasso(), np.ones(3)).lambda_max(), 100, 1e-3)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(grid)], "lambda_idx int, lambda double"))


# --- proximal maps -----------------------------------------------------------------------------------------------------

_Z = "SELECT event_id, value / 50.0 - 1.0 AS z FROM events"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") / 50.0 - 1.0).alias("z"))


def _prox_query(name: str, expression: str, column) -> None:
    @query(name, f"SELECT event_id, round({expression}, 6) + 0.0 AS p FROM ({_Z})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_points(spark, sf_dir).select("event_id", column(F.col("z")).alias("p")))


_prox_query("prox_soft", "sign(z) * greatest(abs(z) - 0.5 * 0.4, 0)", lambda z: prox.soft_threshold(z, 0.5, 0.4))
_prox_query("prox_elastic_net", "sign(z) * greatest(abs(z) - 0.5 * 0.5 * 0.4, 0) / (1 + 0.5 * 0.5 * 0.4)", lambda z: prox.elastic_net_prox(z, 0.5, 0.4, 0.5))
_prox_query("prox_mcp", "CASE WHEN 2 * abs(z) <= 0.4 THEN 0 WHEN 2 * abs(z) <= 1.2 THEN sign(z) * (2 * abs(z) - 0.4) / (2 * (1 - 1 / 3.0)) ELSE z END", lambda z: prox.mcp_prox(z, 0.5, 0.4, 3.0))
_prox_query(
    "prox_scad",
    "CASE WHEN 2 * abs(z) <= 0.4 THEN 0 WHEN 2 * abs(z) <= 0.8 THEN sign(z) * (2 * abs(z) - 0.4) / 2 WHEN 2 * abs(z) <= 1.48 THEN sign(z) * (2 * abs(z) - 1.48 / 2.7) / (2 * (1 - 1 / 2.7)) ELSE z END",
    lambda z: prox.scad_prox(z, 0.5, 0.4, 3.7),
)


@query(
    "prox_group",
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS b FROM embeddings), n AS (SELECT vec_id, b, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS norm FROM e) "
    "SELECT vec_id, round(b[1] * greatest(0, 1 - 0.2 / norm), 6) + 0.0 AS first, round(sqrt(list_sum(list_transform(b, lambda x: x * x))) * greatest(0, 1 - 0.2 / norm), 6) AS norm FROM n",
)
def prox_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    made = table(spark, sf_dir, "embeddings").select("vec_id", prox.group_soft_threshold(block, 0.5, 0.4).alias("b"))
    return rounded(made.select("vec_id", F.get("b", F.lit(0)).alias("first"), prox.block_norm(F.col("b")).alias("norm")))


# --- fitted least-squares paths ----------------------------------------------------------------------------------------

X2 = ["l_quantity", "l_tax_pct"]
LAMS = [20.0, 5.0, 1.0, 0.2]


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_tax") * 100).alias("l_tax_pct"), "l_quantity", (F.col(PRICE) / 1000).alias("price_k"))


def _descent_sql(update: str) -> str:
    """Coordinate descent on two features, as a recursive query; `update` maps u (the partial cross product), v (curvature) and lam to a coefficient."""
    one = lambda u, v: update.format(u=f"({u})", v=v)
    first = one("c1 - g12 * b2", "g11")
    return f"""
WITH RECURSIVE x AS (SELECT l_quantity AS a, l_tax * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT var_pop(a) AS g11, var_pop(b) AS g22, covar_pop(a, b) AS g12, covar_pop(a, y) AS c1, covar_pop(b, y) AS c2, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
l AS (SELECT i, lam FROM (VALUES {", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(LAMS))}) t(i, lam)),
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM l
  UNION ALL
  SELECT i, lam, k + 1, n1, {one("c2 - g12 * n1", "g22")} FROM (SELECT d.*, m.*, {first} AS n1 FROM d, m WHERE k < 80)
), f AS (SELECT d.*, m.* FROM d, m WHERE k = 80)
SELECT i::INT AS lambda_idx, term, round(coef, 5) + 0.0 AS coef FROM (
  SELECT i, 'l_quantity' AS term, b1 AS coef FROM f UNION ALL SELECT i, 'l_tax_pct', b2 FROM f UNION ALL SELECT i, '(intercept)', my - b1 * ma - b2 * mb FROM f)
"""


def _path_query(name: str, penalty, update: str) -> None:
    @query(name, _descent_sql(update))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fit_path(_two(spark, sf_dir), X2, "price_k", penalty, lambdas=LAMS)
        return rounded(path.coefficients(spark).drop("lambda"), 5)


_path_query("lasso_path_cd", P.Lasso(), "sign({u}) * greatest(abs({u}) - lam, 0) / {v}")
_path_query("enet_path_cd", P.ElasticNet(0.5), "sign({u}) * greatest(abs({u}) - 0.5 * lam, 0) / ({v} + 0.5 * lam)")
_path_query("mcp_path_cd", P.MCP(3.0), "CASE WHEN abs({u}) <= lam THEN 0 WHEN abs({u}) <= 3 * lam THEN sign({u}) * (abs({u}) - lam) / ({v} * (1 - 1 / 3.0)) ELSE {u} / {v} END")
_path_query("scad_path_cd", P.SCAD(3.7), "CASE WHEN abs({u}) <= lam THEN 0 WHEN abs({u}) <= 2 * lam THEN sign({u}) * (abs({u}) - lam) / {v} WHEN abs({u}) <= 3.7 * lam THEN sign({u}) * (abs({u}) - 3.7 * lam / 2.7) / ({v} * (1 - 1 / 2.7)) ELSE {u} / {v} END")


@query("ridge_closed_form", """
WITH x AS (SELECT l_quantity AS a, l_tax * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT var_pop(a) + 0.5 AS g11, var_pop(b) + 0.5 AS g22, covar_pop(a, b) AS g12, covar_pop(a, y) AS c1, covar_pop(b, y) AS c2 FROM x)
SELECT term, round(coef, 6) AS coef FROM (SELECT 'l_quantity' AS term, (g22 * c1 - g12 * c2) / (g11 * g22 - g12 * g12) AS coef FROM m UNION ALL SELECT 'l_tax_pct', (g11 * c2 - g12 * c1) / (g11 * g22 - g12 * g12) FROM m)
""")
def ridge_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fit_path(_two(spark, sf_dir), X2, "price_k", P.ElasticNet(0.0), lambdas=[0.5])
    return rounded(path.coefficients(spark).filter("term != '(intercept)'").select("term", "coef"))


@query("group_lasso_path", """
WITH RECURSIVE x AS (SELECT l_quantity AS a, l_tax * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT var_pop(a) AS g11, var_pop(b) AS g22, covar_pop(a, b) AS g12, covar_pop(a, y) AS c1, covar_pop(b, y) AS c2 FROM x),
t AS (SELECT *, (g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ** 2 + g12 ** 2) AS lip FROM m),
d AS (
  SELECT i, lam, 0 AS k, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM (VALUES (0, 100.0::DOUBLE), (1, 10.0), (2, 1.0)) l(i, lam)
  UNION ALL
  SELECT i, lam, k + 1, z1 * s, z2 * s FROM (SELECT *, greatest(0, 1 - lam / lip / nullif(sqrt(z1 * z1 + z2 * z2), 0)) AS s FROM (
    SELECT d.i, d.lam, d.k, t.lip, b1 + (c1 - g11 * b1 - g12 * b2) / lip AS z1, b2 + (c2 - g12 * b1 - g22 * b2) / lip AS z2 FROM d, t WHERE k < 4000))
)
SELECT i::INT AS lambda_idx, term, round(coef, 4) + 0.0 AS coef FROM (SELECT i, 'l_quantity' AS term, b1 AS coef FROM d WHERE k = 4000 UNION ALL SELECT i, 'l_tax_pct', b2 FROM d WHERE k = 4000)
""")
def group_lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fit_path(_two(spark, sf_dir), X2, "price_k", P.GroupLasso(), groups=[0, 0], lambdas=[100.0, 10.0, 1.0], tol=1e-12)
    return rounded(path.coefficients(spark).filter("term != '(intercept)'").drop("lambda"), 4)


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Line items with ten features: numbers, one-hot flags and a planted response."""
    df = lineitem(spark, sf_dir)
    flags = {f"flag_{f.lower()}": (F.col("l_returnflag") == f).cast("double") for f in "ARN"}
    noise = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000)) / 1000.0 - 0.5
    parts = {f"mod{k}": F.pmod(F.col("l_partkey"), F.lit(k)) / float(k) for k in (7, 11, 13, 17)}
    out = df.select("*", *[c.alias(n) for n, c in (flags | parts).items()])
    planted = 2.0 * F.col("flag_a") - 1.5 * F.col("mod7") + 0.02 * F.col("l_quantity") + noise
    return out.withColumn("planted", planted).withColumn("noise", noise), [*X3, *flags, *parts]


GROUPS10 = [0, 1, 2, 3, 3, 3, 4, 4, 4, 4]


@query("mcp_path")
def mcp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: an MCP path of the price on ten features, standardized, 20 lambdas."""
    df, x = _features(spark, sf_dir)
    return fit_path(df, x, "price_k", P.MCP(), standardize=True, n_lambdas=20).coefficients(spark)


def _fit_query(name: str, penalty, **kwargs) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, x = _features(spark, sf_dir)
        return fit_path(df, x, "planted", penalty, n_lambdas=20, lambda_min_ratio=0.01, **kwargs).coefficients(spark)


_fit_query("bridge_path", P.Bridge())
_fit_query("group_enet_path", P.GroupElasticNet(0.5), groups=GROUPS10)
_fit_query("group_mcp_path", P.GroupMCP(), groups=GROUPS10)
_fit_query("group_scad_path", P.GroupSCAD(), groups=GROUPS10)
_fit_query("sparse_group_lasso_path", P.SparseGroupLasso(), groups=GROUPS10)
_fit_query("sparse_group_mcp_path", P.SparseGroupMCP(), groups=GROUPS10)
_fit_query("sparse_group_scad_path", P.SparseGroupSCAD(), groups=GROUPS10)
_fit_query("composite_mcp_path", P.CompositeMCP(), groups=GROUPS10)
_fit_query("group_exponential_path", P.GroupExponential(), groups=GROUPS10)


@query("path_info_ls")
def path_info_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    return fit_path(df, x, "planted", P.SCAD(), n_lambdas=20).path_info(spark)


@query("multitask_path")
def multitask_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    return fit_path(df, x, ["planted", "price_k"], P.GroupLasso(), n_lambdas=15, lambda_min_ratio=0.01).coefficients(spark)


@query("adaptive_lasso_path")
def adaptive_lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    return adaptive_path(df, x, "planted", P.Lasso(), n_lambdas=15).coefficients(spark)


@query("embedding_lasso_path")
def embedding_lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-feature array column against a label indicator."""
    df = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    return fit_path(df, "embedding", "y", P.Lasso(), n_lambdas=20, lambda_min_ratio=0.05).coefficients(spark)


@query("wide_lasso_path")
def wide_lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by gradients of all columns and moments of a working set."""
    df = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    return wide_path(df, "embedding", "y", P.Lasso(), n_lambdas=5, lambda_min_ratio=0.3).coefficients(spark)


# --- generalized linear models -----------------------------------------------------------------------------------------


def _family_query(name: str, family: str, penalty, y: str, **kwargs) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, x = _features(spark, sf_dir)
        bits = (F.col("planted") > 1.0).cast("double")
        df = df.withColumn("bit", bits).withColumn("count", F.floor(F.greatest(F.col("planted") + 2, F.lit(0.0))))
        return fit_path(df, x, y, penalty, family=family, n_lambdas=8, lambda_min_ratio=0.05, **kwargs).coefficients(spark)


_family_query("logistic_mcp_path", "binomial", P.MCP(), "bit")
_family_query("logistic_group_lasso_path", "binomial", P.GroupLasso(), "bit", groups=GROUPS10)
_family_query("poisson_lasso_path", "poisson", P.Lasso(), "count")
_family_query("huber_scad_path", "huber", P.SCAD(), "planted", delta=0.5)


@query("multinomial_lasso_path")
def multinomial_lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    return fit_path(df, ["l_quantity", "mod7", "flag_a"], "l_returnflag", P.GroupLasso(), family="multinomial", n_lambdas=5, lambda_min_ratio=0.1, max_outer=40).coefficients(spark)


@query("poisson_offset_path")
def poisson_offset_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases per user with the log number of events as offset."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "purchase").cast("double")).alias("bought"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    users = users.withColumn("log_n", F.log("n"))
    return fit_path(users, ["mean_value", "max_value"], "bought", P.MCP(), family="poisson", offset="log_n", n_lambdas=6, lambda_min_ratio=0.05).coefficients(spark)


_ETA = "(0.3 - 0.01 * l_quantity + 2.0 * l_discount)"


def _step_query(name: str, surrogate, weight: str, response: str, loss: str, eta: str = _ETA) -> None:
    @query(name, f"WITH {_LI}, s AS (SELECT *, {weight} AS w, {response} AS z, {loss} AS loss FROM (SELECT *, {eta} AS eta FROM l)) "
           "SELECT round(sum(w), 4) AS sum_w, round(sum(w * z), 3) AS sum_wz, round(sum(w * l_quantity * l_discount), 4) AS sum_wxx, round(sum(w * z * l_discount), 3) AS sum_wxz, round(avg(loss), 6) AS loss FROM s")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = links.linear({"l_quantity": -0.01, "l_discount": 2.0}, 0.3)
        df = lineitem(spark, sf_dir)
        s = surrogate(e)
        rows = df.select("l_quantity", "l_discount", s.weight.alias("w"), s.response.alias("z"), s.loss.alias("loss"))
        wz = F.col("w") * F.col("z")
        return rows.agg(F.round(F.sum("w"), 4).alias("sum_w"), F.round(F.sum(wz), 3).alias("sum_wz"), F.round(F.sum(F.col("w") * F.col("l_quantity") * F.col("l_discount")), 4).alias("sum_wxx"), F.round(F.sum(wz * F.col("l_discount")), 3).alias("sum_wxz"), F.round(F.avg("loss"), 6).alias("loss"))


_SIG = "(1 / (1 + exp(-eta)))"
_step_query("logistic_irls_step", lambda e: links.binomial(e, F.col("y01")), f"greatest({_SIG} * (1 - {_SIG}), 1e-4)", f"eta + (y01 - {_SIG}) / greatest({_SIG} * (1 - {_SIG}), 1e-4)", "greatest(eta, 0) + ln(1 + exp(-abs(eta))) - y01 * eta")
_step_query("poisson_irls_step", lambda e: links.poisson(e, F.col("l_linenumber").cast("double")), "greatest(exp(eta), 1e-4)", "eta + (l_linenumber - exp(eta)) / greatest(exp(eta), 1e-4)", "exp(eta) - l_linenumber * eta")
_step_query("huber_irls_weights", lambda e: links.huber(e, F.col("l_tax") * 10), "CASE WHEN abs(l_tax * 10 - eta) <= 1.35 THEN 1.0 ELSE 1.35 / abs(l_tax * 10 - eta) END", "l_tax * 10", "CASE WHEN abs(l_tax * 10 - eta) <= 1.35 THEN (l_tax * 10 - eta) ** 2 / 2 ELSE 1.35 * abs(l_tax * 10 - eta) - 1.35 ** 2 / 2 END")

# --- survival ----------------------------------------------------------------------------------------------------------


def _survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipping of a line; the event is status F."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lineitem(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.abs(F.datediff("l_shipdate", "o_orderdate")).cast("double")
    return joined.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", days.alias("time"), F.col("y01").cast("int").alias("event"), (F.col("l_quantity") * 0.01 - F.col("l_discount")).alias("eta"))


_SURV = """s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, abs(date_diff('day', o_orderdate, l_shipdate))::DOUBLE AS time, (l_linestatus = 'F')::INT AS event, l_quantity * 0.01 - l_discount AS eta
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT time, sum(exp(eta)) AS mass, sum(event)::DOUBLE AS events, sum(exp(eta) * event) AS event_risk FROM s GROUP BY time),
r AS (SELECT *, sum(mass) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS risk FROM t)"""
_BRESLOW = ", h AS (SELECT *, sum(events / risk) OVER w AS hazard, sum(events / (risk * risk)) OVER w AS hazard2, events * ln(risk) AS log_risk FROM r WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING))"
_EFRON = """, e AS (SELECT time, sum(1 / (risk - i / events * event_risk)) AS h, sum(1 / (risk - i / events * event_risk) ** 2) AS h2, sum(ln(risk - i / events * event_risk)) AS log_risk
  FROM (SELECT *, unnest(range(events::INT)) AS i FROM r WHERE events > 0) GROUP BY time),
h AS (SELECT r.*, sum(coalesce(h, 0)) OVER w AS hazard, sum(coalesce(h2, 0)) OVER w AS hazard2, coalesce(log_risk, 0) AS log_risk FROM r LEFT JOIN e USING (time) WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING))"""


@query("cox_risk_sets", f"WITH {_SURV}{_BRESLOW} SELECT time, events, round(risk, 4) AS risk, round(event_risk, 4) AS event_risk, round(hazard, 7) AS hazard FROM h")
def cox_risk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = cox.risk_sets(_survival(spark, sf_dir), "time", "event", F.col("eta"))
    return sets.select("time", "events", F.round("risk", 4).alias("risk"), F.round("event_risk", 4).alias("event_risk"), F.round("hazard", 7).alias("hazard"))


def _cox_surrogate(name: str, ties: str, hazards: str) -> None:
    @query(name, f"WITH {_SURV}{hazards}, g AS (SELECT s.*, greatest(exp(eta) * hazard - exp(eta) ** 2 * hazard2, 1e-4) AS w, exp(eta) * hazard - event AS g FROM s JOIN h USING (time)) SELECT l_orderkey, l_linenumber, round(w, 6) AS w, round(eta - g / w, 4) AS z FROM g")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cox.surrogate(_survival(spark, sf_dir), "time", "event", F.col("eta"), ties)
        return rows.select("l_orderkey", "l_linenumber", F.round("_w", 6).alias("w"), F.round("_z", 4).alias("z"))


_cox_surrogate("cox_surrogate_breslow", "breslow", _BRESLOW)
_cox_surrogate("cox_surrogate_efron", "efron", _EFRON)


@query("cox_loss", f"WITH {_SURV}{_BRESLOW} SELECT round(((SELECT sum(log_risk) FROM h) - (SELECT sum(event * eta) FROM s)) / (SELECT count(*) FROM s), 6) AS loss")
def cox_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(cox.loss(_survival(spark, sf_dir), "time", "event", F.col("eta")), 6),)], "loss double")


@query("c_index", f"""WITH {_SURV}, c AS (SELECT time, event, round(eta, 2) AS s, count(*)::DOUBLE AS n FROM s GROUP BY ALL)
SELECT sum(CASE WHEN a.s > b.s THEN a.n * b.n ELSE 0 END) AS concordant, sum(CASE WHEN a.s = b.s THEN a.n * b.n ELSE 0 END) AS ties, sum(a.n * b.n) AS pairs,
  round(sum(CASE WHEN a.s > b.s THEN a.n * b.n WHEN a.s = b.s THEN a.n * b.n / 2 ELSE 0 END) / sum(a.n * b.n), 9) AS c_index FROM c a JOIN c b ON a.event = 1 AND b.time > a.time""")
def c_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _survival(spark, sf_dir).withColumn("s", F.round("eta", 2))
    return cox.concordance(rows, "time", "event", "s").withColumn("c_index", F.round("c_index", 9))


@query("cox_mcp_path")
def cox_mcp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_path(_survival(spark, sf_dir), ["l_quantity", "l_discount"], "time", P.MCP(), family="cox", event="event", n_lambdas=6, lambda_min_ratio=0.05).coefficients(spark)


# --- scoring and errors ------------------------------------------------------------------------------------------------

_KEYS = ["l_orderkey", "l_linenumber"]


def _fixed(family: str):
    from ridgeline.operators.paths import PathResult

    return PathResult(family, ("l_quantity", "l_discount"), np.array([0.1]), np.array([[-0.01, 2.0]]), np.array([0.3]), [{"iters": 0, "converged": True, "loss": 0.0, "ns": 0}])


def _predict_query(name: str, family: str, column: str, sql: str) -> None:
    @query(name, f"WITH {_LI} SELECT l_orderkey, l_linenumber, round({sql}, 6) + 0.0 AS p FROM (SELECT *, {_ETA} AS eta FROM l)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = scoring.predict(lineitem(spark, sf_dir), _fixed(family))
        return made.select(*_KEYS, F.round(column, 6).alias("p"))


_predict_query("predict_ls", "gaussian", "prediction", "eta")
_predict_query("predict_logistic", "binomial", "probability", _SIG)
_predict_query("predict_poisson", "poisson", "prediction", "exp(eta)")
_predict_query("predict_cox", "cox", "prediction", "eta")


@query("predict_multinomial", f"WITH {_LI}, e AS (SELECT l_orderkey, l_linenumber, exp(0.01 * l_quantity) AS a, exp(0.2003 - l_discount) AS n, exp(2 * l_tax) AS r FROM l) SELECT l_orderkey, l_linenumber, round(a / (a + n + r), 6) AS p_a, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS prediction FROM e")
def predict_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.operators.paths import PathResult

    coefs = np.array([[[0.01, 0, 0], [0, -1.0, 0], [0, 0, 2.0]]])
    path = PathResult("multinomial", tuple(X3), np.array([0.1]), coefs, np.array([[0.0, 0.2003, 0.0]]), [{}], ("A", "N", "R"))
    made = scoring.predict(lineitem(spark, sf_dir), path)
    return made.select(*_KEYS, F.round(F.get("probabilities", F.lit(0)), 6).alias("p_a"), "prediction")


@query("predict_all_lambdas", f"WITH {_LI} SELECT l_orderkey, l_linenumber, i::INT AS lambda_idx, round(CASE i WHEN 0 THEN 1.0 ELSE 0.5 + 0.1 * l_quantity END, 6) AS eta FROM l, range(2) r(i)")
def predict_all_lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.operators.paths import PathResult

    path = PathResult("gaussian", ("l_quantity",), np.array([2.0, 1.0]), np.array([[0.0], [0.1]]), np.array([1.0, 0.5]), [{}, {}])
    return rounded(scoring.predict_all(lineitem(spark, sf_dir), path, _KEYS))


@query("deviance_by_fold", f"""WITH {_LI}, e AS (SELECT *, {_ETA} AS eta FROM l), p AS (SELECT *, greatest(least({_SIG}, 1 - 1e-15), 1e-15) AS p FROM e)
SELECT fold, round(-2 * avg(y01 * ln(p) + (1 - y01) * ln(1 - p)), 6) AS logistic, round(2 * avg(l_linenumber * ln(l_linenumber / exp(eta)) - (l_linenumber - exp(eta))), 6) AS poisson, round(avg((price_k - eta) ** 2), 4) AS mse FROM p GROUP BY fold""")
def deviance_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    eta, n = scoring.linear_predictor(_fixed("gaussian")), F.col("l_linenumber").cast("double")
    g = lineitem(spark, sf_dir).groupBy("fold")
    return g.agg(F.round(scoring.logistic_deviance(F.col("y01"), eta), 6).alias("logistic"), F.round(scoring.poisson_deviance(n, eta), 6).alias("poisson"), F.round(scoring.mse(F.col("price_k"), eta), 4).alias("mse"))


@query("multinomial_log_loss", f"WITH {_LI}, e AS (SELECT l_returnflag, 0.01 * l_quantity AS a, 0.2 - l_discount AS n, 2 * l_tax AS r FROM l) SELECT round(avg(ln(exp(a) + exp(n) + exp(r)) - CASE l_returnflag WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END), 6) AS loss FROM e")
def multinomial_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    etas = [0.01 * F.col("l_quantity"), 0.2 - F.col("l_discount"), 2 * F.col("l_tax")]
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return lineitem(spark, sf_dir).agg(F.round(scoring.multinomial_loss(code, etas), 6).alias("loss"))


@query("mse_cv_by_fold", f"""WITH {_LI}, b AS (SELECT f.i AS fold, regr_slope(price_k, l_quantity) AS slope, regr_intercept(price_k, l_quantity) AS start FROM l, range(5) f(i) WHERE l.fold != f.i GROUP BY f.i)
SELECT fold::INT AS fold, round(avg((price_k - start - slope * l_quantity) ** 2), 6) AS mse FROM l JOIN b USING (fold) GROUP BY fold""")
def mse_cv_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = selection.cross_validate(lineitem(spark, sf_dir), ["l_quantity"], "price_k", P.Lasso(), "fold", lambdas=[0.0])
    return rounded(spark.createDataFrame([(i, float(s[0])) for i, s in enumerate(cv.scores)], "fold int, mse double"))


@query("cv_table_mcp")
def cv_table_mcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    return selection.cross_validate(df, x, "planted", P.MCP(), "fold", n_lambdas=20, lambda_min_ratio=0.01).table(spark)


@query("cv_table_logistic")
def cv_table_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    df = df.withColumn("bit", (F.col("planted") > 1.0).cast("double"))
    return estimator("LogisticMCPPathCV", n_lambdas=5, lambda_min_ratio=0.1).fit(df, x, "bit", fold="fold").cv_table(df)


@query("ic_table", f"""WITH {_LI}, f AS (SELECT count(*)::DOUBLE AS n, regr_slope(price_k, l_quantity) AS b, var_pop(price_k) AS v, covar_pop(price_k, l_quantity) AS c, var_pop(l_quantity) AS g FROM l),
p AS (SELECT i, n, CASE i WHEN 0 THEN 0 ELSE 1 END AS k, n / 2 * ln(CASE i WHEN 0 THEN v ELSE v - 2 * b * c + b * b * g END) AS nll FROM f, range(2) r(i))
SELECT i::INT AS lambda_idx, k::INT AS df, round(nll, 3) AS nll, round(2 * k + 2 * nll, 3) AS aic, round(ln(n) * k + 2 * nll, 3) AS bic, round(ln(n) * k + 2 * nll, 3) AS ebic FROM p""")
def ic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments(lineitem(spark, sf_dir), ["l_quantity"], ["price_k"])
    path = path_from_moments(m, Spec(P.Lasso(), m.names), lambdas=[1e6, 0.0])
    return rounded(selection.ic_table(spark, path, m.n, m).drop("lambda"), 3)


@query("mfdr_curve")
def mfdr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    m = moments(df, x, ["planted"])
    path = path_from_moments(m, Spec(P.Lasso(), m.names), n_lambdas=20, lambda_min_ratio=0.01)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(path.lambdas, selection.mfdr(path, m.n, m), strict=True))], "lambda_idx int, lambda double, mfdr double")


@query("stability_probabilities")
def stability_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    df = df.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return selection.StabilitySelection(P.Lasso(), resamples=100, lambda_min_ratio=0.1).fit(df, x, "planted", "row_id").table(spark)


@query("stratified_fold_sizes", f"WITH {_LI}, c AS (SELECT l_linestatus, count(*) AS n FROM l GROUP BY 1) SELECT l_linestatus, i::INT AS fold, (n // 5 + CASE WHEN i < n % 5 THEN 1 ELSE 0 END)::BIGINT AS n FROM c, range(5) r(i)")
def stratified_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = selection.stratified_folds(lineitem(spark, sf_dir).drop("fold"), "l_linestatus", _KEYS)
    return folds.groupBy("l_linestatus", "fold").agg(F.count("*").alias("n"))


# --- inference, graphs, ordinal ----------------------------------------------------------------------------------------


def _unit(k: int):
    """The first k entries of the embedding, at about unit scale."""
    return F.transform(F.slice("embedding", 1, k), lambda v: v.cast("double") * 8).alias("x")


@query("debiased_lasso")
def debiased_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, x = _features(spark, sf_dir)
    return debiased_lasso(df, [c for c in x if c != "flag_n"], "planted").table(spark)


@query("debiased_logistic")
def debiased_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _features(spark, sf_dir)
    return debiased_glm(df.withColumn("bit", (F.col("planted") > 1.0).cast("double")), ["l_quantity", "mod7", "flag_a"], "bit", "binomial").table(spark)


_P = "SELECT vec_id, least(1.0, (vec_id * 7919 % 1009 + 1) / 1500.0) AS p FROM embeddings"


def _pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.least(F.lit(1.0), (F.pmod(F.col("vec_id") * 7919, F.lit(1009)) + 1) / 1500.0).alias("p"))


@query("bh_adjust", f"WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT vec_id, round(least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r")
def bh_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bh_adjust(_pvalues(spark, sf_dir), "p", "q").select("vec_id", F.round("q", 9).alias("q"))


@query("holm_adjust", f"WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT vec_id, round(least(1, max(p * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r")
def holm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holm_adjust(_pvalues(spark, sf_dir), "p", "q").select("vec_id", F.round("q", 9).alias("q"))


@query("edge_pvalues", "WITH v AS (SELECT label AS i, label + 1 + vec_id % 3 AS j, embedding[1]::DOUBLE AS value FROM embeddings) SELECT i::INT AS i, j::INT AS j, round(least(1, greatest(2.0 / count(*), 2.0 * least(sum((value >= 0)::INT), sum((value <= 0)::INT)) / count(*))), 9) AS p_value FROM v GROUP BY i, j")
def edge_pvalue_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("i"), (F.col("label") + 1 + F.col("vec_id") % 3).cast("int").alias("j"), F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return graphs.edge_pvalues(df).withColumn("p_value", F.round("p_value", 9))


@query("mb_threshold", "SELECT 0.5 * (1 + 4.0 * 4.0 / (45 * 2.0)) AS threshold")
def mb_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graphs.mb_stability_threshold(45, 4.0, 2.0),)], "threshold double")


@query("glasso_2x2", """WITH s AS (SELECT var_pop(l_quantity / 10) AS a, var_pop(l_tax * 100) AS b, covar_pop(l_quantity / 10, l_tax * 100) AS c FROM lineitem),
w AS (SELECT a + 0.001 AS a, b + 0.001 AS b, sign(c) * greatest(abs(c) - 0.001, 0) AS c FROM s)
SELECT i::INT AS i, j::INT AS j, round(v, 5) AS value FROM (SELECT 0 AS i, 0 AS j, b / (a * b - c * c) AS v FROM w UNION ALL SELECT 0, 1, -c / (a * b - c * c) FROM w UNION ALL SELECT 1, 1, a / (a * b - c * c) FROM w)""")
def glasso_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("q"), (F.col("l_tax") * 100).alias("t"))
    model = graphs.GraphicalLasso(0.001, tol=1e-10).fit(df, ["q", "t"])
    return rounded(graphs.precision_rows(spark, model.precision_, model.terms_).select("i", "j", "value"), 5)


@query("glasso_embeddings")
def glasso_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(_unit(64))
    model = graphs.GraphicalMCP(0.1).fit(df, "x")
    return graphs.precision_rows(spark, model.precision_, model.terms_)


@query("ebic_path")
def ebic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(_unit(64))
    return graphs.ebic_path(spark, moments(df, "x"), [0.3, 0.2, 0.1, 0.05])


@query("joint_graph")
def joint_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(_unit(64), (F.col("label") % 2).alias("pop"))
    return graphs.JointGraphicalLasso(5.0).fit(df, "x", "pop").table(spark)


@query("graph_bootstrap")
def graph_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", _unit(64))
    return graphs.GraphicalBootstrap(0.05, resamples=200).fit(df, "x", "vec_id").fdr_threshold(0.1)


@query("graph_stability")
def graph_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", _unit(64))
    return graphs.GraphicalStabilitySelection([0.05, 0.02], resamples=100).fit(df, "x", "vec_id").table(spark)


_LEVEL = "(CASE WHEN value < 25 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END)"


def _ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(F.when(v < 25, 0).when(v < 60, 1).otherwise(2).alias("a"), F.pmod("user_id", F.lit(4)).cast("int").alias("b"), v.alias("x"))


@query("polychoric_counts", f"SELECT 'a' AS col_i, {_LEVEL}::DOUBLE AS level_i, 'b' AS col_j, (user_id % 4)::DOUBLE AS level_j, count(*) AS n FROM events GROUP BY ALL")
def polychoric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.pair_counts(_ordinals(spark, sf_dir), ["a", "b"])


@query("mixed_correlation")
def mixed_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.correlation_rows(spark, ordinal.mixed_correlation(_ordinals(spark, sf_dir), ["a", "b", "x"]), ["a", "b", "x"])
