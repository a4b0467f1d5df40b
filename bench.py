"""Times of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ["standardize_stats", "gram_moments", "wide_gram_embeddings", "mcp_path", "embedding_lasso_path", "group_mcp_path", "sparse_group_mcp_path", "logistic_mcp_path", "poisson_lasso_path", "huber_scad_path", "cox_mcp_path", "cox_surrogate_efron", "cv_table_mcp", "stability_probabilities", "debiased_lasso", "glasso_embeddings", "graph_bootstrap", "predict_multinomial"]


def published(spark, n: int = 10_000, p: int = 1000) -> dict[str, float]:
    """The published problem sizes: Gaussian rows, 100 lambdas down to 1e-3 of the top, from one DataFrame of an array column."""
    import numpy as np
    import pyarrow as pa

    from ridgeline.operators import penalties as P
    from ridgeline.operators.paths import fit_path

    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, p))
    beta = np.zeros(p)
    beta[:: p // 20] = rng.choice([-1.0, 1.0], len(beta[:: p // 20]))
    y = x @ beta + np.sqrt(beta @ beta / 5) * rng.standard_normal(n)
    arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p + 1, p), pa.int32()), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"x": arrays, "y": y})).repartition(8).cache()
    df.count()
    out = {}
    for name, penalty, kwargs in (("ls_lasso", P.Lasso(), {}), ("ls_elasticnet", P.ElasticNet(0.5), {}), ("ls_mcp", P.MCP(), {}), ("ls_scad", P.SCAD(), {}), ("ls_group_lasso", P.GroupLasso(), {"groups": np.repeat(np.arange(p // 10), 10)})):
        began = time.perf_counter()
        fit_path(df, "x", "y", penalty, n_lambdas=100, lambda_min_ratio=1e-3, tol=1e-7, **kwargs)
        out[f"{name}_{n}x{p}"] = round(time.perf_counter() - began, 3)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from ridgeline.plans.session import session
    from ridgeline.queries import QUERIES

    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).count()  # compiles code and warms caches of files
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    if os.environ.get("BENCH_PUBLISHED", "1") == "1":
        times |= published(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
