"""What the operators share: the shared folder, shipping of code, joins that stand hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3

_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, as the cluster sets it.

    Where it is unset, a local master gets a temporary folder that goes with the
    process; a cluster must set it, as no machine's own folder would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        root = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so Python functions pickled by reference resolve there."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="ridgeline-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "ridgeline_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_partition(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with one row per partition or file of another, to be broadcast: some bytes for each task the driver plans anyway."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells every row apart and is the same each time they are read: the place in its Parquet file.

    docs that aren't read straight from files are written to the shared folder first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    try:
        return docs.select("*", place)
    except AnalysisException:
        return materialize(docs, "rows").select("*", place)


def split_hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """Inner join of rows with a table that has one row per key and the key's row count.

    Keys with HOT_SHARE of all rows or more (at most 1 / HOT_SHARE of them, whatever the
    input) are broadcast, so their rows stay where they are; the others are shuffled and
    none of them is large. Null keys match null keys.
    """
    bar = max(1, int(n_rows * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(count) >= bar))
    rest = groups.filter(F.col(count) < bar)

    extra = [c for c in groups.columns if c not in keys]
    hot = hot.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *extra)
    rest = rest.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *extra)

    def cond(b: DataFrame) -> Column:
        out = None
        for k in keys:
            c = rows[k].eqNullSafe(b[f"_r_{k}"])
            out = c if out is None else out & c
        return out

    drop = [f"_r_{k}" for k in keys]
    near = rows.join(F.broadcast(hot), cond(hot), "inner").drop(*drop)
    cold = rows.join(F.broadcast(hot.select(*drop)), cond(hot), "left_anti")
    far = cold.join(rest, [cold[k].eqNullSafe(rest[f"_r_{k}"]) for k in keys], "inner").drop(*drop)
    return near.unionByName(far)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive runs of a batch that hold about max_bytes each; a longer text stands alone."""
    col = batch.column(column)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False) if len(col) else []
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > max_bytes:
            yield first, col.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += int(n)
    if len(col) > first:
        yield first, col.slice(first).to_pylist()
