"""Feature tables from other layouts: raw column-major matrix files, chunk lists, sparse triples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task reads of a raw file.
ROWS_PER_TASK = 65_536


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def _read_range(path: str, start: int, size: int) -> bytes:
    """Bytes of a file by Arrow's filesystems, so any URI that Arrow opens will do."""
    from pyarrow import fs

    where, name = (fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path))
    with where.open_input_file(name) as f:
        return f.read_at(size, start)


def read_matrix(spark: SparkSession, paths: str | list[str], n_rows: int | list[int], n_features: int, dtype: str = "f8", order: str = "F") -> DataFrame:
    """(row, x) of raw little-endian matrices: 8- or 4-byte floats, column-major ("F") or row-major ("C"); several files are row blocks.

    Each task reads its rows' stretch of every column. The file's size must be rows x features x width.
    """
    from pyarrow import fs

    paths, counts = ([paths], [n_rows]) if isinstance(paths, str) else (paths, n_rows)
    width, tasks, first = np.dtype(f"<{dtype}").itemsize, [], 0
    for path, n in zip(paths, counts, strict=True):
        where, name = (fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path))
        if where.get_file_info(name).size != n * n_features * width:
            raise ValueError(f"{path} doesn't hold {n} x {n_features} numbers of {width} bytes")
        tasks += [(path, n, a, min(n, a + ROWS_PER_TASK), first) for a in range(0, n, ROWS_PER_TASK)]
        first += n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                a, b, n = t["a"], t["b"], t["n"]
                if order == "C":
                    x = np.frombuffer(_read_range(t["path"], a * n_features * width, (b - a) * n_features * width), f"<{dtype}").reshape(-1, n_features)
                else:
                    x = np.column_stack([np.frombuffer(_read_range(t["path"], (j * n + a) * width, (b - a) * width), f"<{dtype}") for j in range(n_features)])
                offsets = pa.array(np.arange(0, x.size + 1, n_features), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(t["first"] + a, t["first"] + b)), pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float64).ravel()))], names=["row", "x"])

    plan = spark.createDataFrame(tasks, "path string, n long, a long, b long, first long").repartition(max(1, len(tasks)))
    return plan.mapInArrow(rows, "row long, x array<double>")


def from_triples(triples: DataFrame, n_features: int, row: str = "row", col: str = "col", value: str = "value", rows: DataFrame | int | None = None) -> DataFrame:
    """(row, x) from sparse (row, col, value) entries; equal places are summed, absent ones are 0.

    rows: the number of rows (numbered from 0) or a table with the column `row`; rows without an entry are zeros then. Without it only
    rows that have an entry are known.
    """
    cells = triples.groupBy(row, col).agg(F.sum(value).cast("double").alias("_v"))
    maps = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col).cast("int"), "_v"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0.0)))
    if rows is not None:
        every = triples.sparkSession.range(rows).withColumnRenamed("id", row) if isinstance(rows, int) else rows.select(row).distinct()
        maps = every.join(maps, row, "left").withColumn("_m", F.coalesce("_m", F.create_map().cast("map<int,double>")))
    return maps.select(row, dense.alias("x"))
