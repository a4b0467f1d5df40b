"""Token ids in ORC: stripes with run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import by_partition, read_table, shared_path, ship, text_slices
from ridgeline.llm.encoding import encoder, vocabulary

STRIPE_BYTES = 8 << 20
INDEX_ROWS = 1000
BLOOM_FPP = 0.01
END_ID = 2

FILE_SCHEMA = "doc_id long, ids array<int>, n_tokens int, file_no int, file_start long"


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text and write ids as ORC in ascending doc_id order.

    One shuffle by doc_id range carries the texts; each range is sorted, encoded and
    written by one task, so the files in name order hold the documents in id order.
    Every row also has its file's number and the ids before it in that file. The ids are
    an ORC list of integers (run-length encoding version 2); rows are indexed every
    INDEX_ROWS rows, and doc_id has a Bloom filter per index entry.

    A null text counts as empty and gives the end id alone; a null doc_id comes first;
    rows with one doc_id follow a hash of their text, so their order does not depend on the run. An
    empty table writes no row. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    ship(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(vocabulary(tokenizer)), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column("doc_id")
            for first, texts in text_slices(batch, "text"):
                ids, bounds = enc.encode(texts, end)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(first, len(texts)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))),
                        pa.array(n, pa.int32()),
                        pa.array(np.full(len(n), part), pa.int32()),
                        pa.array(start + bounds[:-1], pa.int64()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "file_no", "file_start"],
                )
                start += int(bounds[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    (
        ranged.mapInArrow(encode, FILE_SCHEMA)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.compress", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_tokens. Filters on doc_id reach ORC's stripe statistics, row indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def file_starts(tokens: DataFrame) -> DataFrame:
    """(file_no, first): ids in the files before each. One row per file; only two short columns are read."""
    ends = tokens.groupBy("file_no").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("held")).collect()
    first, out = 0, []
    for r in sorted(ends, key=lambda r: r["file_no"]):
        out.append((r["file_no"], first))
        first += r["held"]
    return by_partition(tokens.sparkSession, out, "file_no int, first long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        bounds, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[a:b].data) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("file_no"), batch.column("file_start"), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "file_no", "file_start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, taken from the ids in the files, stripe by stripe in parallel."""
    ship(spark)
    tokens = read_tokens(spark, path)
    starts = file_starts(tokens)
    rows = tokens.select("doc_id", "ids", "file_no", "file_start").mapInArrow(_digest, "doc_id long, file_no int, file_start long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "file_no").select("doc_id", (F.col("first") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
