"""Exact deduplication of batches against immutable snapshots screened by static binary fuse filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table, ship, split_hot_join
from ridgeline.llm.fuse_filter import FuseFilter

#: Distinct digests that one filter holds at most, on average.
SHARD_KEYS = 32768

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def normalize(text: bytes | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed; null is empty."""
    return (text or b"").translate(_LOWER)


def _digests(with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [normalize(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            names, cols = ["doc_id", "digest"], [batch.column("doc_id"), digests]
            if with_text:
                names, cols = [*names, "content"], [*cols, pa.array(texts, pa.binary())]
            elif "uid" in batch.schema.names:
                names, cols = [*names, "uid"], [*cols, batch.column("uid")]
            else:
                names, cols = [*names, "uid"], [*cols, pa.array(np.arange(base, base + len(texts)))]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            base += len(texts)

    return rows


def text_digests(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """(doc_id, digest, uid), written to the shared folder: SHA-256 of each normalised text, and the column `row` or else a number for each row."""
    ship(docs.sparkSession)
    uid = [] if row is None else [F.col(row).alias("uid")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *uid)
    kind = rows.schema["uid"].dataType.simpleString() if uid else "bigint"
    return materialize(rows.mapInArrow(_digests(False), f"doc_id long, digest binary, uid {kind}"), "digests")


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: how many rows have it, and the (doc_id, uid) that would stay. Partially aggregated, so copies are no hot key."""
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "uid")).alias("last"))


def _key(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), ">u8").astype(np.uint64)


def _shard(bits: int) -> Column:
    """The digest's first bits; digests are uniform, so shards are even."""
    return F.shiftright(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), 32 - bits)


@dataclass
class Snapshot:
    """An immutable set of digests: exact buckets (digest, n, last) and a filter for each shard of them."""

    buckets: DataFrame
    filters: DataFrame
    bits: int

    @classmethod
    def of(cls, digests: DataFrame) -> Snapshot:
        spark = digests.sparkSession
        buckets = materialize(group_digests(digests), "snapshot")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        bits = min(24, max(0, math.ceil(math.log2(max(buckets.count() / SHARD_KEYS, tasks, 1)))))

        def build(key: tuple, table: pa.Table) -> pa.Table:
            f = FuseFilter.build(_key(table.column("digest")))
            return pa.table({"shard": [key[0].as_py()], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "slots": pa.array([f.slots.tobytes()], pa.binary())})

        filters = buckets.select(_shard(bits).alias("shard"), "digest").groupBy("shard").applyInArrow(build, "shard long, seed long, segment long, segments long, slots binary")
        return cls(buckets, materialize(filters, "filters"), bits)

    def screen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups (any with a digest column) that the filters let through: all that the snapshot holds, few others."""

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows or not left.num_rows:
                return left.slice(0, 0).select(["digest"])
            r = right.to_pylist()[0]
            f = FuseFilter(r["seed"], r["segment"], r["segments"], np.frombuffer(r["slots"], np.uint8))
            return left.filter(pa.array(f.contains(_key(left.column("digest"))))).select(["digest"])

        shards = groups.select(_shard(self.bits).alias("shard"), "digest").groupBy("shard")
        return shards.cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "digest binary")


def same_bytes(docs: DataFrame, pairs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digests of pairs (digest, doc_id of one row on each side) whose normalised texts are equal byte by byte.

    One text per side and digest is compared, not one per copy. Texts meet by grouping on the bytes themselves.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    contents = rows.mapInArrow(_digests(True), "doc_id long, digest binary, content binary")
    wanted = pairs.select(F.col("digest").alias("_d"), F.col("doc_id").alias("_i")).distinct()
    # Texts are shuffled whatever the number of pairs, so that the plan is the same at every size.
    found = contents.join(wanted.hint("merge"), contents["doc_id"].eqNullSafe(wanted["_i"]) & (contents["digest"] == wanted["_d"]))
    texts = found.groupBy("digest", "content").agg(F.count("*").alias("_n"))
    return texts.groupBy("digest").agg(F.count("*").alias("_texts")).filter("_texts = 1").select("digest")


def dedup_against(snapshot: Snapshot, incoming: DataFrame, docs: DataFrame, **columns: str) -> DataFrame:
    """One row per (batch, digest): batch 0 the snapshot's, 1 the incoming rows'; n and last over all rows of that text.

    The new batch is grouped on its own. Its digests go through the snapshot's filters; what they let
    through joins the exact buckets, and the bytes of both sides are compared; only then do the two
    groups become one. The rest is new.
    """
    fresh = materialize(group_digests(incoming), "incoming")
    through = snapshot.screen(fresh)
    old = snapshot.buckets.select("digest", F.col("n").alias("old_n"), F.col("last").alias("old_last"))
    met = materialize(fresh.join(through, "digest").join(old, "digest"), "met")
    pairs = met.select("digest", "last.doc_id").union(met.select("digest", "old_last.doc_id"))
    equal = same_bytes(docs, pairs, **columns)
    both = materialize(met.join(equal, "digest").select("digest", (F.col("n") + F.col("old_n")).alias("all_n"), F.greatest("last", "old_last").alias("all_last")), "same")

    def whole(groups: DataFrame, batch: int) -> DataFrame:
        return groups.join(both, "digest", "left").select(F.lit(batch).alias("batch"), "digest", F.coalesce("all_n", "n").alias("n"), F.coalesce("all_last", "last").alias("last"))

    return whole(snapshot.buckets, 0).union(whole(fresh, 1))


def exact_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, digest, uid). row: a column that tells rows apart, given back as uid.

    Half of the rows, by a hash of their number, form the snapshot; the other half are the incoming batch.
    Texts are equal when their normalised bytes are. The row with the largest doc_id stays; of rows that share
    that doc_id too, exactly one does. Null text counts as empty; a null doc_id stays only if all of its group
    are null; other columns are ignored; an empty table gives no row.
    """
    rows = text_digests(docs, text=text, doc_id=doc_id, row=row).withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(2)).cast("int"))
    snapshot = Snapshot.of(rows.filter("batch = 0"))
    groups = materialize(dedup_against(snapshot, rows.filter("batch = 1"), docs, text=text, doc_id=doc_id), "digest_groups")
    joined = split_hot_join(rows, groups, ["batch", "digest"], "n", rows.count())
    return joined.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("last.uid")).alias("kept"), "digest", "uid")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
