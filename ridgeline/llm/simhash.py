"""SimHash fingerprints linked by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table, ship, split_hot_join, text_slices
from ridgeline.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Buckets of more distinct fingerprints are split further, without loss, before any task compares them.
BUCKET = 1024

_BITS = 64
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: Byte b as eight one-byte lanes of 0 or 1, lane i its bit i: sums of up to 255 bytes at a time.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> bytes:
    """Big-endian XXH64 digests of all word shingles, one after the other."""
    parts = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not parts:
        return b""
    if len(parts) <= words:
        return xxhash.xxh64_digest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    first = np.concatenate([[0], ends[:-words]]).tolist()
    last = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)])


def majority(digests: list[bytes]) -> np.ndarray:
    """Fingerprint (uint64) of each document's digests: bit j is set where over half of the hashes have it."""
    n = np.array([len(d) // 8 for d in digests], np.int64)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    hashes = np.frombuffer(b"".join(digests), ">u8").astype("<u8").view(np.uint8).reshape(-1, 8)
    starts = np.concatenate([[0], np.cumsum(n[some])])
    blocks = -(-n[some] // 255)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    cuts = np.repeat(starts[:-1] - 255 * first_block[:-1], blocks) + 255 * np.arange(first_block[-1])
    counts = np.empty((len(some), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[hashes[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        counts[:, k] = np.add.reduceat(lanes, first_block[:-1], axis=0, dtype=np.int64)
    bits = (2 * counts.reshape(len(some), _BITS) > n[some, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").copy().view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *, words: int = SHINGLE_WORDS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """(doc_id, fp, row if given): the 64-bit SimHash of each whole text as a signed long; no words: zero."""
    ship(docs.sparkSession)
    carried = [] if row is None else [F.col(row)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [majority([shingle_hashes(t, words, seed) for t in texts]) for _, texts in text_slices(batch, "text")]
            fp = np.concatenate(fp) if fp else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carried)
    return rows.mapInArrow(make, "doc_id long, fp long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[2:]))


def covering_masks(radius: int = RADIUS, bits: int = _BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bits are all left out of at least one.

    Bit i has a nonzero vector m(i) of radius + 1 binary digits; the mask of v keeps the bits with an odd
    product m(i)·v. Vectors of up to `radius` bits span less than the whole space, so
    some v is orthogonal to all of them.
    """
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def finer_masks(mask: int, radius: int = RADIUS, bits: int = _BITS) -> list[int]:
    """radius + 1 masks, each with a share of the bits that `mask` leaves out; `radius` bits out of those miss one share."""
    rest = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[j :: radius + 1]) for j in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links from every member of a group of near fingerprints to the group's smallest, within one bucket."""
    fp = np.sort(fp)
    bits = fp.view(np.uint64)
    left = np.arange(len(fp))
    out = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(bits[left] ^ bits[queue.pop()]) <= radius
            found, left = left[near], left[~near]
            queue.extend(found.tolist())
            out.extend((int(fp[i]), int(fp[root])) for i in found)
    return out


def _forest(radius: int, tables: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key; groups are small, so only an open group is carried on."""
        held = np.empty((0, 3), np.int64)

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            first = np.concatenate([[0], new])
            size = np.diff(np.concatenate([first, [len(rows)]]))
            pair = first[size == 2]
            a, b = rows[pair, 2], rows[pair + 1, 2]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
            own, u, v = [rows[pair, 0][near] // tables], [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
            for f, s in zip(first[size > 2], size[size > 2], strict=True):
                if found := bucket_links(rows[f : f + s, 2], radius):
                    more = np.array(found, np.int64)
                    own.append(np.full(len(more), rows[f, 0] // tables))
                    u.append(more[:, 0])
                    v.append(more[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (own, u, v)], names=["space", "u", "v"])

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("tab", "key", "fp")]).astype(np.int64)
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield emit(rows[:cut])
            held = rows[cut:]
        if len(held):
            yield emit(held)

    return links


def fingerprint_links(distinct: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(space, u, v): links that join exactly the distinct fingerprints (space, fp) that chains of at most `radius` differing bits join.

    Fingerprints of different spaces (numbers from 0) never meet. Each goes to one bucket per covering mask. Buckets of two up to
    `bucket` are compared inside one task and give a forest, not all pairs. Larger ones are split by finer
    masks, which lose no pair either; after three splits a bucket has too few free bits to be large. Rows of hot
    buckets stay where they are until they are split.
    """
    ship(distinct.sparkSession)
    masks = covering_masks(radius)
    tables, out = len(masks), []
    table = F.explode(F.array(*[F.struct((F.col("space") * tables + i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = distinct.select("fp", F.col("space").cast("long").alias("space")).select("fp", table.alias("_t")).select("_t.tab", "_t.key", "fp")
    n = distinct.count() * tables
    for depth in range(4):
        counts = rows.groupBy("tab", "key").agg(F.count("*").alias("_n")).filter("_n > 1")
        shared = materialize(split_hot_join(rows, materialize(counts, "bucket_sizes"), ["tab", "key"], "_n", n), "buckets")
        small = shared.filter(F.col("_n") <= bucket) if depth < 3 else shared
        grouped = small.select("tab", "key", "fp").repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
        out.append(grouped.mapInArrow(_forest(radius, tables), "space long, u long, v long"))
        large = shared.filter(F.col("_n") > bucket)
        if depth == 3 or large.isEmpty():
            break
        n = large.count() * (radius + 1)
        masks = [f for m in masks for f in finer_masks(m, radius)]
        tables *= radius + 1
        by_id = F.array(*[F.lit(_signed(m)) for m in masks])
        child = F.explode(F.sequence(F.col("tab") * (radius + 1), F.col("tab") * (radius + 1) + radius))
        rows = large.select("fp", child.alias("tab")).select("tab", F.col("fp").bitwiseAND(F.get(by_id, F.pmod("tab", F.lit(tables)).cast("int"))).alias("key"), "fp")
    links = out[0]
    for more in out[1:]:
        links = links.union(more)
    return links.distinct()


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_groups(docs: DataFrame, *, words: int = SHINGLE_WORDS, radius: int = RADIUS, bucket: int = BUCKET, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id, component_size, root) and the column `row`, if given. root is the
    component's smallest fingerprint.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits. Equal
    fingerprints are one node, so copies cost one row however many there are. Null and empty
    texts have fingerprint zero and link like any other; a null doc_id keeps its row but can't name a
    component unless all in it are null; repeated rows stay; other columns are ignored; an empty
    table gives no row.
    """
    each = materialize(fingerprints(docs, words=words, text=text, doc_id=doc_id, row=row), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "fingerprint_nodes")
    roots = connected_components(fingerprint_links(nodes.withColumn("space", F.lit(0)), radius=radius, bucket=bucket))
    placed = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root")), "fingerprint_roots")
    groups = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("component_size"), F.count("*").alias("_nodes"))
    n = each.count()
    named = split_hot_join(placed, groups, ["root"], "_nodes", n).select("fp", "copies", "component_id", "component_size", "root")
    joined = split_hot_join(each, materialize(named, "fingerprint_groups"), ["fp"], "copies", n)
    return joined.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", "component_size", "root", *([] if row is None else [row]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
