"""Near copies by word shingles: SimHash fingerprints in covering tables propose, the exact Jaccard similarity of the shingle sets decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, ship, split_hot_join, text_slices
from ridgeline.llm.components import connected_components
from ridgeline.llm.simhash import RADIUS, fingerprint_links, majority, shingle_hashes

SHINGLE_WORDS = 5
#: Texts are near copies from this Jaccard similarity on, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: Independent fingerprints of a text's set of words; two texts are compared if any of them differs in at most RADIUS bits.
FINGERPRINTS = 8
#: Candidates of more texts or bytes of shingles than a task takes are dealt into blocks, and every two blocks meet in a task.
TASK_ROWS, TASK_BYTES = 1024, 4 << 20
#: Shingles of at most this many texts are counted pair by pair, the others by products of matrices.
FEW = 32

#: Texts hashed at a time, so that a worker's arrays stay small.
SLICE_BYTES = 1 << 18
#: Fingerprints a task spreads over the covering tables: 15 rows each meet in its hash table, and hardly any of them combine.
TASK_PRINTS = 50_000
#: Nodes of one fingerprint are listed in so many parts first: a list has one in so many of them, and the list of the parts no more than that.
PARTS = 1024


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes (uint64) of all word shingles; of fewer words, the one of all of them; of none, nothing."""
    return np.unique(np.frombuffer(shingle_hashes(text, words), ">u8").astype(np.uint64))


def _salted(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hash functions, of values that are hashes already."""
    h = hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # the finaliser of MurmurHash3
        h = (h ^ (h >> np.uint64(33))) * np.uint64(multiplier)
    return h ^ (h >> np.uint64(33))


def word_fingerprints(texts: list[str | None], n: int = FINGERPRINTS) -> np.ndarray:
    """(texts, n) of uint64: SimHash of each text's set of words, under n hash functions; no word: zeros.

    A changed word spoils five 5-word shingles but one word, so texts with similar shingles have sets of words that differ
    in far fewer bits than fingerprints of the shingles themselves would.
    """
    sets = [shingle_set(t, 1) for t in texts]
    return np.column_stack([majority([_salted(s, k).astype(">u8").tobytes() for s in sets]) for k in range(n)])


def sketches(docs: DataFrame, *, row: str, words: int = SHINGLE_WORDS, prints: int = FINGERPRINTS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, prints, row): node is a digest of the whole text's shingle set, prints its fingerprints."""
    ship(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, "text", SLICE_BYTES):
                node = np.array([xxhash.xxh64_intdigest(shingle_set(t, words).tobytes()) for t in texts], np.uint64).view(np.int64)
                flat = pa.array(word_fingerprints(texts, prints).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * prints), flat)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node), lists, part.column(row)], names=["doc_id", "node", "prints", row])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(row))
    return rows.mapInArrow(make, f"doc_id long, node long, prints array<long>, {row} {rows.schema[row].dataType.simpleString()}")


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, sets) of int32: how many shingles each two sets share; the diagonal isn't meant to be read."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    shingle = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])[np.argsort(shingle, kind="stable")]
    _, first, count = np.unique(np.sort(shingle), return_index=True, return_counts=True)
    for n in np.unique(count[(count > 1) & (count <= FEW)]):
        at = owner[first[count == n][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(i):
                np.add.at(out, (at[:, i], at[:, j]), 1)
                np.add.at(out, (at[:, j], at[:, i]), 1)
    many = np.flatnonzero(count > FEW)
    for k in range(0, len(many), 1024):
        held = np.zeros((min(1024, len(many) - k), m), np.float32)
        for line, c in enumerate(many[k : k + 1024]):
            held[line, owner[first[c] : first[c] + count[c]]] = 1
        for i in range(0, m, 512):
            out[i : i + 512] += (held[:, i : i + 512].T @ held).astype(np.int32)
    return out


def copy_links(node: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Links from every member of a group of near copies to the group's smallest node."""
    order = np.argsort(node)
    node, sets = node[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int32)
    above, below = similarity
    common = common_shingles(sets)
    left, out = np.ones(len(node), bool), []
    for root in range(len(node)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            at = queue.pop()
            # Shared / (both - shared) >= above / below, in whole numbers.
            found = np.flatnonzero(((above + below) * common[at] >= above * (size[at] + size)) & left)
            left[found] = False
            queue.extend(found.tolist())
            out.extend((int(node[i]), int(node[root])) for i in found)
    return out


def listed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (keys, node) by key: (keys, low, nodes) twice, whose links from nodes to low join all nodes of a key.

    The first has a list for each part of a key, the second the smallest node of each part, so rows meet only those they link to
    and no task gets all rows of a common key.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS))
    parts = materialize(rows.groupBy(*keys, part.alias("_part")).agg(F.min("node").alias("low"), F.collect_list("node").alias("nodes")), "near_parts")
    heads = parts.groupBy(*keys).agg(F.min("low").alias("low"), F.collect_list("low").alias("nodes"))
    return parts.drop("_part"), materialize(heads, "near_heads")


def _links(lists: DataFrame) -> DataFrame:
    return lists.filter(F.size("nodes") > 1).select(F.explode("nodes").alias("u"), F.col("low").alias("v"))


def candidates(nodes: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(node, root): components of the nodes (node, prints) with a fingerprint of the same place that chains of at most `radius` bits join.

    Each fingerprint stands for all nodes that have it, by a link to their smallest, so it costs its rows.
    """
    parts, groups = listed(nodes.select("node", F.posexplode("prints").alias("space", "fp")), ["space", "fp"])
    spread = groups.select("space", "fp").repartition(-(-groups.count() // TASK_PRINTS) or 1, "fp")
    links = materialize(fingerprint_links(spread, radius=radius), "near_print_links")
    # Many fingerprints may link to one: their nodes and its own are listed under it.
    ends = links.select("space", F.col("u").alias("fp"), "v").union(links.select("space", F.col("v").alias("fp"), "v").distinct())
    across = listed(ends.join(groups.select("space", "fp", F.col("low").alias("node")), ["space", "fp"]).select("space", "v", "node"), ["space", "v"])
    edges = [_links(lists) for lists in (parts, groups, *across)]
    return connected_components(reduce(DataFrame.union, edges).filter("u != v").distinct())


def near_copies(docs: DataFrame, *, row: str, words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY, prints: int = FINGERPRINTS, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: (doc_id, root, row). root is the same for rows joined by links of at least `similarity`.

    row: a column that tells rows apart. Equal shingle sets are one node, so copies cost one row. Covering tables find all nodes with
    a fingerprint within `radius` bits of another's; these, and through others too, are compared all with all inside tasks, and only
    exact similarities of `words`-word shingles link; pairs never become rows.
    Null and empty texts have an empty set and are one node; a null doc_id is carried; an empty table gives no row.
    """
    each = materialize(sketches(docs, row=row, words=words, prints=prints, text=text, doc_id=doc_id), "sketches")
    nodes = materialize(each.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct(row, "prints")).alias("_one")).select("node", "copies", "_one.*"), "copy_nodes")
    wanted = materialize(candidates(nodes.select("node", "prints"), radius=radius).join(nodes.select("node", row), "node"), "copy_candidates")
    read = docs.select(F.col(text).cast("string").alias("text"), F.col(row)).join(wanted, row).select("root", "node", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, "text", SLICE_BYTES):
                part = batch.slice(first, len(texts))
                sets = pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("node"), sets], names=["root", "node", "shingles"])

    sets = materialize(read.mapInArrow(make, "root long, node long, shingles binary"), "shingle_sets")
    sizes = sets.groupBy("root").agg(F.count("*").alias("_n"), F.sum(F.length("shingles")).alias("_bytes"))
    blocks = F.ceil(F.greatest(2 * F.col("_n") / TASK_ROWS, 2 * F.col("_bytes") / TASK_BYTES)).cast("long")
    sizes = sizes.withColumn("_blocks", F.when((F.col("_n") <= TASK_ROWS) & (F.col("_bytes") <= TASK_BYTES), 1).otherwise(F.greatest(blocks, F.lit(2))))
    dealt = split_hot_join(sets, materialize(sizes.select("root", "_n", "_blocks"), "copy_sizes"), ["root"], "_n", sets.count())
    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda b: (b != F.col("_own")) | (F.col("_blocks") == 1))
    dealt = dealt.withColumn("_own", own).withColumn("_other", F.explode(others))
    tasks = dealt.select("root", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), "node", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        found = copy_links(group.column("node").to_numpy(), [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()], similarity)
        links = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": links[:, 0], "v": links[:, 1]})

    roots = connected_components(tasks.groupBy("root", "a", "b").applyInArrow(compare, "u long, v long"))
    placed = nodes.join(roots, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root"))
    return split_hot_join(each.select("doc_id", "node", row), materialize(placed, "copy_roots"), ["node"], "copies", each.count()).select("doc_id", "root", row)
