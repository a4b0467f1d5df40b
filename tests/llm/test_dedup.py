"""Exact and near deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from ridgeline.llm import near_copies, simhash
from ridgeline.llm.common import split_hot_join
from ridgeline.llm.components import connected_components
from ridgeline.llm.exact_dedup import Snapshot, dedup_against, exact_groups, text_digests
from ridgeline.llm.fuse_filter import FuseFilter

from .conftest import documents, prose


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_equal_brute_force(odd):
    groups = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        groups[hashlib.sha256(lower(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    got = exact_groups(odd).collect()
    assert len(got) == odd.count()
    kept = defaultdict(int)
    for r in got:
        own = groups[r["digest"].hex()]
        present = [i for i in own if i is not None]
        assert r["group_size"] == len(own) and r["keep_id"] == (max(present) if present else None)
        kept[r["digest"].hex()] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert dict(kept) == dict.fromkeys(groups, 1)


def test_exact_groups_of_nothing(nothing):
    assert exact_groups(nothing).count() == 0


def test_snapshot_lets_all_its_own_through_and_few_others(spark, odd):
    rows = text_digests(odd)
    snapshot = Snapshot.of(rows.filter("doc_id < 20"))
    own = snapshot.buckets.select("digest")
    assert snapshot.screen(own).count() == own.count()
    groups = dedup_against(snapshot, rows.filter("doc_id >= 20 or doc_id is null"), odd)
    same = groups.filter("batch = 1 and n > 3").collect()
    assert {r["n"] for r in same} <= {4, 15}
    old = {bytes(r["digest"]): r["n"] for r in groups.filter("batch = 0").collect()}
    assert max(old.values()) == 4  # the copied text of document 3, thrice in the new batch


@given(st.sets(st.integers(0, 2**64 - 1), max_size=3000))
@settings(max_examples=40, deadline=None)
def test_fuse_filter_has_no_false_negative(keys):
    keys = np.array(sorted(keys), np.uint64)
    made = FuseFilter.build(np.concatenate([keys, keys]))
    assert made.contains(keys).all()


def test_fuse_filter_rate_and_size():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 30_000).astype(np.uint64)
    made = FuseFilter.build(keys)
    assert len(made.slots) < 1.35 * len(keys)
    others = rng.integers(2**63, 2**64 - 1, 100_000, dtype=np.uint64)
    assert made.contains(others).mean() < 0.006


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def closure(values, radius=3):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_masks_cover_every_small_difference():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for a in range(64):
        for b in range(a):
            for c in range(b):
                d = 1 << a | 1 << b | 1 << c
                assert any(not m & d for m in masks)
    finer = simhash.finer_masks(masks[0])
    rest = [i for i in range(64) if not masks[0] >> i & 1]
    assert all(any(not f & (1 << x | 1 << y | 1 << z) for f in finer) for x in rest for y in rest for z in rest)
    assert all(f & masks[0] == masks[0] for f in finer)


def test_near_groups_equal_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    values = [slow_fingerprint(r["text"]) for r in rows]
    roots, low = closure(values), {}
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            low[root] = min(low.get(root, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{v:016x}", str(low.get(root))) for r, v, root in zip(rows, values, roots, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_groups(odd).collect())
    assert got == want


def test_near_groups_of_nothing(nothing):
    assert simhash.near_groups(nothing).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 1024])
def test_splitting_buckets_loses_no_link(spark, bucket):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    values = set(base)
    for b in base:
        for _ in range(40):
            v = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(0, v - 2**64 if v >= 2**63 else v) for v in values], "space int, fp long")
    comp = {r["node"] % 2**64: r["root"] % 2**64 for r in connected_components(simhash.fingerprint_links(df, bucket=bucket)).collect()}
    roots = closure(values)
    groups, made = defaultdict(set), defaultdict(set)
    for v, r in zip(values, roots, strict=True):
        groups[r].add(v)
        made[comp.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, made.values()))


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in (a, b))]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if any(sets) else 1.0


def edited(text, seed, share):
    rng, words = np.random.default_rng(seed), text.split()
    for i in rng.choice(len(words), int(share * len(words)), replace=False):
        words[i] = f"x{rng.integers(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("rows", [4096, 6])
def test_near_copies_equal_brute_force_jaccard(spark, odd, monkeypatch, rows):
    monkeypatch.setattr(near_copies, "TASK_ROWS", rows)
    texts = [r["text"] for r in odd.collect()]
    texts += [edited(prose(900 + i, 150 + 20 * i), 10 * i + k, share) for i in range(12) for k, share in enumerate((0, 0.005, 0.01, 0.02, 0.022, 0.024, 0.03, 0.05))]
    texts += [edited(prose(990, 300), 500 + k, 0.01) for k in range(40)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert sum(jaccard(texts[i], texts[j]) < 0.85 for i, j in near) > 10
    parent = list(range(len(texts)))
    for i, j in near:
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    got = defaultdict(set)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, place long").repartition(3)
    for r in near_copies.near_copies(docs, row="place").collect():
        got[r["root"]].add(r["place"])
    want = defaultdict(set)
    for i, p in enumerate(parent):
        want[p].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pipeline_drops_what_is_0_8_similar_and_only_that(spark, tmp_path):
    base = prose(55, 400)
    rows = [(1, base), (2, edited(base, 1, 0.02)), (3, edited(base, 2, 0.05))]
    assert jaccard(base, rows[1][1]) >= 0.8 > jaccard(base, rows[2][1])
    documents(spark, [(i, t, "en", "s") for i, t in rows]).select("doc_id", "text", "source").write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_fingerprints_go_to_tasks_of_bounded_size(spark, monkeypatch):
    values, seen = [[int(x) for x in row] for row in np.random.default_rng(8).integers(0, 2**62, (200, 2))], []
    values += [[a ^ 5, b + 2**61] for a, b in values[:50]]
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, prints array<long>").coalesce(1)
    links = near_copies.fingerprint_links
    monkeypatch.setattr(near_copies, "TASK_PRINTS", 60, raising=False)
    monkeypatch.setattr(near_copies, "fingerprint_links", lambda rows, **more: seen.append([len(x) for x in rows.rdd.glom().collect()]) or links(rows, **more))
    got = {(r["node"], r["root"]) for r in near_copies.candidates(nodes).collect()}
    assert got == {(i, i % 200) for i in [*range(50), *range(200, 250)]}
    assert sum(seen[0]) == 500 and max(seen[0]) <= 2 * 60


@pytest.mark.parametrize("hot", [0, 400, 800])
def test_the_join_of_fingerprints_makes_a_row_for_each_at_most(spark, hot):
    rows = [(i, i % 8, 7 if i < hot else i // 2) for i in range(2000)]
    each = spark.createDataFrame(rows, "node long, space int, fp long")
    groups = each.groupBy("space", "fp").agg({"node": "min", "*": "count"}).toDF("space", "fp", "_n", "low")
    got = split_hot_join(each, groups, ["space", "fp"], "_n", len(rows)).collect()
    assert sorted(r["node"] for r in got) == list(range(2000))


@pytest.mark.parametrize("parts", [1, 3, 1024])
def test_nodes_of_a_common_fingerprint_are_listed_and_not_joined(spark, monkeypatch, parts):
    rng, made = np.random.default_rng(9), []
    monkeypatch.setattr(near_copies, "PARTS", parts, raising=False)
    values = [[7, 2**61 + i] for i in range(300)] + [[int(x) for x in row] for row in rng.integers(0, 2**62, (300, 2))]
    values += [[6, int(rng.integers(0, 2**62))]] + [[values[400][0] ^ 1 << i, int(rng.integers(0, 2**62))] for i in range(30, 60)]
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, prints array<long>")
    monkeypatch.setattr(near_copies, "connected_components", lambda edges: made.append(edges) or connected_components(edges))
    got = {r["node"]: r["root"] for r in near_copies.candidates(nodes).collect()}
    assert all(got[i] == 0 for i in [*range(300), 600]) and all(got[i] == 400 for i in [400, *range(601, 631)]) and len(got) == 332
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "fp#" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_shared_shingles_are_counted():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(0, 200, 90)]
    got = near_copies.common_shingles(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(90) for j in range(90) if i != j)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and len(got) == 101
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
