"""Mixing against its targets, and the pipeline against a plain version."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ridgeline.llm import mixing, quality
from ridgeline.llm.common import materialize

from .conftest import documents, prose
from .test_dedup import closure, lower, slow_fingerprint
from .test_tokens import check_packed, plain
from ridgeline.llm.encoding import ChunkEncoder, vocabulary


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, rest = {}, 1.5 * sum(sizes.values())
    while free := [s for s in order if s not in target]:
        level = rest / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in above} if above else {s: weight[s] * level for s in free}
        rest -= sum(target[s] for s in above)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    import random

    r = random.Random(seed)
    names = [None, "", *r.sample(["a", "b", "É", "\U0001f600", "\uffee", "Z", "ab", "aa", "s1", "s10"], 3 * seed), *(f"host{i}" for i in range(200 * (seed == 3)))]
    sizes = {s: r.choice([0, r.randrange(10), r.randrange(100), r.randrange(10_000)]) for s in names}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = slow_targets(sizes)
    assert len(rows) == len(sizes) and all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert {r["source"]: r["source_no"] for r in rows} == {s: i for i, s in enumerate(order)}


def test_a_source_for_every_document(spark):
    rows = [(i, prose(i, 60 + i % 7), "en", f"host{i}") for i in range(300)] + [(1000 + i, prose(i, 70), "en", "big") for i in range(150)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] == r["copies"] * r["size"] for r in got)
    for r in got:
        if r["source"] != "big":
            assert r["taken"] in (0, r["size"], 2 * r["size"]) and abs(r["taken"] - r["target"]) <= r["size"]
    assert abs(sum(r["taken"] for r in got if r["source"] == "big") - next(r["target"] for r in got if r["source"] == "big")) <= 80


def test_mix_reaches_targets_and_repeats_itself(spark, odd, nothing):
    rows = [(i, prose(i, 5 + (i * 37) % 120), "en", None if i % 11 == 0 else f"s{i % 4}") for i in range(400)] + [(1000, prose(9, 3000), "en", "s1"), (1000, prose(9, 3000), "en", "s1"), (1001, None, "en", "s9")]
    df = documents(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in size:
        assert abs(taken[s] - target[s]) <= max(15, 0.02 * target[s])
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r["source"]), str(r["doc_id"]), r["size"])
    assert Counter((key(r), r["copies"]) for r in again) == Counter((key(r), r["copies"]) for r in got)
    want = Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"]) for r in mixing.mix(odd).collect()) == want
    assert mixing.mix(nothing).count() == 0


def test_newton_finds_capped_rates(spark):
    cells = spark.createDataFrame([(0, 10, 0.5, 3), (0, 20, 3.0, 2), (1, 5, 1.0, 4), (2, 5, 1.0, 4)], "source_no long, size long, base double, cell_docs long")
    goals = spark.createDataFrame([(0, 95.0, 5), (1, 38.0, 4), (2, 0.0, 4), (3, 0.0, 1)], "source_no long, goal double, docs long")
    at = {r["source_no"]: r["multiplier"] for r in mixing.balance(cells, goals, n_rows=13).collect()}
    rate = lambda s, b: min(2.0, b * 2.718281828459045 ** at[s])
    assert abs(30 * rate(0, 0.5) + 40 * rate(0, 3.0) - 95) < 1e-6 and abs(20 * rate(1, 1.0) - 38) < 1e-6
    assert rate(2, 1.0) < 1e-100 and at[3] == 0.0


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = [(i, prose(i, 90 + i), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, prose(i, 90 + i).upper() if i % 2 else prose(i, 90 + i), "en", "s0") for i in range(10)]
    rows += [(200, "too short", "en", "s1"), (201, None, None, None), (202, "\n".join([prose(7, 20)] * 20), "en", "s1")]
    rows += [(300, prose(5, 400), "en", "s2"), (301, prose(5, 400).replace("the", "the,", 1), "en", "s2")]
    base = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == base.columns
    good = [r for r in rows if quality.measure(r[1])[6]]
    assert sorted(r["doc_id"] for r in seen["quality"]) == sorted(r[0] for r in good)
    last = {}
    for r in good:
        last[lower(r[1])] = max(last.get(lower(r[1]), (-1, "")), (r[0], r[1]))
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(i for i, _ in last.values())
    left = sorted(last.values())
    roots = closure([slow_fingerprint(t) for _, t in left])
    low = {}
    for (i, _), root in zip(left, roots, strict=True):
        low[root] = min(low.get(root, i), i)
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == sorted(low.values())
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert max(copies.values()) <= 2 and set(copies) <= set(low.values())
    exp, enc = defaultdict(list), ChunkEncoder(vocabulary())
    for r in seen["mixing"]:
        exp[r["doc_id"]].append([*plain(enc, r["text"]), 1])
    check_packed(seen["packing"], exp)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r["length"] for r in whole.collect()) == sum(r["length"] for r in seen["packing"])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_nothing(spark, tmp_path, stage):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "d"))
    assert stage(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path)).count() == 0
