"""Token output and packing: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import packing
from ridgeline.llm.common import shared_path
from ridgeline.llm.encoding import ChunkEncoder, vocabulary
from ridgeline.llm.token_output import read_tokens, token_digests, write_tokens


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(vocabulary())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="abÉéß.,' \n\u00a0\u0301<|endoftx>1", max_size=40)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_memo_equals_the_library(texts):
    enc = test_memo_equals_the_library.__dict__.setdefault("enc", ChunkEncoder(vocabulary(), memo=50))
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = enc.encode(texts, end=7)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*plain(enc, t), 7]


def test_memo_is_bounded_by_bytes():
    enc, rng = ChunkEncoder(vocabulary(), memo=1 << 20), np.random.default_rng(0)
    for k in range(12):  # chunks without a space: sentences of 500 Chinese characters
        texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 500))) for _ in range(100)]
        before = enc.held()
        ids, bounds = enc.encode(texts)
        assert enc.held() <= (1 << 20) + 100 * (1500 + 120 + 4 * 1500)
        assert ids[: bounds[1]].tolist() == plain(enc, texts[0])
    assert enc.held() < 12 * 100 * 1500 and before > 0


def test_token_files_hold_every_document_in_order(spark, odd, encoder):
    path = shared_path(spark, "t")
    write_tokens(odd, path)
    got = token_digests(spark, path).collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(ids := [*plain(encoder, r["text"]), 2]), crc(ids)) for r in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0, *[r["n_tokens"] for r in by_start]])[:-1].tolist()
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in by_start]
    assert ids == sorted(ids)
    one = read_tokens(spark, path).filter("doc_id = 40")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,40)]" in one._jdf.queryExecution().toString()


def test_token_files_of_nothing(spark, nothing):
    path = shared_path(spark, "t")
    write_tokens(nothing, path)
    assert token_digests(spark, path).count() == 0


def check_packed(rows, exp):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
        held = sum(r["length"] for r in own)
        assert 0 < held <= packing.CAPACITY
        padding += 0 if held & (held - 1) == 0 else packing.CAPACITY - held
    for key, texts in exp.items():
        own = by_doc[key]
        assert sum(r["length"] for r in own) == sum(map(len, texts))
        for r in own:
            assert any(len(t) == r["doc_tokens"] and crc(t[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for t in texts)
    return padding


def test_packing_places_every_token_once(odd, encoder):
    exp = {}
    for r in odd.select("doc_id", "text").collect():
        exp.setdefault(r["doc_id"], []).append([*plain(encoder, r["text"]), 1])
    rows = packing.pack(odd).collect()
    padding = check_packed(rows, exp)
    assert padding <= 0.01 * sum(len(t) for v in exp.values() for t in v)
    assert len({r["doc_id"] for r in rows}) == len(exp)


def test_packing_nothing(nothing):
    assert packing.pack(nothing).count() == 0


@given(st.lists(st.integers(1, 300), max_size=80), st.integers(1, 5), st.integers(0, 4))
@settings(max_examples=100, deadline=None)
def test_packer_is_bounded_and_whole(sizes, windows, slack):
    p = packing.Packer(64, windows, slack)
    for i, n in enumerate(sizes):
        p.add(i, n)
        assert len(p.open) <= windows and all(0 < h < 64 for h, _ in p.open)
    sequences = p.full + packing.merge([w for _, w in p.open], 64, slack)
    seen = {}
    for s in sequences:
        held = sum(n for _, _, n in s)
        assert held <= 64 and (64 - held <= slack or held & (held - 1) == 0)
        for d, start, n in s:
            seen.setdefault(d, []).append((start, n))
    for i, n in enumerate(sizes):
        at = 0
        for start, m in sorted(seen[i]):
            assert start == at
            at += m
        assert at == n
