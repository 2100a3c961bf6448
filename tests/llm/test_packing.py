import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(FILE)
HARD = ["", " ", "ΑΣ, ΣΑΣ. It's I'LL don’t 5,6.7 áb É́.", "İx, É́. q ß", "<|endoftext|>x <|STARTOFTEXT|> y\x1cz　k ﬁ", "'S A_B.. …, x.,", "). , a). b, c.", "a" * 5000 + ", " + "é" * 3000, "\n\n.", "x***, y###. 5%, z_.", "한글 ᄒ\u1161ᆫ, ok."]


@pytest.mark.parametrize("text", HARD)
def test_ids_are_the_tokenizers(text):
    assert packing.ChunkEncoder.of(FILE).encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["VALİ, TÜRKİYE", "TARİHİ. Sonra", "İ, İ. İ", "ışık, İYİ. i̇, x"])
def test_dotted_capitals_keep_their_dots(text):
    assert packing.ChunkEncoder.of(FILE).encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["see _word_, then", "a snake_. Next", "__init__, _x_. Größe_, ß_. end", "a_,", "_. "])
def test_underscores_are_marks(text):
    assert packing.ChunkEncoder.of(FILE).encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ,.'\n\tsSİΣ_é\u0301"), st.characters(codec="utf-8")), max_size=30))
def test_ids_of_any_text(text):
    assert packing.ChunkEncoder.of(FILE).encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4), st.integers(0, 30)), max_size=40))
def test_bins_hold_all_limits(items):
    demands, cap = np.array(items, dtype=float).reshape(-1, 3), (20, 3, 15)
    bins = packing.dot_product_pack(demands, cap)
    assert sorted(i for b in bins for i in b) == list(range(len(items)))
    assert all(len(b) == 1 or (demands[b].sum(axis=0) <= cap).all() for b in bins)


def test_dot_product_prefers_the_best_aligned():
    assert packing.dot_product_pack(np.array([[6, 1], [5, 1], [4, 1], [5, 9]]), (10, 10))[0] == [3, 1]


def test_top_up_fills_gaps():
    bins = packing.top_up([[(i, 0, 1100)] for i in range(13)], 2048, 10, 32)
    fill = [sum(x[2] for x in b) for b in bins]
    assert sum(fill) == 13 * 1100 and sorted(fill)[1:] == [2048] * 6
    for i in range(13):
        own = sorted((s, n) for b in bins for j, s, n in b if j == i)
        assert [s for s, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1])


def check(rows, docs, capacity, spare):
    want = {r.doc_id: [*PLAIN.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    got = {}
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, ids in want.items():
        assert sum(n for _, n in got[i]) % len(ids) == 0
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= capacity
    assert sum(n for p in by.values() for _, n in p) >= capacity * (len(by) - spare)


def test_query_packs_all_documents(spark):
    d = "/root/testdata/sf0.001"
    check(packing.op1(spark, d).collect(), spark.read.parquet(f"{d}/documents.parquet").collect(), 2048, spare=1.5)  # one sequence of the only task is left open


def test_loss_limit_binds_and_is_filled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    got = packing.pack_documents(docs, FILE, max_loss_tokens=500).toPandas()
    loss = (got.length - (got.start == 0)).groupby(got.sequence_id).sum()
    assert loss.max() <= 500 and got.groupby("sequence_id").length.sum().max() <= 2048
    assert len(loss) <= loss.sum() / (500 - 32) + 2
    check(got.itertuples(), docs.collect(), 2048, spare=float("inf"))


def test_odd_rows(spark, odd, none):
    rows = odd.filter("doc_id IS NOT NULL")
    check(packing.pack_documents(rows, FILE).collect(), rows.collect(), 2048, spare=5)
    assert packing.pack_documents(odd, FILE).filter("doc_id IS NULL").count() == 2
    assert packing.pack_documents(none, FILE).count() == 0
    assert packing.pack_documents(rows, FILE, with_ids=True).filter("size(ids) <> length").count() == 0


def test_conversations(spark):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "w " * (3 + c % 5)) for c in range(40) for t in range(4)] + [(99, 0, None, None)], "conv_id long, turn long, role string, text string")
    items = packing.conversation_items(turns)
    got = packing.pack_items(items, capacities=(60, 8, 25)).toPandas()
    sums = got.groupby("sequence_id")[["tokens", "segments", "loss_tokens"]].sum()
    assert len(got) == 41 and (sums <= [60, 8, 25]).all().all()
    assert (got.sort_values(["sequence_id", "position"]).groupby("sequence_id").cumcount() == got.sort_values(["sequence_id", "position"]).position).all()


def test_many_small_partitions_leave_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(211)
    got = packing.pack_documents(docs, FILE).toPandas()
    assert got.length.sum() >= 0.99 * 2048 * got.sequence_id.nunique()
    check(got.itertuples(), docs.collect(), 2048, spare=float("inf"))


def test_conversations_under_three_limits(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    limits = (900, 6, 300)
    odd = spark.createDataFrame([(None, 1, "user", "a b"), (None, None, None, None), (7_777, 1, "assistant", "word " * 5_000), (7_778, 2, "user", "w " * 3_000), (7_778, 2, "user", "w " * 3_000)], "conv_id long, turn long, role string, text string")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(odd)
    want = {}
    for r in rows.collect():
        key = (r.conv_id, r.turn)
        want.setdefault(key, []).append(len(PLAIN.encode(r.text or "", add_special_tokens=False).ids) + 1)
    for parts in (1, 40):
        got = packing.pack_conversations(rows.repartition(parts), FILE, limits).toPandas()
        n = got.groupby(["conv_id", "turn"], dropna=False).length.sum()
        assert {tuple(None if x != x else int(x) for x in k): v for k, v in n.items()} == {k: sum(v) for k, v in want.items()}
        by = got.groupby("sequence_id")
        assert by.length.sum().max() <= limits[0] and by.size().max() <= limits[1] and by.example_loss_tokens.sum().max() <= limits[2]
        assert (by.size() == limits[1]).any() and (by.example_loss_tokens.sum() > 0.9 * limits[2]).any()
        for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert packing.pack_conversations(rows.limit(0), FILE, limits).count() == 0
