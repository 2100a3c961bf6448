from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import lattice_sampling as ls
from quillon.llm import ngram_join as nj

PIECES = ls.Pieces.of(ls.default_model(), 1.0)


def segmentations(lat, unit):
    i = int(lat.ids([unit])[0])

    def go(node):
        if node == lat.first[i]:
            return [((), 0.0)]
        return [(p + (int(lat.piece[e]),), w + lat.logp[e]) for e in range(lat.into[node], lat.into[node + 1]) if lat.logp[e] > -np.inf for p, w in go(lat.source[e])]

    return dict(go(lat.last[i]))


def test_samples_follow_the_distribution_without_replacement():
    lat, n = ls.Lattices(PIECES), 20_000
    p = {s: np.exp(w) for s, w in segmentations(lat, " abc").items()}
    assert abs(sum(p.values()) - 1) < 1e-9
    got = ls.gumbel_top_k(["abc"] * n, np.random.default_rng(1).integers(0, 2**63, n, dtype=np.uint64), lat, 2)
    pairs = Counter((tuple(a[0].tolist()), tuple(b[0].tolist())) for a, b in got)
    for a in p:
        assert abs(sum(c for (x, _), c in pairs.items() if x == a) / n - p[a]) < 0.012
        for b in p:
            if a != b:
                assert abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.012
    assert abs(np.mean([sum(np.exp(s[1] - s[3]) for s in x) for x in got]) - 1) < 0.02  # p over inclusion score is unbiased


def test_all_segmentations_come_out_once():
    lat = ls.Lattices(PIECES)
    want = segmentations(lat, " abc")
    for found in ls.gumbel_top_k(["abc"] * 20, np.arange(20, dtype=np.uint64), lat, 50):
        assert {tuple(f[0].tolist()) for f in found} == set(want) and len(found) == len(want)
        assert all(abs(f[1] - want[tuple(f[0].tolist())]) < 1e-6 and f[3] == 0 for f in found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    for ids, *_ in ls.gumbel_top_k([text], np.array([7], dtype=np.uint64), ls.Lattices.of(PIECES), 3)[0]:
        assert PIECES.decode(ids.tolist()) == text


def test_units_lose_no_segmentation():
    text = "word, next.x ..a,b  c"
    units = PIECES.units.findall(" " + text)
    assert "".join(units) == " " + text
    for cut in np.cumsum([len(u) for u in units])[:-1]:
        for i in range(len(text) + 1):
            for j in range(i + 2, min(len(text) + 1, i + 17) + 1):
                if i < cut < j:
                    assert not any(t == (" " + text)[i:j].encode() for t in PIECES.text_of)


def test_segmentation_query(spark, odd, none):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = ls.op2(spark, d).toPandas()
    assert got.groupby("doc_id").ids_crc32.nunique().eq(2).all()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in ls.sample_segmentations(docs, ls.default_model(), with_ids=True).collect():
        assert PIECES.decode(r.ids) == text[r.doc_id]
    again = ls.sample_segmentations(docs.repartition(7), ls.default_model()).toPandas()
    key = ["doc_id", "sample"]
    assert got.sort_values(key, ignore_index=True).ids_crc32.equals(again.sort_values(key, ignore_index=True).ids_crc32)
    rows = ls.sample_segmentations(odd, ls.default_model(), with_ids=True).toPandas()
    assert len(rows[rows.doc_id == 5]) == 1 and rows[rows.doc_id == 2].ids_crc32.nunique() == 2 and len(rows[rows.doc_id == 2]) == 4
    assert ls.sample_segmentations(none, ls.default_model()).count() == 0


def brute(rows, n, num, den):
    """Components of all pairs, by Python sets of word tuples."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        for c in "\t\n\x0b\x0c\r":
            text = (text or "").replace(c, " ")
        w = [x for x in text.translate(lower).split(" ") if x]
        sets.append(frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)] = min(groups.get(find(k), i), i)
    return Counter((i, len(sets[k]), groups.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def near_copies(seed, families=6, copies=25, words=60, edits=4):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{x}" for x in rng.integers(0, 40, words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.integers(0, edits)):
                w[rng.integers(0, words)] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"few": 4}), (3, {"few": 4, "part_tokens": 300}), (4, {"orders": 1, "few": 2, "often": 1}), (5, {"n": 5, "num": 80}), (6, {"few": 4, "long_list": 8, "part_tokens": 400}), (7, {"few": 2, "long_list": 3, "part_tokens": 200, "num": 80}), (8, {"id_bits": 13})])
def test_join_equals_brute_force(spark, seed, options):
    rows = near_copies(seed)
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows, options.get("n", 3), options.get("num", 90), 100)


def test_join_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in nj.op8(spark, d).collect()) == brute(rows, 3, 90, 100)


def test_join_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(tuple(r) for r in nj.ngram_jaccard_join(odd).collect()) == brute(rows, 3, 90, 100)
    assert nj.ngram_jaccard_join(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAb é\t\n\x0b\u00a0"), max_size=20), max_size=6))
def test_shingles_of_any_text(texts):
    import pyarrow as pa

    got = [len(s) for s in nj.Shingler(3).sets(pa.array(texts, pa.string()))]
    assert got == [n for i in range(len(texts)) for (_, n, _) in brute([(i, texts[i])], 3, 9, 10)]


def test_weights_and_segmentations_come_from_the_vocabulary_file():
    """The lattice's segmentations and chances, against an enumeration from the file itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=ls.default_model())
    n = sp.get_piece_size()
    pieces = {sp.id_to_piece(i): (i, -np.log(abs(sp.get_score(i)) + 2)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}

    def cut(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces:
                i, w = pieces[rest[:k]]
                for ids, more in cut(rest[k:]):
                    yield (i, *ids), w + more

    lat = ls.Lattices(PIECES)
    for word in ("abc", "token", "the"):
        want = dict(cut("▁" + word))
        total = np.log(sum(np.exp(w) for w in want.values()))
        got = {s[::-1]: w for s, w in segmentations(lat, " " + word).items()}
        got = got if set(got) == set(want) else {s[::-1]: w for s, w in got.items()}
        assert set(got) == set(want) and len(want) > 2
        assert all(abs(got[s] - (w - total)) < 1e-5 for s, w in want.items())


def test_decoding_a_table(spark, odd):
    sampled = ls.sample_segmentations(odd, ls.default_model(), k=1, with_ids=True)
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    got = ls.decode_pieces(sampled.withColumn("extra", F.lit(1)), ls.default_model()).collect()
    assert len(got) == odd.count() and all(r.text == text[r.doc_id] for r in got if r.doc_id is not None) and got[0].extra == 1
    assert ls.decode_pieces(sampled.withColumn("ids", F.lit(None).cast("array<int>")), ls.default_model()).filter("text IS NULL").count() == odd.count()
