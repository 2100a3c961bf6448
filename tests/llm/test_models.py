import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, multi_index, toxicity


def greedy_phrases(text: str, corpus: str) -> int:
    """Cross-parsing by hand: the longest phrase that occurs in the corpus, again and again; an unknown symbol is one."""
    n = at = 0
    while at < len(text):
        long = 1
        while at + long <= len(text) and text[at : at + long] in corpus:
            long += 1
        at, n = at + max(1, long - 1), n + 1
    return n


def test_parse_equals_brute_force():
    corpus = {"a": "the cat sat on the mat and the dog", "b": "der hund und die katze sitzen auf"}
    p = langid.CrossParser.fit(list(corpus.items()))
    texts = ["the hund sat", "katze", "zzz the", "a", "the cat sat on the mat and"]
    bits, lettered = p.entropies(texts)
    assert lettered.all()
    for i, t in enumerate(texts):
        for k, lang in enumerate(p.langs):
            # Letters outside both corpora are one unknown symbol, which occurs in neither.
            want = greedy_phrases("".join(c if c in "".join(corpus.values()) else "?" for c in t), corpus[lang])
            assert round(bits[i, k] * len(t) / p.bits[k]) == want


def test_blocks_add_one_phrase_at_most():
    p = langid.CrossParser.fit([("a", "abcdefgh " * 200)])
    text = "abcdefgh " * 150
    whole, _ = p.entropies([text])
    assert whole[0, 0] * len(text) / p.bits[0] <= 1 + len(text) // langid.BLOCK


def test_language_query_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    got = langid.op9(spark, d).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.99 and got.score.between(0, 1).all()


def test_all_chosen_documents_are_learned():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdefghij"), 1_500)) for _ in range(langid.DOCS_PER_LANG)]
    p = langid.CrossParser.fit([("a", t) for t in texts])
    ends, _ = p.entropies([part for t in texts for part in (t[:60], t[-60:-1])])
    new, _ = p.entropies(["".join(rng.choice(list("abcdefghij"), 60)) for _ in range(50)])
    assert ends.max() < new.min() / 3


def test_no_language_is_left_out(spark):
    docs = spark.range(70 * 100).selectExpr("id AS doc_id", "concat('l', lpad(id % 70, 2, '0')) AS lang", "concat('head', repeat('-', 2000), 'tail') AS text")
    rows = langid.training_rows(docs)
    assert len({lang for lang, _ in rows}) == 70 and len(rows) == 70 * (langid.CHARS_PER_LANG // 2_008)
    assert all(len(t) == 2_008 for _, t in rows)


def test_documents_are_learned_whole_and_languages_bounded(spark, monkeypatch):
    long = "x" * (langid.CHARS_PER_LANG + 1)
    docs = [(i, "a", "aa bb") for i in range(1, 90)] + [(100, "a", long), (101, "b", long + "yy"), (102, "b", long + "y"), (103, "b", long + "yyy"), (104, "c", "12"), (105, None, "no")]
    docs = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5]
    rows = langid.training_rows(spark.createDataFrame(docs, "doc_id long, lang string, text string"))
    assert [t for lang, t in rows if lang == "a"] == ["aa bb"] * 64
    assert [t for lang, t in rows if lang == "b"] == [min((t for _, lang, t in docs if lang == "b"), key=len)]
    assert {lang for lang, _ in rows} == {"a", "b"}
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        langid.training_rows(spark.createDataFrame(docs, "doc_id long, lang string, text string"))


def test_language_odd_rows(spark, odd, none):
    p = langid.CrossParser.fit([("en", "the word and a word"), ("de", "die größe und naive")])
    got = langid.identify(odd, p).toPandas()
    assert len(got) == odd.count() and "Score" not in got.columns
    assert set(got[got.text.isna() | got.doc_id.isin([5, 6, 8])].lang_pred) == {"und"}
    assert got[got.doc_id == 7].lang_pred.tolist() == ["en"] and got[got.doc_id == 10].lang_pred.tolist() == ["de"]
    assert langid.identify(none, p).count() == 0
    assert set(langid.identify(odd, langid.CrossParser.fit([])).toPandas().lang_pred) == {"und"}
    assert langid.training_rows(none) == []


def brute(ids, x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[ids == ids[i]] = -np.inf
        yield ids[i], ids[np.lexsort((ids, -s))[:k]], s


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16)) + 2 * rng.normal(size=(8, 16))[rng.integers(0, 8, 4000)]
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x.astype("float32"), strict=True)], "vec_id long, embedding array<float>")
    got = multi_index.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    found = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    hits = 0
    for q, want, s in brute(ids, x.astype("float32").astype(float), 5):
        assert list(found[q]["rank"]) == [1, 2, 3, 4, 5] and np.allclose(found[q].score, s[found[q].vec_id], atol=1e-12)
        hits += len(set(want) & set(found[q].vec_id))
    assert hits >= 0.9 * 5 * len(found)


def test_nearest_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 3)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 1)
    same = [(i, [1.0, 2.0, 2.0, 0.0]) for i in range(12)]  # one cell, split over blocks; ties go to the smaller ids
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 0.0, 0.0]), (104, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (50, [2.0, 4.0, 4.0, 0.0]), (3, [1.0, 2.0, 2.0, 0.0])]
    df = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>").withColumn("one", F.lit("clash"))
    got = multi_index.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 50].sort_values("rank").vec_id.tolist() == [0, 1, 2, 3, 4] and set(got.query_id) == {0, 50}
    few = multi_index.nearest(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).toPandas()
    assert few.sort_values("rank").vec_id.tolist() == [1, 2]
    assert multi_index.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(1)
    d1, d2, count = rng.random(6), rng.random(6), rng.integers(0, 5, (6, 6))
    order = np.argsort((d1[:, None] + d2[None]).ravel(), kind="stable")
    for want in (1, 10, 40, count.sum()):
        got = multi_index.walk(d1, d2, count, want)
        need, cells = 0, set()
        for c in order:
            if need >= want:
                break
            need += count.ravel()[c]
            cells |= {(c // 6, c % 6)} if count.ravel()[c] else set()
        assert {(i, j) for i, bits in got.items() for j in range(6) if bits >> j & 1} == cells


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(5)
    texts = [f"{'bad ' * (i % 2)}{'junk ' * (i % 3 == 0)}" + " ".join(f"w{x}" for x in rng.integers(0, 50, 12)) for i in range(600)]
    y = np.array([[i % 3 == 0, i % 2 == 1 and i % 3 != 0] for i in range(600)]).astype(int)  # the second depends on the first
    chain = toxicity.Chain.fit(texts, y, ["junk", "toxic"])
    p = chain.predict(texts)
    assert ((p[:, 1] >= chain.thresholds[1]) == y[:, 1]).mean() > 0.97
    assert len(chain.models[1].dense) == 1 and chain.models[1].dense[0] < 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    c = toxicity.label_categories()
    chain = toxicity.Chain.fit(*toxicity.training_rows(docs, train, c), list(c))
    got = toxicity.score_toxicity(docs.join(held.select("doc_id"), "doc_id", "left_semi"), chain).join(held, "doc_id").toPandas()
    toxic = got.toxic == 1
    assert got[toxic].is_toxic.mean() > 0.88 and got[~toxic].is_toxic.mean() < 0.02


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    c = toxicity.label_categories()
    chain = toxicity.Chain.fit(*toxicity.training_rows(odd, labels, c), list(c))
    assert toxicity.score_toxicity(odd, chain).count() == odd.count()
    empty = toxicity.Chain.fit(*toxicity.training_rows(none, labels.limit(0), c), list(c))
    assert toxicity.score_toxicity(odd, empty).filter("p_toxic BETWEEN 0 AND 1").count() == odd.count()


def test_letters_of_large_alphabets_are_told_apart():
    rng = np.random.default_rng(3)
    one, two = (["".join(chr(0x4E00 + base + x) for x in rng.integers(0, 600, 300)) for _ in range(12)] for base in (0, 600))
    p = langid.CrossParser.fit([("one", t) for t in one[:8]] + [("two", t) for t in two[:8]])
    used = {c for t in one[:8] + two[:8] for c in t}
    assert len(used) > 1_000 and len({tuple(langid.codes_of(c, p.code)) for c in used}) == len(used)
    bits, _ = p.entropies(one[8:] + two[8:])
    assert [p.langs[k] for k in bits.argmin(axis=1)] == ["one"] * 4 + ["two"] * 4


def test_out_of_fold_column_equals_a_plain_loop(monkeypatch):
    """What the second model was fitted with is, row by row, what a model that hasn't seen the row's fold says."""
    rng = np.random.default_rng(6)
    texts = [f"{'junk ' * (i % 3 == 0)}" + " ".join(f"w{x}" for x in rng.integers(0, 20, 8)) for i in range(90)]
    y = np.array([[i % 3 == 0, i % 2] for i in range(90)]).astype(int)
    seen, fit = [], toxicity.Linear.fit.__func__
    monkeypatch.setattr(toxicity.Linear, "fit", classmethod(lambda cls, rows, width, dense, z, **k: seen.append((len(rows), dense.copy())) or fit(cls, rows, width, dense, z, **k)))
    chain = toxicity.Chain.fit(texts, y, ["junk", "toxic"], folds=3)
    monkeypatch.undo()
    dense = next(d for n, d in reversed(seen) if n == 90 and d.shape[1] == 1)
    rows = [chain.features(toxicity.words_of(t)) for t in texts]
    for i in range(90):
        others = [j for j in range(90) if j % 3 != i % 3]
        model = toxicity.Linear.fit([rows[j] for j in others], len(chain.vocabulary), np.zeros((60, 0)), y[others, 0].astype(float))
        score = model.bias + sum(model.weights[f] for f in rows[i])
        assert abs(dense[i, 0] - 1 / (1 + np.exp(-score))) < 1e-9


def test_conflicting_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(1, "a second text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    texts, y = toxicity.training_rows(docs, labels, toxicity.label_categories())
    assert sorted(zip(texts, map(tuple, y.tolist()), strict=True)) == [("a second text", (1, 1)), ("text 0", (0, 0)), ("text 3", (0, 0))]
