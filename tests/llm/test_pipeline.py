import duckdb
import pytest

import corpus_pipeline as cp
from pyspark.sql import functions as F
from quillon.llm import exact_dedup, lattice_sampling, ngram_join, packing, queries, sharding
from quillon.llm.common import settle
from helpers import rows_of

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, D).toPandas()) == rows_of(c.sql(queries.ORACLE_SQL[name]).df())


CLASHES = {
    "keep_id group_size kept text_sha256": lambda df: exact_dedup.exact_dedup(df),
    "size text_crc32 law shard slot grown_shard": lambda df: sharding.shard(df, 3),
    "start length ids_crc32 doc_tokens sequence_id offset": lambda df: packing.pack_documents(df, packing.default_tokenizer()),
    "sample n_pieces ids_crc32 log_prob perturbed log_inclusion": lambda df: lattice_sampling.sample_segmentations(df, lattice_sampling.default_model()),
    "n_shingles component_id": lambda df: ngram_join.ngram_jaccard_join(df),
}


@pytest.mark.parametrize("names", list(CLASHES))
def test_clashing_names_change_nothing(spark, odd, names):
    """Input columns with the names of the output, of another type, in another case, and the operators' own helper names."""
    plain = odd.select("doc_id", "text")
    clash = plain
    for c in [*names.split(), "Digest", "content", "key", "salt", "rows", "pid", "tag", "n"]:
        clash = clash.withColumn(c.upper() if c in ("shard", "kept", "sample") else c, F.array(F.lit("x")))
    a, b = (CLASHES[names](df) for df in (plain, clash))
    assert a.columns == b.columns == ["doc_id", *names.split()]
    stable = [c for c in a.columns if c not in ("sequence_id", "offset", "slot")]
    assert rows_of(a.select(stable).toPandas()) == rows_of(b.select(stable).toPandas())


def test_repeated_ids_are_packed_and_redacted_each(spark):
    rows = [(1, "token=12345678abc"), (1, "token=12345678abc"), (1, "clean text"), (None, "clean text"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.redact_secrets(spark, docs, D)
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, ""), (-1, "clean text"), (1, "[REDACTED]"), (1, "[REDACTED]"), (1, "clean text")]
    packed = cp.pack(spark, got, D).toPandas()
    assert len(packed) == 5 and packed.sequence_id.nunique() == 1 and packed.doc_id.isna().sum() == 2


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_stages_take_odd_rows(spark, odd):
    docs, seen = odd, []
    for name, stage in cp.STAGES:
        docs = settle(stage(spark, docs, D), name)
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
    assert seen[0] == 6  # null, empty and letterless texts went: 1, 2 twice, one without an id, 7 and 10
    assert seen[1] == 4 and seen[2] == 4 and seen[3] == 4
    assert {r.doc_id for r in docs.collect()} == {1, 7, 10, None}


def test_stages_take_an_empty_table(spark, none):
    docs = none
    for name, stage in cp.STAGES:
        docs = settle(stage(spark, docs, D), name)
    assert docs.count() == 0


def test_decisions_take_effect(spark):
    base = " ".join(f"word{'abcdefgh'[i % 8]}{'abcdefghij'[i % 10]}{'abcdefg'[i % 7]}" for i in range(200))
    near = base.replace("wordaaa", "other", 1)
    rows = [(1, base), (2, base + " "), (3, near), (4, "a clean text of its own with token=12345678abc in it"), (5, "%%%"), (6, "another clean text that stays")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in cp.STAGES[:4]:
        docs = settle(stage(spark, docs, D), name)
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[0] == [1, 2, 3, 4, 6]
    assert 1 in kept[2] and 3 not in kept[2] and {4, 6} <= set(kept[2])
    four = docs.filter("doc_id = 4").first()
    assert four.text == "a clean text of its own with [REDACTED] in it" and four.n_chars == len(four.text)


def test_whole_run(spark):
    got = cp.run(spark, D)
    assert got.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).filter("doc_tokens <> `sum(length)`").count() == 0


def test_a_repeated_id_saves_no_copy(spark):
    x = " ".join(f"word{i}" for i in range(300))
    rows = [(0, x), (1, x.replace("word7 ", "other ")), (1, "a text of its own, which stays in any case"), (None, x.replace("word9 ", "else ")), (None, "no id, yet a clean text that stays too")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.text[:9], r.doc_id) for r in cp.drop_near_copies(spark, docs, D).collect()) == [("a text of", 1), ("no id, ye", None), ("word0 wor", 0)]
    twice = docs.unionByName(docs)
    assert cp.drop_near_copies(spark, cp.drop_copies(spark, twice, D), D).count() == 3


def test_private_keys_go_whole(spark):
    body = "\n".join(["MIIEowIBAAKCAQEA" + "abcDEF012+/" * 4] * 20)
    cut = f"-----BEGIN RSA PRIVATE KEY-----\n{body}"
    docs = spark.createDataFrame([(1, f"see\n{cut}\n-----END RSA PRIVATE KEY-----\nafter it"), (2, f"see {cut}\n"), (3, "no key here")], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    got = {r.doc_id: r.text for r in cp.redact_secrets(spark, docs, D).collect()}
    assert got == {1: "see\n[REDACTED]\nafter it", 2: "see [REDACTED]", 3: "no key here"}
