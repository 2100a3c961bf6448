import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import vector_codes as vc


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, vector) -> id, label, code, error, label_error by plain loops."""
    rows = [(i, lab, [[int(np.floor(1024.0 * x)) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)]) for i, lab, v in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[r[2][p] for r in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = {}
            for r in rows:
                got.setdefault(near(p, r[2][p])[1], []).append(r[2][p])
            new.append([[sum(c) // len(c) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])])
        books = new
    out = [(i, lab, [near(p, x[p]) for p in range(parts)]) for i, lab, x in rows]
    errors = {}
    for _, lab, n in out:
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in n)
    return sorted([(i, lab, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), errors[lab]) for i, lab, n in out], key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 7 == 0 else i % 3, [float(x) for x in np.round(rng.normal(size=8), 3)]) for i in range(60)]
    rows += [(3, 1, rows[3][2]), (None, 2, rows[9][2]), (None, 2, rows[9][2])]  # repeated rows, null ids
    return rows


def frame(spark, rows):
    made = [(i, lab, v, "x", "y") for i, lab, v in rows]
    return spark.createDataFrame(made, "vec_id long, label int, embedding array<double>, Code string, error string")


@pytest.mark.parametrize("entries", [4, 256])
def test_same_as_brute_force(spark, vectors, entries):
    odd = [(900, 1, None), (901, 1, []), (902, 1, [None] * 8), (903, 1, [float("nan")] * 8), (904, 1, [float("inf")] * 8), (905, 1, [1.0] * 12), (906, 1, [1.0] * 7), (907, 1, [1e300] * 8)]
    got = vc.compress(frame(spark, vectors + odd).repartition(5), entries=entries)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute(vectors, entries=entries)


def test_ties_go_to_the_first_entry_and_unused_ones_stay(spark):
    rows = [(i, 0, [1.0] * 4) for i in range(3)] + [(3, 0, [3.0] * 4)]
    books = vc.fit_codebooks(frame(spark, rows), entries=4)
    assert books.entries[0].ravel().tolist() == [1024, 1024, 1024, 3072]
    assert [r.code for r in vc.encode(frame(spark, rows), books).orderBy("vec_id").collect()] == ["00000000"] * 3 + ["03030303"]


def test_floors_go_down(spark):
    rows = [(0, 0, [-0.5 / 1024] * 4), (1, 0, [-1.5 / 1024] * 4), (2, 0, [-1.5 / 1024] * 4)]
    assert vc.fit_codebooks(frame(spark, rows), entries=1, rounds=1).entries.ravel().tolist() == [-2] * 4  # (-1 - 2 - 2) / 3


def test_decoded_vectors_are_as_far_as_the_error_says(spark, vectors):
    df = frame(spark, vectors)
    books = vc.fit_codebooks(df, entries=8)
    coded = vc.encode(df, books, keep=("vec_id", "embedding"))
    for r in vc.decode(coded, books).collect():
        steps = np.floor(np.array(r.embedding) * 1024) - (np.array(r.vector) * 1024 - 0.5)
        assert int((steps**2).sum()) == r.error
    bad = spark.createDataFrame([(None, 1), ("zz", 1), ("ffffffff", 1)], "code string, Vector int")
    assert [r.vector for r in vc.decode(bad, books).collect()] == [None] * 3


def test_large_integers_are_exact(spark):
    rows = [(i, 0, [100_000.0 + i / 1024] * 64) for i in range(5)]
    got = vc.compress(frame(spark, rows), entries=1, rounds=0).orderBy("vec_id").collect()
    assert [r.error for r in got] == [64 * i * i for i in range(5)]


def test_empty(spark, vectors):
    assert vc.compress(frame(spark, vectors).limit(0)).collect() == []
    assert vc.compress(frame(spark, vectors).withColumn("embedding", F.lit(None).cast("array<double>"))).collect() == []
    books = vc.fit_codebooks(frame(spark, vectors), entries=2)
    assert vc.encode(frame(spark, [(1, 1, [1.0] * 4)]), books).collect() == []  # of another length than the codebooks
