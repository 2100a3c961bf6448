import pytest
from pyspark.sql import functions as F

from quillon.functions import models
from quillon.operators import crawl


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    assert models.with_retry(call, sleep=waits.append) == "up" and waits == [0.5, 1.0]
    with pytest.raises(OSError, match="down"):
        models.with_retry(lambda: (_ for _ in ()).throw(OSError("down")), tries=2, sleep=waits.append)


def test_encoders(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    rows = df.select(models.dense_encode(F.col("t"), 16).alias("d"), models.sparse_encode(F.col("t")).alias("s")).collect()
    assert abs(sum(x * x for x in rows[0].d) - 1) < 1e-6 and not any(rows[1].d) and not any(rows[2].d)
    assert rows[0].s.indices == sorted(rows[0].s.indices) and sorted(rows[0].s["values"]) == [1.0, pytest.approx(1.693147, abs=1e-6)]
    assert rows[2].s.indices == []


def test_cascade(spark):
    s = lambda n: F.array(F.struct(F.lit("h").alias("heading"), F.repeat(F.lit("x"), n).alias("text"), F.lit(1).alias("page_num")))
    got = spark.range(1).select(models.extraction_cascade([(s(10), 200), (s(600), 500)]).alias("a"), models.extraction_cascade([(s(10), 200)]).alias("b")).first()
    assert len(got.a[0].text) == 600 and got.b == []


def test_crawl(spark):
    page = lambda *hrefs: "<title>T - Docs</title><main><h1>H</h1>one two three</main>" + "".join(f'<a href="{h}">x</a>' for h in hrefs)
    pages = spark.createDataFrame([("https://h/d/a", page("b#x", "c.pdf", "/other")), ("https://h/d/b", page("../d/c", "/d/v1.2.3/z")), ("https://h/d/c", page("a"))], "url string, html string")
    assert {r.url: r.level for r in crawl.crawl(pages, "https://h/d/a").collect()} == {"https://h/d/a": 0, "https://h/d/b": 1, "https://h/d/c": 2}
    assert crawl.crawl(pages, "https://h/d/a", 1).count() == 2
    chunks = crawl.page_chunks(pages, pages.limit(1), 3, 1).collect()
    assert len(chunks) == 4 and {c.title for c in chunks} == {"T"} and {c.section for c in chunks} == {"H"}
