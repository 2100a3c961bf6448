"""Collections kept page by page: what is read is what was written, and no more pages than needed."""

import pytest
from pyspark.sql import functions as F

from quillon.sources import paged

SCHEMA = "id long, name string, vector array<double>"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pages')}/c"
    rows = spark.range(1_000).select((F.col("id") * 3).alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vector"))
    assert paged.write_pages(rows.repartition(5), path, 64) == 16
    paged.register(spark)
    return path, rows


def load(spark, path, schema=SCHEMA, **options):
    return spark.read.format(paged.FORMAT).schema(schema).options(**options).load(path)


def test_same_rows(spark, pages):
    path, rows = pages
    got = load(spark, path, pages=3)
    assert got.rdd.getNumPartitions() == 6
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    assert load(spark, path, "name string").agg(F.count_distinct("name")).first()[0] == 1_000


@pytest.mark.parametrize(("condition", "n"), [("id = 300", 1), ("id = 301", 0), ("id > 2000 AND id <= 2100", 34), ("id IN (3, 2997)", 2), ("id < 0", 0), ("id >= 2990 AND name <> 'n999'", 2), ("name = 'n7'", 1)])
def test_filters(spark, pages, condition, n):
    assert load(spark, pages[0]).filter(condition).count() == n


def test_filters_leave_out_pages(pages):
    reader = paged.PagedReader(paged.local(pages[0]), ["id"], 1)
    from pyspark.sql.datasource import GreaterThan, LessThan, StringContains

    other = StringContains(("name",), "n")
    assert list(reader.pushFilters([GreaterThan(("id",), 190), LessThan(("id",), 400), other])) == [other]
    assert [p.cursors for p in reader.partitions()] == [[1], [2]]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(i,) for i in range(192, 400, 3)]


def test_a_stream_goes_on_without_repeating(spark, tmp_path):
    path, to, check = (f"file://{tmp_path}/{x}" for x in ("c", "out", "check"))
    paged.register(spark)
    at = 0
    for k in range(3):
        rows = spark.range(k * 100, k * 100 + 100 - k).select("id", F.lit("x").alias("name"), F.array(F.lit(1.0)).alias("vector"))
        at = paged.write_pages(rows, path, 32, start=at)
        stream = spark.readStream.format(paged.FORMAT).schema("id long").load(path)
        q = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        got = [r.id for r in spark.read.schema("id long").parquet(to).collect()]
        assert sorted(got) == [i for j in range(k + 1) for i in range(j * 100, j * 100 + 100 - j)]


def test_no_pages_and_other_stores(spark, tmp_path):
    paged.register(spark)
    assert load(spark, f"file://{tmp_path}/none").count() == 0
    assert paged.write_pages(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e") == 0
    with pytest.raises(ValueError):
        paged.local("s3://bucket/x")
