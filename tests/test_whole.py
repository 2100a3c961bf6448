"""Queries over rows that a part of the table, or of a text, doesn't show."""

from quillon.plans import catalog


def test_bfs_takes_every_edge(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = [(1, 10, 1), (1, 2000, 2), (2, 2000, 3), (3, 3000, 1)]  # 2000 is reached over lines beyond the first only
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    got = {r.node: r.level for r in catalog.QUERIES["citation_bfs"](spark, d).collect()}
    assert got == {-1: 0, 10: 1, 2000: 1, -2: 2}


def test_ids_of_whole_texts(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = [(7, "word " * 30 + "as in 1412.6980v9, where"), (8, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r.ids for r in catalog.QUERIES["arxiv_id_extract"](spark, d).collect()}
    assert got == {7: ["1412.6980", "1706.3762", "2101.00001", "2101.00007"], 8: ["1706.3762", "2101.00001", "2101.00008"]}


def test_long_abstracts_by_their_whole_text(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = [(60, "x" * 51), (61, "x" * 50), (62, " " + "x\n" * 500), (63, " " * 60), (64, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r.n for r in catalog.QUERIES["abstract_filter"](spark, d).collect()}
    assert got == {60: 51, 62: 999}
