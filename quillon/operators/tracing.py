"""Traces of requests as rows: spans of retrieval, reranking, web search and generation, events of cache hits, and a summary when a trace ends.

All have the columns trace_id, name, kind, at, input, output, of which the last two are JSON. Times are the caller's column, so that runs agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import spans

COLUMNS = ["trace_id", "name", "kind", "at", "input", "output"]
#: Ids, scores, titles, addresses and characters that a span keeps of what it saw.
IDS, SCORES, TITLES, TITLE_CHARS, ADDRESSES, ANSWER_CHARS = 5, 5, 3, 80, 3, 500


def _row(df: DataFrame, name: str, kind: str, asked: Column, got: Column, at: str = "at") -> DataFrame:
    return df.select(F.col("trace_id"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(at).alias("at"), F.to_json(asked).alias("input"), F.to_json(got).alias("output"))


def _first(value: Column, rank: Column, most: int) -> Column:
    """The first values of a group in order of rank; null values stay, others than the first ``most`` never leave their task."""
    kept = F.collect_list(F.when(rank <= most, F.struct(rank.alias("rank"), value.alias("value"))))
    return F.transform(F.array_sort(kept), lambda x: x["value"])


def retrieval(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """requests: trace_id, query, collections, at; hits: trace_id, id, collection, rank. A request without hits has a span too."""
    seen = spans(requests, hits, "trace_id", most=IDS)
    asked = F.struct("query", "collections", F.size(F.coalesce("collections", F.array().cast("array<string>"))).alias("num_collections"))
    return _row(requests.select("trace_id", "query", "collections", "at").join(seen.drop("name"), "trace_id"), "retrieval", "span", asked, F.struct("num_candidates", "top_ids", "collections_searched"))


def reranking(requests: DataFrame, reranked: DataFrame, candidates: str = "num_candidates") -> DataFrame:
    """requests: trace_id, num_candidates, at; reranked: trace_id, rank, score, title."""
    seen = reranked.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n"), _first(F.round(F.coalesce("score", F.lit(0.0)), 4), F.col("rank"), SCORES).alias("scores"), _first(F.left(F.coalesce("title", F.lit("")), F.lit(TITLE_CHARS)), F.col("rank"), TITLES).alias("titles")
    )
    got = F.struct(F.coalesce("n", F.lit(0)).alias("num_reranked"), F.coalesce("scores", F.array().cast("array<double>")).alias("top_scores"), F.coalesce("titles", F.array().cast("array<string>")).alias("top_titles"))
    return _row(requests.join(seen, "trace_id", "left"), "reranking", "span", F.struct(F.coalesce(candidates, F.lit(0)).alias("num_candidates")), got)


def web_search(requests: DataFrame, results: DataFrame) -> DataFrame:
    """requests: trace_id, query, at; results: trace_id, rank, url."""
    seen = results.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), _first(F.coalesce("url", F.lit("")), F.col("rank"), ADDRESSES).alias("urls"))
    got = F.struct(F.coalesce("n", F.lit(0)).alias("num_results"), F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))
    return _row(requests.join(seen, "trace_id", "left"), "web_search", "span", F.struct("query"), got)


def generation(answers: DataFrame) -> DataFrame:
    """answers: trace_id, query, context, response, model, prompt_tokens, completion_tokens, at. Token counts that aren't known stay out."""
    asked = F.struct(F.col("model"), F.col("query"), F.length("context").alias("context_length"))
    got = F.struct(F.left("response", F.lit(ANSWER_CHARS)).alias("response"), F.col("prompt_tokens"), F.col("completion_tokens"))
    return _row(answers, "generation", "generation", asked, got)


def cache_hits(hits: DataFrame) -> DataFrame:
    """hits: trace_id, key, at."""
    return _row(hits, "cache_hit", "event", F.struct("key"), F.struct(F.lit(True).alias("cached")))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(log: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """trace_id, num_spans (events aside), events, began, ended, tokens (of generations, unknown ones 0), success, error (the least of several; failures: trace_id,
    error)."""
    number = lambda p: F.coalesce(F.get_json_object("output", p).cast("long"), F.lit(0))
    made = log.groupBy("trace_id").agg(
        F.count_if(F.col("kind") != "event").alias("num_spans"), F.count_if(F.col("kind") == "event").alias("events"), F.min("at").alias("began"), F.max("at").alias("ended"),
        F.sum(F.when(F.col("kind") == "generation", number("$.prompt_tokens") + number("$.completion_tokens")).otherwise(0)).alias("tokens"),
    )
    if failures is None:
        return made.withColumn("success", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    errors = failures.groupBy("trace_id").agg(F.min(F.coalesce("error", F.lit(""))).alias("error"))
    return made.join(errors, "trace_id", "left").withColumn("success", F.col("error").isNull()).select(*made.columns, "success", "error")


def write(log: DataFrame, path: str | None) -> None:
    """Append spans to a log, a folder for each day; nothing happens where no log is set up."""
    if path:
        log.select(*COLUMNS).withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def quantile_sketches(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, sketch: what is needed to tell quantiles of the values, in a few kilobytes however many there are; sketches merge."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))


def merged_quantile(sketches: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, n, quantile: of sketches (of days, say) of one key."""
    one = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("s"))
    return one.select(*by, F.kll_sketch_get_n_double("s").alias("n"), F.kll_sketch_get_quantile_double("s", F.lit(q)).alias("quantile"))
