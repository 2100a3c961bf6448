"""Mixing overlapping sources to target weights by min-cost flow.

Documents that belong to the same sources are alike to the mix, so they are added up by that membership pattern. A flow sends each pattern's words to
its sources' quotas; a pattern gives its words once, then again at a higher cost for every repetition, so repetitions come last and
are spread no further than needed. Patterns and sources are few and pass through the driver; which documents are taken, and how often, is then
decided in the DataFrame, by a seeded order within each pattern.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, settle, table

#: Weights of sources by code point, repeating; the mix's size in hundredths of all words; times that a document may be taken.
WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 150, 2
#: Patterns that the driver plans for at most; beyond that an error says so, and nothing is left out.
MAX_PATTERNS = 200_000


@dataclass
class Plan:
    """sources: (name, words it has, target, words routed to it) by code point, null last. routes: for each pattern the (source's number, words) it
    gives, in order."""

    sources: list[tuple[str | None, int, float, int]]
    routes: dict[tuple[str | None, ...], list[tuple[int, int]]]


def targets_of(sizes: Sequence[int], weights: Sequence[float], total: float, most: int = REPEATS) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its source's size; what is cut off is shared by the others, again by weight."""
    full, left = set(), list(range(len(sizes)))
    level = 0.0
    while left:
        level = max(0.0, total - most * sum(sizes[i] for i in full)) / sum(weights[i] for i in left)
        above = [i for i in left if level * weights[i] > most * sizes[i]]
        if not above:
            break
        full.update(above)
        left = [i for i in left if i not in full]
    return [float(most * sizes[i]) if i in full else level * weights[i] for i in range(len(sizes))]


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that each pattern gives each of its sources, at least cost among those that fill the quotas as far as can be.

    The n-th repetition of any pattern's words costs more than the one before and the same for all patterns, so cheapest paths first means
    one repetition after another: each adds ``capacity`` to the patterns, and shortest augmenting paths, which may take back what was sent, use it
    before the next is opened.
    """
    sent: list[dict[int, int]] = [{} for _ in capacity]
    holders: list[set[int]] = [set() for _ in quotas]  # patterns that give to a source
    open_, left = list(quotas), [0] * len(capacity)
    for _ in range(repeats):
        left = [n + c for n, c in zip(left, capacity, strict=True)]
        for p in range(len(capacity)):
            while left[p] > 0 and (path := _path(p, members, sent, holders, open_)):
                # pattern, source, pattern, …, source: given along, taken back in between
                gives, takes = list(zip(path[::2], path[1::2], strict=True)), list(zip(path[2::2], path[1:-1:2], strict=True))
                n = min(left[p], open_[path[-1]], *[sent[q][s] for q, s in takes])
                for q, s in gives:
                    sent[q][s] = sent[q].get(s, 0) + n
                    holders[s].add(q)
                for q, s in takes:
                    sent[q][s] -= n
                    if not sent[q][s]:
                        holders[s].discard(q)
                left[p] -= n
                open_[path[-1]] -= n
    return [{s: n for s, n in x.items() if n} for x in sent]


def _path(start: int, members: Sequence[Sequence[int]], sent: list[dict[int, int]], holders: list[set[int]], open_: list[int]) -> list[int] | None:
    """The shortest way from a pattern to a source with room: pattern, source, pattern, …, source."""
    came: dict[int, tuple[int, int] | None] = {start: None}  # pattern -> (pattern before, source between)
    seen, queue = set(), deque([start])
    while queue:
        p = queue.popleft()
        for s in members[p]:
            if s in seen:
                continue
            seen.add(s)
            if open_[s] > 0:
                path, at = [s, p], p
                while came[at] is not None:
                    at, between = came[at]
                    path += [between, at]
                return path[::-1]
            for q in holders[s]:
                if q not in came:
                    came[q] = (p, s)
                    queue.append(q)
    return None


def by_code_point(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda s: (s is None, s or ""))


def plan_mix(patterns: Sequence[tuple[tuple[str | None, ...], int]], weights: Sequence[float] | dict[str | None, float] = WEIGHTS, share: int = SHARE, repeats: int = REPEATS) -> Plan:
    """patterns: (sources, words) of each membership pattern. weights: by source, or a row that repeats over the sources in order of code point.
    share: hundredths of all words that the mix has."""
    names = by_code_point({s for p, _ in patterns for s in p})
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for p, n in patterns:
        for s in p:
            sizes[number[s]] += n
    own = [weights[s] if isinstance(weights, dict) else weights[i % len(weights)] for i, s in enumerate(names)]
    targets = targets_of(sizes, own, sum(n for p, n in patterns if p) * share / 100, repeats)
    sent = route([n for _, n in patterns], [[number[s] for s in p] for p, _ in patterns], [int(t) for t in targets], repeats)
    routed = [0] * len(names)
    for x in sent:
        for s, n in x.items():
            routed[s] += n
    return Plan(list(zip(names, sizes, targets, routed, strict=True)), {p: sorted(x.items()) for (p, _), x in zip(patterns, sent, strict=True)})


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS[1:]}+")).cast("long")


def mix(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | dict[str | None, float] = WEIGHTS, share: int = SHARE, repeats: int = REPEATS, seed: int = 0,
) -> tuple[DataFrame, Plan]:
    """One row per input row (doc_id, size, pattern, taken, routed), and the plan.

    sources: array<string>, the sources of a document, of which null may be one; repeats and order don't count. size: its words (null text: 0).
    taken: words that the mix takes of it, at most ``repeats`` times its size; routed: (source, words) of these, by the source that they count for. The
    words of a pattern lie in a seeded order of its documents (a hash of seed, id and text; ties by id and size), once for each repetition;
    the flow's routes are intervals of it in a row, so each source gets exactly its words, and at most one document at each end of a route
    is taken in part, from its beginning.

    Documents without a source take no part: nothing of them is taken. Repeated rows each count, null ids stay, texts of any length are counted whole,
    other columns are ignored, runs agree. An empty table gives an empty result. Only the documents of a pattern whose hash shares its
    first three digits with a route's end meet in one task, one of 4,096 parts of the pattern.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text))
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    rows = settle(docs.select(F.col(f"`{id_col}`").alias("doc_id"), word_count(F.col(f"`{text_col}`")).alias("size"), pattern.alias("pattern"), key.alias("key")), "mix-rows")
    rows = rows.withColumn("part", F.left("key", F.lit(3)))

    filled = settle(rows.groupBy("pattern", "part").agg(F.sum("size").alias("words")), "mix-parts")
    sums = filled.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted(((tuple(r.pattern), r.words) for r in sums), key=lambda x: ([(s is None, s or "") for s in x[0]], x[1]))
    plan = plan_mix(patterns, weights, share, repeats)

    # the routes of each pattern as intervals of its repeated line of words
    made = []
    for p, words in patterns:
        at, own = 0, []
        for s, n in plan.routes[p]:
            own.append((plan.sources[s][0], at, at + n))
            at += n
        made.append((list(p), words, own))
    routes = F.broadcast(spark.createDataFrame(made, "p array<string>, line long, routes array<struct<source:string,low:long,high:long>>"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("part")) - F.col("words")
    # a part whose middle holds an end of a route needs its documents' places; elsewhere the part's start does for all of them
    inside = F.exists(F.col("routes"), lambda r: (r["high"] % F.col("line") > F.col("start")) & (r["high"] % F.col("line") < F.col("start") + F.col("words")))
    parts = filled.withColumn("start", before).join(routes, F.col("pattern") == F.col("p")).select("pattern", "part", "start", (inside & (F.col("line") > 0)).alias("cut"))
    placed = rows.join(settle(parts, "mix-places"), ["pattern", "part"])
    order = Window.partitionBy("pattern", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    exact = placed.filter("cut").withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.filter("NOT cut").withColumn("at", F.col("start")).unionByName(exact)

    def share_of(r: Column) -> Column:
        times = [F.greatest(F.lit(0).cast("long"), F.least(r["high"], F.col("at") + F.col("size") + n * F.col("line")) - F.greatest(r["low"], F.col("at") + n * F.col("line"))) for n in range(repeats)]
        return F.struct(r["source"].alias("source"), sum(times[1:], times[0]).alias("words"))

    routed = F.filter(F.transform("routes", share_of), lambda r: r["words"] > 0)
    out = placed.join(routes, F.col("pattern") == F.col("p")).withColumn("routed", routed)
    taken = F.aggregate("routed", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    return out.select("doc_id", "size", "pattern", taken.alias("taken"), "routed"), plan


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to one and a half times their words; sources by code point (null last) weigh 5, 2, 1 and so on. Odd rows as in mix."""
    docs = table(spark, sf_dir, "documents")
    rows, plan = mix(docs, F.array("source"))
    told = F.broadcast(spark.createDataFrame([(s, n, round(t, 6)) for s, n, t, _ in plan.sources], "source string, source_size long, target double"))
    source = F.element_at("pattern", 1)
    return rows.join(told, source.eqNullSafe(F.col("source")), "left").select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM d GROUP BY source),
o AS (SELECT *, sum({REPEATS} * n) OVER u AS capped, sum(w) OVER u AS w_capped, row_number() OVER u AS k FROM s WINDOW u AS (ORDER BY {REPEATS} * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
a AS (SELECT sum(n) * {SHARE} / 100 AS total, sum(w) AS w FROM s),
l AS (SELECT o.*, (total - (capped - {REPEATS} * n)) / (a.w - (w_capped - o.w)) AS level FROM o, a),
f AS (SELECT min(k) AS k FROM l WHERE level * w <= {REPEATS} * n),
t AS (SELECT source, n, CASE WHEN l.k < coalesce(f.k, 1e9) THEN ({REPEATS} * n)::DOUBLE ELSE w * (SELECT level FROM l x, f WHERE x.k = f.k) END AS target FROM l, f),
b AS (SELECT d.*, n, target, floor(target)::BIGINT AS words, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target, (greatest(0, least(words, place + size) - place) + greatest(0, least(words, place + size + n) - (place + n)))::BIGINT AS taken FROM b
"""
