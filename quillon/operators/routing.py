"""Routers: queries to collections by weighted patterns, papers to a collection by category."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import active_importable
from .routing_tables import CATCH_ALL, CATEGORIES, KEYWORDS


def keyword_table(spark, rows=None) -> DataFrame:
    """pattern, ordinal, collection, weight, pair_ordinal: a small table by nature, but any relation of that form will do."""
    return spark.createDataFrame(rows or KEYWORDS, "pattern string, ordinal int, collection string, weight double, pair_ordinal int")


def literal_factor(pattern: str) -> str:
    """The longest literal that every match of the regex contains; empty if none is plain to see."""
    if re.search(r"[|()\[\]{}\\]", pattern):
        return ""
    runs = re.split(r"\0", re.sub(r".[?*]|[.^$+]", "\0", pattern))
    return max(runs, key=len)


class Patterns:
    """One automaton over literal factors of all patterns: a text is read once, and only patterns whose factor it has are searched for."""

    def __init__(self, rows: Sequence[tuple], most: int, share: float, word_bounds: bool):
        self.most, self.share = most, share
        self.pairs: dict[str, list[tuple[str, float, int]]] = {}
        for pattern, ordinal, collection, weight, pair in rows:
            self.pairs.setdefault(pattern, []).append((collection, float(weight), ordinal * 1000 + pair))
        self.regex, self.always = {}, []
        self.factors: dict[str, list[str]] = {}
        for p in self.pairs:
            factor = literal_factor(p)
            if word_bounds or factor != p:
                self.regex[p] = re.compile(rf"\b(?:{p})\b" if word_bounds else p)
            (self.factors.setdefault(factor, []) if factor else self.always).append(p)

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for factor, patterns in self.factors.items():
            made.add_word(factor, patterns)
        if self.factors:
            made.make_automaton()
        return made

    def route(self, text: str, automaton) -> list[tuple[str, float, int]]:
        """(collection, score, rank) of a lower-cased text."""
        some = {id(v): v for _, v in automaton.iter(text)}.values() if self.factors else ()
        found = [p for p in [*self.always, *(p for v in some for p in v)] if p not in self.regex or self.regex[p].search(text)]
        score: dict[str, float] = {}
        place: dict[str, int] = {}
        for collection, weight, at in sorted((x for p in found for x in self.pairs[p]), key=lambda x: x[2]):
            score[collection] = score.get(collection, 0.0) + weight
            place.setdefault(collection, at)
        if not score:
            return [(CATCH_ALL, 0.0, 1)]
        least = self.share * max(score.values())
        ranked = sorted((c for c in score if score[c] >= least), key=lambda c: (-score[c], place[c]))
        return [(c, score[c], k) for k, c in enumerate(ranked[: self.most], 1)]


def route_queries(queries: DataFrame, keywords: list[tuple] | None = None, id_col: str = "query_id", text_col: str = "query", most: int = 3, share: float = 0.5, word_bounds: bool = False) -> DataFrame:
    """query_id, collection, score, rank: patterns found anywhere in the lower-cased query (``word_bounds``: as whole words), weights summed by
    collection, those with ``share`` of the best score at least, ``most`` of them; ties go to the one met first. No
    match, or a blank query: the catch-all with score 0. Repeated queries are routed each on its own.

    The rule set is of bounded size and goes to all tasks; a query is scored where it is read, so nothing is shuffled.
    """
    active_importable()
    rules = Patterns(keywords or KEYWORDS, most, share, word_bounds)

    @F.pandas_udf("array<struct<collection:string,score:double,rank:int>>")
    def routes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = rules.automaton()
        for texts in parts:
            yield pd.Series([[{"collection": c, "score": s, "rank": k} for c, s, k in rules.route(t, automaton)] for t in texts])

    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    each = queries.select(F.col(id_col).alias("query_id"), F.explode(routes(lowered)).alias("r"))
    return each.select("query_id", "r.collection", "r.score", "r.rank")


def route_papers(papers: DataFrame, categories: dict[str, str] | None = None, id_col: str = "paper_id", cat_col: str = "categories") -> DataFrame:
    """paper_id, collection: the first category, in order, that the table has as it is or up to its first dot; else the catch-all."""
    table = categories or CATEGORIES
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    codes = F.filter(F.split(F.lower(F.coalesce(F.col(cat_col), F.lit(""))), r"\s+"), lambda c: c != "")
    named = F.transform(codes, lambda c: F.coalesce(F.try_element_at(pairs, c), F.try_element_at(pairs, F.split_part(c, F.lit("."), F.lit(1)))))
    return papers.select(F.col(id_col).alias("paper_id"), F.coalesce(F.try_element_at(F.filter(named, lambda x: x.isNotNull()), F.lit(1)), F.lit(CATCH_ALL)).alias("collection"))
