"""Chunkers over white-space tokens: windows by sequence and slice, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words


def window_starts(n: Column, size: int, overlap: int, early_stop: bool = True) -> Column:
    """Starts of windows with stride max(1, size - overlap); with early_stop, none after the first that reaches the end."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")) if early_stop else F.floor((n - 1) / F.lit(step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def chunk_flat(docs: DataFrame, size: int = 512, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text", early_stop: bool = True, least: int = 1, keep: Sequence[str] = (), tokens_of: Callable[[Column], Column] = words, between: str = " ") -> DataFrame:
    """doc_id, further columns of ``keep``, chunk_idx, token_count, chunk_text. ``early_stop`` False and ``least`` 20 give the citation chunker: a tail
    window more, and windows under ``least`` tokens dropped without using up an index. ``tokens_of`` is any column function that
    gives an array of pieces of text (functions.tokens.bpe_pieces, say), which ``between`` joins again."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), *keep, tokens_of(F.col(text_col)).alias("w"))
    starts = F.filter(window_starts(F.size("w"), size, overlap, early_stop), lambda s: F.least(F.lit(size), F.size("w") - s) >= least)
    each = tokens.select("doc_id", *keep, "w", F.posexplode(starts).alias("chunk_idx", "s"))
    part = F.slice("w", F.col("s") + 1, F.lit(size))
    return each.select("doc_id", *keep, "chunk_idx", F.size(part).alias("token_count"), F.array_join(part, between).alias("chunk_text"))


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section_no, heading, body, page_num: a line that starts with # opens a section; empty bodies are dropped. A text is split
    where such lines begin, within its row: nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(text, r"\n(?=#)", -1)
    each = docs.select(F.col(id_col).alias("doc_id"), F.startswith(text, F.lit("#")).cast("int").alias("headed"), F.posexplode(parts).alias("at", "part"))
    each = each.withColumn("section_no", F.col("at") + F.col("headed"))  # 0 is what comes before the first heading
    line = F.when(F.col("section_no") > 0, F.substring_index("part", "\n", 1))
    heading = F.coalesce(strip(F.regexp_replace(line, "^#+", "")), F.lit(""))
    body = strip(F.when(line.isNull(), F.col("part")).otherwise(F.substr("part", F.length(line) + 1)))
    return each.select("doc_id", "section_no", heading.alias("heading"), body.alias("body"), F.lit(1).alias("page_num")).filter(F.col("body") != "")


def chunk_sections(sections: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """doc_id, chunk_idx, page_num, heading, token_count, chunk_text: a short section is one chunk, a long one windows; from its
    second on they begin with the heading. chunk_idx runs through the document."""
    s = sections.withColumn("w", words(F.col("body"))).filter(F.size("w") > 0)
    each = s.select("doc_id", "section_no", "page_num", "heading", "w", F.posexplode(window_starts(F.size("w"), size, overlap)).alias("sub", "s"))
    part = F.slice("w", F.col("s") + 1, F.lit(size))
    text = F.array_join(part, " ")
    text = F.when((F.col("sub") > 0) & (F.col("heading") != ""), F.concat("heading", F.lit("\n\n"), text)).otherwise(text)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "sub")) - 1
    return each.select("doc_id", index.alias("chunk_idx"), "page_num", "heading", F.size(part).alias("token_count"), text.alias("chunk_text"))
