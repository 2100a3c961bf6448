"""Language ID by cross-parsing entropy.

One suffix automaton per language, over labelled text. A text is parsed from left to right into longest phrases that
occur in a language's text; few phrases mean that the language's text predicts it. Per language the phrases are
normalised to an entropy, phrases * log2(size of the labelled text) / characters, and the least entropy wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, make_importable, table

#: Bounds of the model: labelled documents a language, characters that these have together (beyond it no further document is taken; each is learned whole), and
#: languages, of which more are an error.
DOCS_PER_LANG, CHARS_PER_LANG, MAX_LANGS = 64, 32_000, 1_000
#: The parse starts afresh every so many symbols, so that a batch's texts advance side by side: one phrase more at most.
BLOCK = 512
#: Symbols of a byte: what is no letter, digits, and the letters that are frequent in the labelled texts. Other letters are spelt by SPELT digits of
#: their code point, so that all letters of all scripts are told apart.
SPACE, DIGITS, SPELT, FREQUENT, RARE = 0, 33, 4, 210, 255


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return follow


@dataclass
class CrossParser:
    """langs; code: symbol of each code point; local: each language's numbers of the symbols, as its text has few of them; moves: for (state,
    local number) the next state's row offset * 4 + phrases ended; starts: each language's first row offset; bits: log2 of each labelled
    text's size. Symbol ``end`` closes a block."""

    langs: list[str]
    code: np.ndarray
    local: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    end: int

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]]) -> CrossParser:
        """labelled: (lang, text) pairs; a language's whole texts are joined in the given order."""
        texts: dict[str, list[str]] = {}
        for lang, text in labelled:
            texts.setdefault(lang, []).append(text.lower())
        letters = _letters()
        code = np.where(letters, np.uint8(RARE), np.uint8(SPACE))
        counts: dict[str, int] = {}
        for parts in texts.values():
            for t in parts:
                for c in t:
                    counts[c] = counts.get(c, 0) + 1
        common = sorted((c for c in counts if letters[ord(c)]), key=lambda c: (-counts[c], c))[:FREQUENT]
        for k, c in enumerate(sorted(common)):
            code[ord(c)] = k + 1 + DIGITS
        end = len(common) + 1 + DIGITS
        rows, starts, bits, base = [], [], [], 0
        local = np.zeros((len(texts), 256), dtype=np.int32)  # number 0: a symbol that the language's text lacks
        for n, lang in enumerate(sorted(texts)):
            symbols = squeezed(np.concatenate([codes_of(t + " ", code) for t in texts[lang]]))[:-1].tolist()
            here = sorted(set(symbols))
            local[n, here], local[n, end], width = np.arange(1, len(here) + 1), len(here) + 1, len(here) + 2
            follow = suffix_automaton(local[n, symbols].tolist())
            first = np.full(width, base * 4 + 1, dtype=np.int64)
            for c, t in follow[0].items():
                first[c] = (base + t * width) * 4
            first[width - 1] = base * 4
            own = np.tile(first, (len(follow), 1))
            own[1:] += 1  # what doesn't continue the phrase ends it
            for s, to in enumerate(follow):
                for c, t in to.items():
                    own[s, c] = (base + t * width) * 4
            rows.append(own.ravel())
            starts.append(base)
            bits.append(np.log2(max(2, len(symbols))))
            base += own.size
        return cls(sorted(texts), code, local, np.concatenate(rows).astype(np.int32 if base < 2**29 else np.int64) if rows else np.zeros(0, np.int32), np.array(starts), np.array(bits), end)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol, texts x languages, and whether each text has a letter."""
        coded = [squeezed(codes_of(t.lower(), self.code)) for t in texts]
        sizes = np.array([len(c) for c in coded])
        lettered = np.array([bool((c != SPACE).any()) for c in coded], dtype=bool)
        blocks = -(-sizes // BLOCK)
        doc_of = np.repeat(np.arange(len(texts)), blocks)
        lanes = np.full((len(doc_of), BLOCK + 1), self.end, dtype=np.uint8)
        at = 0
        for c, n in zip(coded, blocks, strict=True):
            if n:
                whole = np.full(n * BLOCK, self.end, dtype=np.uint8)
                whole[: len(c)] = c
                lanes[at : at + n, :BLOCK] = whole.reshape(n, BLOCK)
                at += n
        phrases = np.zeros((len(self.langs), len(texts)))
        for low in range(0, len(doc_of), 4096):
            steps = np.ascontiguousarray(lanes[low : low + 4096].T)
            state = np.repeat(self.starts[:, None], steps.shape[1], axis=1).astype(self.moves.dtype)
            ended = np.zeros(state.shape, dtype=np.int32)
            for symbols in steps:
                state += self.local[:, symbols]
                state = self.moves.take(state)
                ended += (state & 3).astype(np.int32, copy=False)
                state >>= 2
            for k in range(len(self.langs)):
                phrases[k] += np.bincount(doc_of[low : low + 4096], weights=ended[k], minlength=len(texts))
        return (phrases * self.bits[:, None] / np.maximum(sizes, 1)).T, lettered


def codes_of(text: str, code: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = code[points]
    rare = np.flatnonzero(out == RARE)
    if not len(rare):
        return out
    out = np.repeat(out, np.where(out == RARE, SPELT, 1))
    at, left = rare + np.arange(len(rare)) * (SPELT - 1), points[rare]
    for k in range(SPELT):
        out[at + k] = left % DIGITS + 1
        left = left // DIGITS
    return out


def squeezed(codes: np.ndarray) -> np.ndarray:
    """Runs of non-letters become one."""
    if not len(codes):
        return codes
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    return codes[keep]


def bucket(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars: int = CHARS_PER_LANG) -> list[tuple[str, str]]:
    """The bounded labelled sample, whole texts of all languages: of each language documents outside the held-out fifth in order of a hash of the id, up to
    ``docs_per_lang`` of them and ``chars`` characters in all. Documents longer than that serve only a language that has no others, by the shortest one.
    More than MAX_LANGS languages are an error, as the driver fits each."""
    long_ = F.length(text_col) > chars
    order = Window.partitionBy("lang").orderBy("long", "size", F.xxhash64("id"), "id", "text")
    rows = (
        docs.filter((bucket(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), long_.alias("long"), F.when(long_, F.length(text_col)).alias("size"))
        .withColumn("k", F.row_number().over(order))
        .filter((F.col("k") <= docs_per_lang) & (~F.col("long") | (F.col("k") == 1)))
    )
    some = rows.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if some > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    out, used = [], {}
    for r in rows.orderBy("lang", "k").select("lang", "text").toLocalIterator():
        used[r.lang] = used.get(r.lang, 0) + len(r.text)
        if used[r.lang] <= chars or used[r.lang] == len(r.text):
            out.append((r.lang, r.text))
    return out


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to the rows; no shuffle.

    lang_pred: the language of least cross-parsing entropy (ties: the first in order), ``und`` for null texts, texts
    without a letter, or without any learned language. score: second least / (least + second least), so 0.5 to 1; 1 if
    only one language was learned; 0 for ``und``. Whole texts of any length are parsed. Rows are neither dropped nor merged, null ids and
    other columns stay; input columns of these names give way. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    make_importable(spark)
    shared = spark.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in parts:
            out = []
            for at in range(0, len(texts), 512):
                part = texts.iloc[at : at + 512]
                bits, lettered = model.entropies([t or "" for t in part])
                for b, has in zip(bits, lettered, strict=True):
                    if not has or not model.langs:
                        out.append(("und", 0.0))
                        continue
                    k = int(b.argmin())
                    rest = float(np.delete(b, k).min()) if len(b) > 1 else None
                    out.append((model.langs[k], 1.0 if rest is None else rest / (b[k] + rest)))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
        give_back()

    base = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "__p")]
    return docs.select(*base, predict(F.col(text_col)).alias("__p")).select(*base, F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fifth. Odd rows as in identify."""
    docs = table(spark, sf_dir, "documents")
    parser = CrossParser.fit(training_rows(docs))
    held = F.coalesce(bucket() == 0, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), parser).select("doc_id", held, "lang_pred", "score")
