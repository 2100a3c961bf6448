"""Subword tokens from a tokenizer file, for chunkers and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import active_importable

_kept: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _kept:
        from tokenizers import Tokenizer

        _kept[path] = Tokenizer.from_file(path)
    return _kept[path]


def bpe_pieces(path: str) -> Callable[[Column], Column]:
    """A column function for chunkers: the stretches of text that the tokens of a ``tokenizers`` file stand for, each with the white space
    before it, so that joined without a separator they give the text again. Tokens that stand for part of a character, or for nothing, add
    an empty stretch, so the number of pieces is the number of tokens. Null and empty texts have none."""
    active_importable()

    @F.pandas_udf("array<string>")
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for texts in parts:
            out = []
            for text in texts:
                ends = [e for _, e in tokenizer.encode(text or "", add_special_tokens=False).offsets]
                high = _running(ends)
                if high:
                    high[-1] = len(text)
                out.append([text[a:b] for a, b in zip([0, *high], high, strict=False)])
            yield pd.Series(out, dtype=object)

    return pieces


def _running(ends: list[int]) -> list[int]:
    out, top = [], 0
    for e in ends:
        top = max(top, e)
        out.append(top)
    return out


def bpe_count(path: str) -> Callable[[Column], Column]:
    """A column function: the number of tokens; 0 for null and empty texts."""
    active_importable()

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for texts in parts:
            yield pd.Series([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts], dtype="int32")

    return count
