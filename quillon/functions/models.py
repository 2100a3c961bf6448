"""Encoders and model calls as pluggable columns, with deterministic stand-ins; retries for calls that may fail."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import active_importable
from .text import words

T = TypeVar("T")


def with_retry(call: Callable[[], T], tries: int = 4, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; between failures it waits base, 2 base, 4 base … seconds, and the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(base * 2**k)
    raise ValueError("tries must be positive")


def hashed_vector(text: str | None, dim: int) -> list[float]:
    """Signed feature hashing of white-space tokens, of unit length; zeros without tokens."""
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype("float32").tolist()


def dense_encode(text: Column, dim: int = 1024, encoder: Callable[[str | None, int], list[float]] = hashed_vector) -> Column:
    """array<float>: any per-text encoder over Arrow batches; feature hashing by default."""
    active_importable()

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder(t, dim) for t in texts], dtype=object)

    return encode(text)


def sparse_encode(text: Column) -> Column:
    """struct<indices,values>: 1 + ln(tf) under the 32-bit hash of each token, in order of the index; empty without tokens. The tokens of
    a text are hashed in the plan and counted by one sort."""
    active_importable()

    @F.pandas_udf("indices array<long>, values array<double>")
    def count(hashes: pd.Series) -> pd.DataFrame:
        found = [np.unique(np.asarray(h, dtype=np.int64), return_counts=True) for h in hashes]
        return pd.DataFrame({"indices": [i for i, _ in found], "values": [1.0 + np.log(n) for _, n in found]})

    return count(F.transform(words(F.lower(text)), lambda w: F.crc32(w.cast("binary"))))


def extraction_cascade(tiers: list[tuple[Column, int]]) -> Column:
    """Sections (array<struct<heading,text,page_num>>) of the first tier whose text has its least number of characters; else empty.
    Tiers are columns, so a parser's UDF runs only where the ones before fell short."""
    chars = lambda c: F.aggregate(F.transform(c, lambda s: F.length(s["text"])), F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0)))
    empty = F.array().cast("array<struct<heading:string,text:string,page_num:int>>")
    return F.coalesce(*[F.when(F.coalesce(chars(c), F.lit(0)) >= least, c) for c, least in tiers], empty)
