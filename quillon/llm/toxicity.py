"""Toxicity by a classifier chain: linear models in a row, each fed with the probabilities of the earlier categories.

While a chain is trained, the earlier probabilities come from models that haven't seen the row (out-of-fold), so a
later model meets in training what it will meet in use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_importable, table

#: Bounds of the training sample: rows of each value of the last category; and of the vocabulary.
ROWS_PER_VALUE, VOCABULARY, FOLDS = 4_000, 4_096, 5
_WORD = re.compile(r"\w+")


#: Lengths of the word beginnings that are features too: inflected and compound words share them.
STEMS = (5, 6, 7, 8)
#: A feature has this many labelled documents, and its shares differ by this many standard errors.
LEAST_DOCS, LEAST_Z = 5, 5.0


def words_of(text: str) -> set[str]:
    """Distinct words, lower-cased, and the beginnings of longer ones, each with a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in STEMS))


@dataclass
class Linear:
    """Logistic regression with L2 penalty on binary features and a few dense ones."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: list[np.ndarray], width: int, dense: np.ndarray, y: np.ndarray, penalty: float = 2e-4, rounds: int = 300) -> Linear:
        doc, feat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        w, v = np.zeros(width), np.zeros(dense.shape[1])
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        b = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(width, 1e-8), np.full(len(v), 1e-8), 1e-8
        n = max(1, len(rows))
        for _ in range(rounds):  # Adagrad on all rows at once
            error = sigmoid(np.bincount(doc, weights=w[feat], minlength=len(rows)) + dense @ v + b) - y
            dw = np.bincount(feat, weights=error[doc], minlength=width) / n + penalty * w
            dv, db = dense.T @ error / n + penalty * v, float(error.mean()) if len(rows) else 0.0
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, b = w - 0.5 * dw / np.sqrt(gw), v - 0.5 * dv / np.sqrt(gv), b - 0.5 * db / gb**0.5
        return cls(w, v, b)

    def predict(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return sigmoid(np.array([self.weights[r].sum() for r in rows]).reshape(-1) + dense @ self.dense + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, texts: Sequence[str], labels: np.ndarray, categories: Sequence[str], folds: int = FOLDS, vocabulary: int = VOCABULARY) -> Chain:
        """labels: rows x categories, 0 or 1, in the chain's order. Folds go by row number."""
        names: dict[str, int] = {}  # texts share most words, so a text is kept as its words' numbers
        bags = [np.sort(np.fromiter((names.setdefault(w, len(names)) for w in words_of(t)), dtype=np.int32)) for t in texts]
        chain = cls(list(categories), vocabulary_of(list(names), bags, labels, vocabulary))
        place = np.full(len(names), -1, dtype=np.int64)
        place[[names[w] for w in chain.vocabulary]] = list(chain.vocabulary.values())
        rows, fold = [np.sort(place[b][place[b] >= 0]) for b in bags], np.arange(len(bags)) % folds
        dense = np.zeros((len(bags), 0))
        for c in range(len(chain.categories)):
            y, out = labels[:, c].astype(float), np.zeros(len(bags))
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = Linear.fit([rows[i] for i in inside], len(chain.vocabulary), dense[inside], y[inside])
                out[outside] = model.predict([rows[i] for i in outside], dense[outside])
            chain.models.append(Linear.fit(rows, len(chain.vocabulary), dense, y))
            chain.thresholds.append(best_threshold(out, y))
            dense = np.column_stack([dense, out])
        return chain

    def features(self, bag: set[str]) -> np.ndarray:
        return np.sort(np.array([self.vocabulary[w] for w in bag & self.vocabulary.keys()], dtype=np.int64))

    def predict(self, texts: Sequence[str]) -> np.ndarray:
        """Probabilities, texts x categories."""
        rows = [self.features(words_of(t)) for t in texts]
        dense = np.zeros((len(rows), 0))
        for m in self.models:
            dense = np.column_stack([dense, m.predict(rows, dense)])
        return dense


def vocabulary_of(names: list[str], bags: list[np.ndarray], labels: np.ndarray, size: int) -> dict[str, int]:
    """The words whose document shares differ most between the values of some category, in standard errors. bags: each text's
    distinct words as numbers into names."""

    def documents(some: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([*some, np.zeros(0, np.int32)]), minlength=len(names))

    every, n, best = documents(bags), max(1, len(bags)), np.zeros(len(names))
    for c in range(labels.shape[1]):
        positive = labels[:, c] > 0
        n1 = int(positive.sum())
        n0, one = n - n1, documents([bags[i] for i in np.flatnonzero(positive)])
        p, q, pool = one / max(1, n1), (every - one) / max(1, n0), every / n
        best = np.maximum(best, abs(p - q) / np.sqrt(pool * (1 - pool) * (1 / max(1, n1) + 1 / max(1, n0)) + 1e-9))
    telling = np.flatnonzero((every >= LEAST_DOCS) & (best >= LEAST_Z)).tolist()
    chosen = sorted(telling, key=lambda i: (-best[i], names[i]))[:size]
    return {w: i for i, w in enumerate(sorted(names[i] for i in chosen))}


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cut with the best F1 on out-of-fold probabilities; 0.5 without both values."""
    if not 0 < y.sum() < len(y):
        return 0.5
    o = np.argsort(-p, kind="stable")
    hits, ranks = np.cumsum(y[o]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (ranks + y.sum())
    f1[:-1][p[o][:-1] == p[o][1:]] = -1
    k = int(f1.argmax())
    return float((p[o][k] + (p[o][k + 1] if k + 1 < len(y) else 0)) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], rows_per_value: int = ROWS_PER_VALUE) -> tuple[list[str], np.ndarray]:
    """The bounded sample: of each value of the last category, the labelled documents with the smallest hash of the id.
    categories: name -> 0/1 column over labels. Rows with a null label or text aren't used, nor are ids whose labels contradict each
    other; of an id's texts the smallest is used. At most 2 * rows_per_value whole texts come to the driver, however often ids repeat."""
    marked = labels.select("doc_id", *[c.cast("int").alias(k) for k, c in categories.items()]).dropna()
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in categories for f in (F.min, F.max)]
    agreed = marked.groupBy("doc_id").agg(*bounds).filter(" AND ".join(f"min_{c} = max_{c}" for c in categories))
    marked = agreed.select("doc_id", *[F.col(f"min_{c}").alias(c) for c in categories])
    last = list(categories)[-1]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marked.filter(F.col(last) == v).orderBy(*order).limit(rows_per_value) for v in (0, 1)]
    chosen = some[0].unionByName(some[1])  # 2 * rows_per_value small rows at most, so they may be broadcast
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in categories]).toPandas().sort_values("doc_id")
    rows = rows.iloc[np.random.default_rng(11).permutation(len(rows))]  # folds go by row number
    return rows["text"].tolist(), rows[list(categories)].to_numpy(dtype=int).reshape(len(rows), len(categories))


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category of the chain, is_<category>: probability at or above the fitted threshold.

    One row per input row, repeated ones too, whole texts of any length, no shuffle. Null text counts as empty, null ids stay null.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    make_importable(spark)
    shared = spark.sparkContext.broadcast(chain)
    names = chain.categories
    schema = ", ".join([f"p_{c} double" for c in names] + [f"is_{c} boolean" for c in names])

    @F.pandas_udf(schema)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in parts:
            p = model.predict([t or "" for t in texts])
            yield pd.DataFrame({f"p_{c}": p[:, i] for i, c in enumerate(names)} | {f"is_{c}": p[:, i] >= model.thresholds[i] for i, c in enumerate(names)})

    return docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def label_categories() -> dict[str, F.Column]:
    """The chain over the labels table: junk first, as it tells about toxicity, then toxicity."""
    return {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions for every document, by a chain fitted on a bounded sample of ``labels``. Odd rows as in score_toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    categories = label_categories()
    texts, y = training_rows(docs, table(spark, sf_dir, "labels"), categories)
    return score_toxicity(docs, Chain.fit(texts, y, list(categories)))
