"""Alignment of two tokenizers over a corpus: which of their ids cover the same bytes, in how many documents.

Both tokenizers cut a text's bytes; where both cut, a group of aligned tokens ends, and tokens whose byte ranges overlap are linked. A pair of ids is
packed into one 64-bit key. Each partition counts its documents' distinct keys with np.unique; the partial counts are sorted globally by key ranges and
runs of a key summed, which leaves sorted count shards in the shared folder. A second pass over the ids looks its links up in
the memory-mapped shards by searchsorted.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain
from pathlib import Path
from typing import ClassVar, NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, make_importable, new_scratch_path, settle, table

#: Keys that a partition holds before it passes its counts on; characters, or tokens, that are looked at together; characters that are encoded in one piece.
KEYS_HELD, CHARS, PIECE = 2_000_000, 1_000_000, 50_000
#: A key is the first tokenizer's id shifted by this, and the second's id.
SHIFT = 32
#: Where a text may be cut: at a single space between two characters that are no white space, where the first tokenizer never joins bytes and the
#: second's entries never reach over.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Aligned(NamedTuple):
    """Texts in a row. link_ends, token_ends: for each text where its links, or its tokens of both kinds in order of groups, end (those of texts without tokens
    are empty); keys: one for each link, with repeats; pieces: for each token which entry of Aligner.told it is; the others: counts for each text."""

    link_ends: np.ndarray
    token_ends: np.ndarray
    keys: np.ndarray
    pieces: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray


def pieces_of(text: str) -> list[str]:
    """The text in pieces of about PIECE characters that, each with a space before it, are encoded like the whole."""
    out, at = [], 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


class Aligner:
    """Aligns texts by a byte-level file of ``tokenizers`` (a) and a ``sentencepiece`` model that adds a space (b)."""

    #: One aligner for each pair of files in a worker.
    kept: ClassVar[dict[tuple[str, str], Aligner]] = {}

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.a = a_encoder(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes = _bytes_of(json.loads(Path(a_file).read_text()))
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        #: Every id as text and what follows it: within a group, at its end.
        self.told = [f"{i}{mark}" for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for mark in marks for i in range(n)]

    @classmethod
    def of(cls, a_file: str, b_file: str) -> Aligner:
        if (a_file, b_file) not in cls.kept:
            cls.kept[a_file, b_file] = cls(a_file, b_file)
        return cls.kept[a_file, b_file]

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both kinds of ids of each text; none where either's bytes aren't the text's."""
        cut = [pieces_of(t) if t else [] for t in texts]
        flat = [p for own in cut for p in own]
        every_a, every_b = self.a([" " + p for p in flat]), self.b.encode(flat, num_threads=1)
        out, at = [], 0
        for text, own in zip(texts, cut, strict=True):
            x, y = (e[at] if len(own) == 1 else list(chain.from_iterable(e[at : at + len(own)])) for e in (every_a, every_b))
            at += len(own)
            whole = (" " + text).encode() if own else b""
            if b"".join(map(self.a_bytes.__getitem__, x)) != whole or b"".join(map(self.b_bytes.__getitem__, y)) != whole:
                x, y = [], []
            out.append((np.array(x, dtype="<u4"), np.array(y, dtype="<u4")))
        return out

    def align(self, a: Iterable[bytes], b: Iterable[bytes]) -> Iterator[Aligned]:
        """Encoded texts, as many at a time as have about CHARS tokens, in order."""
        some, size = [], 0
        for x, y in zip(a, b, strict=True):
            some.append((np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4")))
            size += len(some[-1][0]) + len(some[-1][1])
            if size > CHARS:
                yield self.together(some)
                some, size = [], 0
        if some:
            yield self.together(some)

    def together(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Aligned:
        a, b = (np.concatenate([x[k] for x in texts]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in texts], dtype=np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.append(0, a_ends)[np.cumsum(n_a)]
        # all texts are one row of bytes; bit 1: a token of a ends here, bit 2: one of b
        mark = np.zeros((ends[-1] if len(ends) else 0) + 1, dtype=np.int8)
        mark[a_ends] |= 1
        mark[b_ends] |= 2
        where = np.flatnonzero(mark)
        bits = mark[where]
        of_a, of_b = (bits & 1).astype(np.int64), (bits >> 1).astype(np.int64)
        seen_a, seen_b = np.cumsum(of_a), np.cumsum(of_b)
        # between two neighbouring ends of either lies the overlap of just one pair of tokens
        keys = (a[seen_a - of_a] << SHIFT) | b[seen_b - of_b]
        shared = np.flatnonzero(bits == 3)
        group = np.cumsum(bits == 3) - (bits == 3)  # of what ends here
        before_b, upto_a = np.append(0, seen_b[shared])[group], np.append(seen_a[shared], 0)[group]
        is_a, is_b = of_a.astype(bool), of_b.astype(bool)
        pieces = np.empty(len(a) + len(b), dtype=np.int64)
        pieces[np.arange(len(a)) + before_b[is_a]] = a + len(self.a_bytes) * (bits[is_a] == 3)
        pieces[np.arange(len(b)) + upto_a[is_b]] = 2 * len(self.a_bytes) + b + len(self.b_bytes) * (bits[is_b] == 3)
        links = np.searchsorted(where, ends, "right")
        groups = np.diff(np.searchsorted(where[shared], ends, "right"), prepend=0)
        return Aligned(links, np.cumsum(n_a + n_b), keys, pieces, n_a, n_b, groups)

    def groups(self, pieces: np.ndarray) -> str:
        return "".join(map(self.told.__getitem__, pieces.tolist()))[:-1]


def _bytes_of(file: dict) -> list[bytes]:
    """What each id of a byte-level file stands for."""
    byte_of, vocabulary = {c: i for i, c in enumerate(_byte_letters())}, file["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in t if c in byte_of)
    return out


def a_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts, none of them special. Where a file's merges are in the order of their ids, and it splits texts the usual way, tiktoken's core gives the same
    ids several times faster."""
    import tiktoken
    from tokenizers import Tokenizer

    file = json.loads(Path(path).read_text())
    vocabulary, before = file["model"]["vocab"], file["pre_tokenizer"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    in_order = [vocabulary["".join(m)] for m in merges] == list(range(256, 256 + len(merges)))
    if in_order and not file["normalizer"] and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True}:
        ranks = {x: i for i, x in enumerate(_bytes_of(file)) if i < 256 + len(merges)}
        core = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda texts: [core.encode_ordinary(t) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda texts: [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]


# Fixed value: how byte-level files split texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others in order for the letters from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(i if i in prints else next(others)) for i in range(256)]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, dtype=np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def _local(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise RuntimeError(f"count shards are memory-mapped, so the shared folder must be mounted on all machines; it is {path}")
    return unquote(at.path)


class Counts:
    """Count shards, sorted and apart from each other: files of keys and of counts."""

    kept: ClassVar[dict[str, Counts]] = {}

    def __init__(self, folder: str, shards: list[tuple[int, str]]):
        self.first = np.array([k for k, _ in shards], dtype=np.int64)
        self.keys, self.counts = ([np.memmap(f"{folder}/{name}.{what}", dtype="<i8", mode="r") for _, name in shards] for what in ("keys", "counts"))

    @classmethod
    def of(cls, folder: str, shards: list[tuple[int, str]]) -> Counts:
        if folder not in cls.kept:
            cls.kept.clear()  # a worker serves one corpus at a time
            cls.kept[folder] = cls(folder, shards)
        return cls.kept[folder]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(keys), dtype=np.int64), np.searchsorted(self.first, keys, "right") - 1
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            out[at] = self.counts[s][np.searchsorted(self.keys[s], keys[at])]
        return out


def encoded(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a, b: both kinds of ids of each text, as bytes of unsigned 32-bit numbers; written to the shared folder, so that texts are encoded once."""
    make_importable(docs.sparkSession)

    @F.pandas_udf("a binary, b binary")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        aligner = Aligner.of(a_file, b_file)
        for texts in parts:
            rows, some, size = [], [], 0
            for t in texts:
                some.append(t or "")
                size += len(some[-1])
                if size > CHARS:
                    rows += aligner.encode(some)
                    some, size = [], 0
            rows += aligner.encode(some)
            yield pd.DataFrame({"a": [a.tobytes() for a, _ in rows], "b": [b.tobytes() for _, b in rows]}, dtype=object)
        give_back()

    told = docs.select(F.col(f"`{id_col}`").alias("doc_id"), ids(F.col(f"`{text_col}`")).alias("ids"))
    return settle(told.select("doc_id", "ids.a", "ids.b"), "token-ids")


def count_pairs(ids: DataFrame, a_file: str, b_file: str) -> tuple[str, list[tuple[int, str]], DataFrame]:
    """In how many documents of encoded() each pair of ids is linked: the folder of the count shards, (first key, name) of each in order, and the table
    a, best: each first id's highest count. Shards are written under another name and moved into place, so a task that runs again does no harm."""
    spark = ids.sparkSession
    make_importable(spark)
    path = new_scratch_path(spark, "pair-counts")
    folder = _local(path)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner.of(a_file, b_file)
        keys, counts, waiting, n = [], [], [], 0

        def merge() -> None:
            nonlocal n
            if waiting:
                k, c = np.unique(np.concatenate(waiting), return_counts=True)
                merged = _merged([*keys, k], [*counts, c.astype(np.int64)])
                keys[:], counts[:] = [merged[0]], [merged[1]]
                waiting.clear()
                n = 0

        for rows in batches:
            for found in aligner.align(rows["a"], rows["b"]):
                own = [np.unique(x) for x in np.split(found.keys, found.link_ends[:-1])]
                waiting += own
                n += sum(map(len, own))
                if n > KEYS_HELD:
                    merge()
                    if len(keys[0]) > KEYS_HELD:
                        yield pd.DataFrame({"key": keys.pop(), "n": counts.pop()})
        merge()
        if keys:
            yield pd.DataFrame({"key": keys[0], "n": counts[0]})
        give_back()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}"
        begun = f"{folder}/_{name}.{task.taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        first, last, best = None, (np.zeros(0, np.int64), np.zeros(0, np.int64)), {}
        with open(f"{begun}.keys", "wb") as keys_to, open(f"{begun}.counts", "wb") as counts_to:

            def write(keys: np.ndarray, counts: np.ndarray) -> None:
                keys.astype("<i8").tofile(keys_to)
                counts.astype("<i8").tofile(counts_to)
                a = keys >> SHIFT
                at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
                for i, n in zip(a[at].tolist(), np.maximum.reduceat(counts, at).tolist() if len(at) else [], strict=True):
                    best[i] = max(best.get(i, 0), n)

            for b in batches:
                keys, counts = _merged([last[0], b["key"].to_numpy()], [last[1], b["n"].to_numpy()])
                first = int(keys[0]) if first is None and len(keys) else first
                write(keys[:-1], counts[:-1])  # the last run may go on in the next batch
                last = keys[-1:], counts[-1:]
            write(*last)
        if first is None:
            for what in ("keys", "counts"):
                os.remove(f"{begun}.{what}")
            return
        for what in ("keys", "counts"):
            os.replace(f"{begun}.{what}", f"{folder}/{name}.{what}")
        yield pd.DataFrame({"first": first, "name": name, "a": list(best), "best": list(best.values())})

    counted = settle(ids.select("a", "b").mapInPandas(partial, "key long, n long"), "pair-partials")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = counted.repartitionByRange(parts, "key").sortWithinPartitions("key")
    made = settle(in_order.mapInPandas(shards, "first long, name string, a long, best long"), "pair-shards")
    listed = [(r["first"], r["name"]) for r in made.select("first", "name").distinct().orderBy("first").collect()]
    return path, listed, made.groupBy("a").agg(F.max("best").alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair's count is the highest of their first id), count_sum (over
    links), groups_sha256, and with ``with_groups`` the groups themselves.

    Texts that are null, empty or not given back by both tokenizers have zeros and empty texts. Texts of any length are taken whole, chunk by chunk.
    Repeated rows count as documents of their own, null ids stay, other columns are ignored. An empty table gives an empty result. The driver
    holds each first id's highest count and the shards' first keys, which the vocabulary and the number of partitions bound.
    """
    encoded_docs = encoded(docs, a_file, b_file, id_col, text_col)
    path, shards, best = count_pairs(encoded_docs, a_file, b_file)
    spark = docs.sparkSession
    highest = best.toPandas()
    top = np.zeros(int(highest["a"].max()) + 1 if len(highest) else 0, dtype=np.int64)
    top[highest["a"]] = highest["best"]
    folder, shared = _local(path), spark.sparkContext.broadcast((shards, top))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names) + ", groups_sha256 string" + ", groups string" * with_groups)
    def measure(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        aligner = Aligner.of(a_file, b_file)
        listed, top = shared.value
        counts = Counts.of(folder, listed)
        for a, b in parts:
            out = []
            for found in aligner.align(a, b):
                distinct, where = np.unique(found.keys, return_inverse=True)
                n = counts(distinct)[where]
                best = n == top[found.keys >> SHIFT]
                first = np.append(0, found.link_ends[:-1])
                over = lambda x, first=first, found=found: np.diff(np.append(0, np.cumsum(x))[np.append(first, found.link_ends[-1])])
                groups = [aligner.groups(x) for x in np.split(found.pieces, found.token_ends[:-1])]
                hashes = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(groups, found.n_a.tolist(), strict=True)]
                columns = [found.n_a, found.n_b, found.n_groups, found.link_ends - first, over(best), over(n), hashes, *([groups] * with_groups)]
                out.append(pd.DataFrame(dict(zip([*names, "groups_sha256", *(["groups"] * with_groups)], columns, strict=True))))
            yield pd.concat(out) if out else pd.DataFrame([], columns=[*names, "groups_sha256", *(["groups"] * with_groups)])
        give_back()

    told = encoded_docs.select("doc_id", measure(F.col("a"), F.col("b")).alias("m"))
    return told.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in [*names, "groups_sha256", *(["groups"] * with_groups)]])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50,000-entry byte-level tokenizer against the 32,000 pieces, over all documents. Odd rows as in align."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
