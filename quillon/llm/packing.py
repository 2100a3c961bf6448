"""Vector bin packing of training examples: tokens, segments and loss-bearing tokens are limited at once.

The dot-product heuristic fills one sequence at a time: of the examples that still fit, it takes the one whose demand
vector has the largest dot product with the capacity that is left, both in units of the capacities.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import ClassVar
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, make_importable, settle, table

CAPACITY = 2048
END_ID = 1
#: Most examples that a task holds and packs at once: bounds memory and loses at most one sequence's worth of space a window.
WINDOW = 8192


def dot_product_pack(demands: np.ndarray, capacities: Sequence[float]) -> list[list[int]]:
    """Bins as lists of row numbers. Examples of equal demand are interchangeable, so each step looks at the distinct
    demands only; ties go to the lexicographically larger demand, then to the earlier row.
    An example beyond a capacity on its own gets a bin of its own."""
    if not len(demands):
        return []
    cap = np.asarray(capacities, dtype=float)
    kinds, of = np.unique(np.asarray(demands, dtype=float), axis=0, return_inverse=True)
    kinds, of = kinds[::-1], len(kinds) - 1 - of.ravel()
    waiting = [list(x[::-1]) for x in np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(kinds)))[:-1])]
    bins, fits = [], (kinds <= cap).all(axis=1)
    for k in np.flatnonzero(~fits):
        bins += [[i] for i in waiting[k][::-1]]
    kinds, waiting = kinds[fits], [w for w, fit in zip(waiting, fits, strict=True) if fit]
    number, scaled, some = np.array([len(w) for w in waiting], dtype=np.int64), kinds / cap, len(kinds)
    while some:
        left, now, low = cap.copy(), [], 0
        while True:
            low += int(np.searchsorted(-kinds[low:, 0], -left[0]))  # demands are sorted by the first limit
            score = np.where((number[low:] > 0) & (kinds[low:] <= left).all(axis=1), scaled[low:] @ (left / cap), -1.0)
            k = low + int(score.argmax()) if len(score) else -1
            if k < 0 or score[k - low] < 0:
                break
            now.append(waiting[k].pop())
            left -= kinds[k]
            number[k] -= 1
            if not number[k]:
                some -= 1
                if some < len(kinds) // 2:
                    stay = np.flatnonzero(number)
                    kinds, scaled, waiting, number = kinds[stay], scaled[stay], [waiting[i] for i in stay], number[stay]
                    low = 0
        bins.append(now)
    return bins


#: Sequences of the second step have numbers from here on.
SECOND = 1 << 62


def pack_items(df: DataFrame, demand_cols: Sequence[str] = ("tokens", "segments", "loss_tokens"), capacities: Sequence[float] = (CAPACITY, 64, CAPACITY), window: int = WINDOW) -> DataFrame:
    """Rows of df with ``sequence_id`` and ``position`` (from 0 within the sequence): whole examples, never cut.

    Each task packs its own rows, a window at a time, so memory is bounded. Sequences that leave over a tenth of every limit
    free, the last of a window, are taken apart again, and their rows meet in a small second step: many small partitions don't make for many half-empty
    sequences. Null demands count as 0; an example beyond a capacity has a sequence to itself. Repeated rows are
    separate examples. Input columns with the names of the output give way. An empty table gives an empty result. sequence_id is the task's number
    times 2**32 plus a count, and 2**62 more in the second step.
    """
    make_importable(df.sparkSession)
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("sequence_id", "position")])
    schema = T.StructType([*base.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("position", T.IntegerType())])
    columns, names, cap = list(demand_cols), base.columns, np.asarray(capacities, dtype=float)

    def packer(second: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number = (TaskContext.get().partitionId() << 32) + SECOND * second
            for rows in _windows(batches, window):
                demands = rows[columns].fillna(0).to_numpy(dtype=float)
                bins = dot_product_pack(demands, capacities)
                order = [i for b in bins for i in b]
                out = rows.iloc[order][names].reset_index(drop=True)
                ids = pd.Series([number + k for k, b in enumerate(bins) for _ in b], dtype="Int64")
                if not second:
                    spare = [bool((demands[b].sum(axis=0) < 0.9 * cap).all()) for b in bins]
                    ids[np.repeat(spare, [len(b) for b in bins])] = pd.NA
                out["sequence_id"] = ids
                out["position"] = [p for b in bins for p in range(len(b))]
                number += len(bins)
                yield out

        return run

    return _in_two_steps(base.mapInPandas(packer(False), schema), lambda rest: rest.select(*names).mapInPandas(packer(True), schema), window)


def _in_two_steps(first: DataFrame, again: Callable[[DataFrame], DataFrame], window: int) -> DataFrame:
    """What the first step has placed, and what ``again`` makes of the rows that it hasn't (no sequence_id): the last sequence or so of each
    task, dealt to one task for each window of rows. The first step is settled, as both read it."""
    first = settle(first, "packed")
    left = first.filter(F.col("sequence_id").isNull())
    few = max(1, -(-left.count() // window))
    order = [c for c, t in left.dtypes if not t.startswith(("map", "variant"))]
    rest = left.repartition(few, F.xxhash64(*order)).sortWithinPartitions(*order)  # in order, so that a task that is run again packs alike
    return first.filter(F.col("sequence_id").isNotNull()).unionByName(again(rest))


def _windows(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= window:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def conversation_items(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One example per conversation for pack_items: conv_id, tokens, segments, loss_tokens (white-space tokens; those of
    ``loss_role`` bear loss). Null texts have no tokens. An empty table gives an empty result; other columns are ignored."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return conversations.groupBy("conv_id").agg(
        F.sum(n).cast("long").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum(F.when(F.col("role") == loss_role, n).otherwise(0)).cast("long").alias("loss_tokens")
    )


def conversation_examples(conversations: DataFrame, tokenizer_file: str, capacities: Sequence[int] = (CAPACITY, 16, 1024), loss_role: str = "assistant") -> DataFrame:
    """Instruction data for pack_items: conv_id, pieces array<struct<turn,start,length>>, tokens, segments, loss_tokens.

    An example is a run of a conversation's consecutive turns that keeps within the three limits: ids, turns, and ids of ``loss_role``, which bear loss. A
    turn's ids end with one more, the end id; a turn beyond a limit is cut. Turns are sorted by conversation and place over ranges of both, so a
    conversation of any length is dealt over tasks (an example ends where a range does), and none is gathered. Null texts are empty, null
    roles bear no loss, repeated turns stay, null ids are a conversation of their own. An empty table gives an empty result; other columns are ignored.
    """
    spark = conversations.sparkSession
    make_importable(spark)
    most_tokens, most_segments, most_loss = capacities
    conv, turn, zero = F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(0)
    rows = conversations.select(F.coalesce(conv, zero).alias("conv"), conv.isNull().alias("no_conv"), F.coalesce(turn, zero).alias("turn"), turn.isNull().alias("no_turn"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("bears"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.withColumn("n", _length_of(tokenizer_file)(F.col("text"))).drop("text").withColumn("from", F.spark_partition_id())
    order = ["no_conv", "conv", "no_turn", "turn", "n", "bears", "from"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, pieces, tokens, loss, out = None, [], 0, 0, []

        def close() -> None:
            nonlocal pieces, tokens, loss
            if pieces:
                out.append((whose, pieces, tokens, len(pieces), loss))
            pieces, tokens, loss = [], 0, 0

        for b in batches:
            for conv, no_conv, turn, no_turn, bears, n in zip(*(b[c].tolist() for c in ("conv", "no_conv", "turn", "no_turn", "bears", "n")), strict=True):
                conv, turn = None if no_conv else conv, None if no_turn else turn
                if pieces and conv != whose:
                    close()
                whose, size = conv, min(most_tokens, most_loss) if bears else most_tokens
                for start, length in _cut(n + 1, size):
                    if tokens + length > most_tokens or len(pieces) == most_segments or loss + bears * length > most_loss:
                        close()
                    pieces.append({"turn": turn, "start": start, "length": length})
                    tokens, loss = tokens + length, loss + bears * length
            if len(out) > 2_000:
                yield frame(out)
                out.clear()
        close()
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "pieces", "tokens", "segments", "loss_tokens"], dtype=object).astype({"conv_id": "Int64"})

    return sizes.drop("from").mapInPandas(run, "conv_id long, pieces array<struct<turn:long,start:long,length:long>>, tokens long, segments long, loss_tokens long")


def _length_of(tokenizer_file: str):
    @F.pandas_udf("long")
    def length(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = ChunkEncoder.of(tokenizer_file)
        for t in texts:
            yield pd.Series([len(encoder.encode(x)) for x in t], dtype="int64")

    return length


def pack_conversations(conversations: DataFrame, tokenizer_file: str, capacities: Sequence[int] = (CAPACITY, 16, 1024), loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, start, length, sequence_id, position (of the example), offset (of the piece, gapless from 0), example_loss_tokens (with an
    example's first piece, else 0): conversation_examples, packed whole by pack_items under all three limits. Odd rows as there."""
    packed = pack_items(conversation_examples(conversations, tokenizer_file, capacities, loss_role), capacities=capacities)
    each = packed.select("conv_id", "sequence_id", "position", "segments", "loss_tokens", F.posexplode("pieces").alias("piece", "p"))
    before = F.sum("p.length").over(Window.partitionBy("sequence_id").orderBy("position", "piece")) - F.col("p.length")
    return each.select("conv_id", "p.turn", "p.start", "p.length", "sequence_id", "position", before.alias("offset"), F.when(F.col("piece") == 0, F.col("loss_tokens")).otherwise(0).cast("long").alias("example_loss_tokens"))


#: Stands for the mark of a word's end; no UTF-8 text has this byte.
WORD_END = b"\xff"


def merger(path: str) -> Callable[[bytes], list[int]] | None:
    """The merges of a word-end byte-pair file as tiktoken ranks; None if the file isn't of that kind."""
    import tiktoken

    model = json.loads(Path(path).read_text()).get("model", {})
    vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    first = len(vocab) - len(merges)
    if model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or any(vocab.get(a + b) != 512 + k for k, (a, b) in enumerate(merges)) or first < 512:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the usual printable stand-ins for bytes
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {WORD_END: 2**31 - 1}
    for token, i in vocab.items():
        body = token.removesuffix("</w>")
        if all(c in byte_of for c in body):
            ranks[bytes(byte_of[c] for c in body) + WORD_END * (body != token)] = i
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Known(dict):
    """Chunk -> its ids as bytes; what is missing is learnt when it is asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.merge = Tokenizer.from_file(path), merger(path)

    def __missing__(self, chunk: str) -> bytes:
        if self.merge and chunk.isalpha() and (chunk.isascii() or is_normalized("NFC", chunk)) and chunk == chunk.lower():
            out = array("I", self.merge(chunk.encode() + WORD_END)).tobytes()
        elif self.merge and (parts := _WORD_AND_MARKS.fullmatch(chunk)) and parts[1] == parts[1].lower():
            out = self[parts[1]] + self[parts[2]]
        else:
            out = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = out
        return out


#: Letters, then marks that no letter or digit follows: the tokenizer always cuts between the two.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


#: Punctuation that isn't alone before a comma or full stop.
_TIED = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,]) ")


def _plain(text: str) -> bool:
    """Commas and full stops may be parted from what is before them, and lower() goes letter by letter, one for one (a dotted capital I becomes two, of which the
    second is tied to what follows); no special token's start."""
    return not ("\u03a3" in text or "\u0130" in text or "<|" in text or _TIED.search(text)) and (text.isascii() or is_normalized("NFC", text))


class ChunkEncoder:
    """Ids of whole texts from a ``tokenizers`` file, one white-space chunk at a time.

    The tokenizer drops white space before its merges, so a text's ids are those of its chunks in a row; chunks that
    were met before come from a bounded memory, which a worker keeps from task to task. It also lowers letters and
    cuts them from punctuation, so most texts are lowered and parted from their commas and full stops first, which makes for fewer
    chunks. If its merges are in the order of their ids, words of letters alone are merged by tiktoken's core, which gives
    the same ids several times faster.
    """

    #: One encoder for each tokenizer file in a worker.
    kept: ClassVar[dict[tuple[str, int], ChunkEncoder]] = {}

    def __init__(self, path: str, memory: int = 200_000):
        self.known, self.memory = _Known(path), memory

    @classmethod
    def of(cls, path: str, memory: int = 200_000) -> ChunkEncoder:
        if (path, memory) not in cls.kept:
            cls.kept[path, memory] = cls(path, memory)
        return cls.kept[path, memory]

    def encode(self, text: str) -> np.ndarray:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ") + " "
        if self.known.merge and _plain(text):
            text = text.lower().replace(", ", " , ").replace(". ", " . ")
        if len(self.known) > self.memory:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.split(" "))), dtype="<u4")


def _cut(length: int, capacity: int) -> list[tuple[int, int]]:
    return [(s, min(capacity, length - s)) for s in range(0, length, capacity)]


def top_up(bins: list[list[tuple[int, int, int]]], capacity: int, max_segments: int, least: int, loss_limit: int | None = None, free: Sequence[bool] | None = None) -> list[list[tuple[int, int, int]]]:
    """Dissolve the emptiest bins into the gaps of the others, cutting pieces (item, start, length) to fit. Every id counts
    against ``loss_limit`` but the first of the items in ``free``."""
    fill = lambda b: sum(x[2] for x in b)
    bears_none = lambda i, start: int(free is not None and free[i] and start == 0)
    loss_room = lambda b: capacity if loss_limit is None else loss_limit - sum(n - bears_none(i, s) for i, s, n in b)
    room = lambda b: min(capacity - fill(b), loss_room(b))
    full = [b for b in bins if room(b) < least]
    some = sorted((b for b in bins if room(b) >= least), key=fill)
    i, j = 0, len(some) - 1
    while i < j:
        gap = room(some[j])
        if gap < least or len(some[j]) >= max_segments:
            j -= 1
        elif not some[i]:
            i += 1
        else:
            item, start, n = some[i].pop()
            take = min(n, capacity - fill(some[j]), loss_room(some[j]) + bears_none(item, start))
            some[j].append((item, start, take))
            if take < n:
                some[i].append((item, start + take, n - take))
    return full + [b for b in some if b]


def pack_documents(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_segments: int = 512, max_loss_tokens: int | None = None,
    end_id: int = END_ID, window: int = WINDOW, least_cut: int = 32, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids themselves.

    A document's ids end with ``end_id``. It is cut every ``capacity`` ids, or as many as may bear loss; pieces of ``capacity`` are sequences, the rest is packed
    by dot_product_pack under the three limits (every id bears loss but a document's first), and then bins that are
    still short of ``least_cut`` or more ids are filled by cutting pieces of the emptiest. A task packs what it reads,
    a window of pieces in memory; a bin that stays short goes on to the next window, and a task's last one, with its ids, to a second
    step, where one task packs those of thousands. So nothing but a sequence a task is shuffled, and little padding is left however many partitions there are. Null or
    empty text is a document of one id, a null id stays null. Texts of any length are encoded whole. Repeated rows are packed each on its own. Other columns are
    ignored. An empty table gives an empty result. sequence_id: the task's number times 2**32 plus a count, and 2**62 more in the second step.
    """
    make_importable(docs.sparkSession)
    loss_limit, end = max_loss_tokens or capacity, np.array([end_id], dtype="<u4")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    known_id = lambda c: (F.coalesce(c, F.lit(0)).alias("doc_id"), c.isNull().alias("none"))  # noqa: E731  a null would make floats of all ids

    class Packer:
        def __init__(self, second: bool):
            self.second, self.number, self.out = second, (TaskContext.get().partitionId() << 32) + SECOND * second, []
            self.held: list[tuple[object, int, int, np.ndarray]] = []  # document, its ids, start of the rest, the rest

        def put(self, doc, total, start, ids, sequence, offset) -> None:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, *([ids.tolist()] * with_ids), *([None] * (not self.second))))

        def take(self, doc, total: int, first: int, ids: np.ndarray) -> None:
            for start, n in _cut(len(ids), min(capacity, loss_limit)):
                if n == capacity:
                    self.put(doc, total, first + start, ids[start : start + n], self.number, 0)
                    self.number += 1
                else:
                    self.held.append((doc, total, first + start, ids[start : start + n].copy()))
            if len(self.held) >= window:
                self.pack(last=False)

        def pack(self, last: bool) -> None:
            held, self.held = self.held, []
            demands = np.array([(len(x[3]), 1, len(x[3]) - (x[2] == 0)) for x in held]).reshape(-1, 3)
            bins = [[(i, 0, len(held[i][3])) for i in b] for b in dot_product_pack(demands, (capacity, max_segments, loss_limit))]
            for b in top_up(bins, capacity, max_segments, least_cut, loss_limit, [x[2] == 0 for x in held]):
                pieces = [(held[i][0], held[i][1], held[i][2] + start, held[i][3][start : start + n]) for i, start, n in b]
                loss = sum(len(ids) - (start == 0) for _, _, start, ids in pieces)
                short = min(capacity - sum(len(p[3]) for p in pieces), loss_limit - loss) >= least_cut and len(b) < max_segments
                if short and not (last and self.second):
                    self.held += pieces
                    continue
                offset = 0
                for doc, total, start, ids in pieces:
                    self.put(doc, total, start, ids, self.number, offset)
                    offset += len(ids)
                self.number += 1
            if last:  # what is left is for the second step
                for doc, total, start, ids in self.held:
                    self.out.append((doc, start, len(ids), None, total, None, None, *([None] * with_ids), ids.tobytes()))

        def ready(self, least: int) -> Iterator[pd.DataFrame]:
            if len(self.out) > least:
                names = [x.split()[0] for x in schema.split(", ")] + ["rest"] * (not self.second)
                yield pd.DataFrame(self.out, columns=names, dtype=object).astype({c: "Int64" for c in names[:7]})
                self.out = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = ChunkEncoder.of(tokenizer_file), Packer(second=False)
        for rows in batches:
            for doc, none, text in zip(rows["doc_id"].tolist(), rows["none"], rows["text"], strict=True):
                ids = np.append(encoder.encode(text), end).astype("<u4", copy=False)
                packer.take(None if none else doc, len(ids), 0, ids)
                yield from packer.ready(2_000)
        packer.pack(last=True)
        yield from packer.ready(0)
        give_back()

    def run_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(second=True)
        for rows in batches:
            for doc, none, total, start, rest in zip(*(rows[c].tolist() for c in ("doc_id", "none", "doc_tokens", "start", "rest")), strict=True):
                packer.take(None if none else doc, total, start, np.frombuffer(rest, dtype="<u4"))
                yield from packer.ready(2_000)
        packer.pack(last=True)
        yield from packer.ready(0)

    first = docs.select(*known_id(F.col(id_col).cast("long")), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, schema + ", rest binary")
    again = lambda left: left.select(*known_id(F.col("doc_id")), "doc_tokens", "start", "rest").mapInPandas(run_again, schema)
    return _in_two_steps(first, lambda left: again(left).withColumn("rest", F.lit(None).cast("binary")), window).drop("rest")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` packed into sequences of 2,048 ids. Odd rows as in pack_documents."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` in sequences of 2,048 ids, 16 turns and 1,024 ids of the assistant at most. Odd rows as in pack_conversations."""
    return pack_conversations(table(spark, sf_dir, "conversations"), default_tokenizer())
