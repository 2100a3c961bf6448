"""N-gram Jaccard join with several global token orders.

Two sets that are similar enough share a token in their prefixes under *any* total order of the tokens. So a pair is
looked at only if it does so under several orders: each gives a candidate filter and the filters are intersected before
anything is compared. Orders put frequent tokens last (by counts over all documents) and differ in how they shuffle
tokens of like frequency.

Plan: (1) one scan gives each document's set identity, a sketch of it and the counts of frequent tokens; equal sets are one
node from here on. (2) A second scan gives the prefixes. Under a token with few nodes, pairs of fitting sizes are formed, and
pairs found under all orders stay. Under a token with many nodes no pairs are formed: a search over the list ties nodes whose
sizes and sketches (a bound on how much they differ) allow a link, with one tie for each node it reaches; a still longer list
is tied to its first node by the query plan, so no task gathers it. (3) Tied nodes form blocks. A block's sets meet in one task,
or, above a size, part by part: links within the parts, then among one set of each group found, leave few groups, and only sets
outside the block's largest group meet the other parts. Where sets meet, the same orders, sharpened by the counts among these sets,
pick candidates, and overlaps are counted exactly. (4) Links become components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CLASS, UPPER, discard, give_back, look_up, make_importable, settle, table
from .components import connected_components

U = np.uint64
#: Random odd multipliers and byte values from a fixed seed: every task hashes alike.
_rng = np.random.default_rng(20240229)
_STEP = U(int(_rng.integers(2**62)) * 4 + 3)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(0, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
_SALT = _rng.integers(0, 2**63, 16, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes that are hashed at a time.
SLICE = 1 << 18


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random; another one for each salt."""
    x = x ^ _SALT[salt]
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct word n-grams, as 64-bit hashes, of the texts in an Arrow column, computed on its bytes."""

    def __init__(self, n: int):
        self.n, self.power, self.back = n, np.ones(1, U), np.ones(1, U)
        self.inverse = U(pow(int(_STEP), -1, 2**64))

    def _powers(self, length: int) -> None:
        if len(self.power) < length:
            self.power = np.cumprod(np.concatenate([[U(1)], np.full(length, _STEP)]), dtype=U)
            self.back = np.cumprod(np.concatenate([[U(1)], np.full(length, self.inverse)]), dtype=U)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """One sorted array for each text; empty without words. Null is the empty text."""
        column = column.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(off, off[low] + SLICE, "right")) - 1)
            yield from self._slice(data[off[low] : off[high]], off[low : high + 1] - off[low])
            low = high

    def _slice(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        count, none = len(off) - 1, np.zeros(0, U)
        if not len(data):
            yield from (none for _ in range(count))
            return
        self._powers(len(data))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        space = _SPACE[data]
        first = ~space & (edge[:-1] | np.concatenate([[True], space[:-1]]))
        last = ~space & (edge[1:] | np.concatenate([space[1:], [True]]))
        si, ei = np.flatnonzero(first), np.flatnonzero(last)
        terms = _BYTE[data] * self.power[: len(data)]
        sums = np.cumsum(terms, dtype=U)
        words = mix((sums[ei] - sums[si] + terms[si]) * self.back[si])
        ends = np.searchsorted(si, off)  # words before each document's start
        grams = np.zeros(0, U)
        if len(words) >= self.n:
            grams = words[: len(words) - self.n + 1] * _PLACE[0]
            for k in range(1, self.n):
                grams = grams + words[k : len(words) - self.n + 1 + k] * _PLACE[k]
            grams = mix(grams)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= self.n:
                s = np.sort(grams[a : b - self.n + 1])
                keep = np.ones(len(s), dtype=bool)
                keep[1:] = s[1:] != s[:-1]
                yield s[keep]
            elif b > a:
                yield mix(np.array([(words[a:b] * _PLACE[: b - a]).sum(dtype=U) + U(b - a)], dtype=U), 1)
            else:
                yield none


def identity(s: np.ndarray, salt: int = 0, place: int = 2) -> int:
    """64 bits that stand for the whole set: equal sets are one node. Another salt gives other bits."""
    return int((mix(s ^ U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), place).sum(dtype=U) + U(len(s))).view(np.int64))


#: Fewest bits of a node's sketch, a power of two; a node has one to two of them for each token.
SKETCH_BITS = 256


def sketch(s: np.ndarray) -> bytes:
    """For each hash bucket, whether it has an odd number of tokens. Where two nodes' bits differ, one of them has a token that
    the other lacks, so the number of such places is a bound on how much they differ."""
    bits = max(SKETCH_BITS.bit_length() - 1, len(s).bit_length())
    odd = np.bincount((mix(s, 15) & U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(c: np.ndarray, width: int) -> np.ndarray:
    """Sketches, in the last axis, as if made with ``width`` bytes."""
    return np.bitwise_xor.reduce(c.reshape(*c.shape[:-1], -1, width), axis=-2)


def least_difference(a: bytes, b: bytes) -> int:
    if len(a) != len(b):
        width = min(len(a), len(b))
        a, b = (folded(np.frombuffer(v, dtype=np.uint8), width).tobytes() for v in (a, b))
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def may_link(total, differ, num: int, den: int):
    """Two sets of ``total`` tokens together that differ in at least so many may be similar enough."""
    return den * (total - differ) >= num * (total + differ)


def list_ties(ids: np.ndarray, sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Ties that connect the nodes of a list wherever sizes and sketches allow a link; each node reached is looked for no more."""
    width = np.array([len(c) for c in sketches])
    where, own = np.zeros(len(ids), dtype=np.int64), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        where[at] = np.arange(len(at))
        own[w] = np.frombuffer(b"".join(sketches[i] for i in at), dtype=np.uint8).reshape(len(at), w)

    def differ(x: int, others: np.ndarray) -> np.ndarray:
        out, mine = np.zeros(len(others), dtype=np.int64), own[width[x]][where[x]]
        for w in np.unique(width[others]).tolist():
            k, least = np.flatnonzero(width[others] == w), min(w, int(width[x]))
            out[k] = np.bitwise_count(folded(mine, least) ^ folded(own[w][where[others[k]]], least)).sum(axis=1, dtype=np.int64)
        return out

    left, ties = np.argsort(sizes, kind="stable"), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            small, large = np.minimum(sizes[left], sizes[x]), np.maximum(sizes[left], sizes[x])
            may = den * small >= num * large
            at = np.flatnonzero(may)
            may[at] = may_link(sizes[left[at]] + sizes[x], differ(x, left[at]), num, den)
            hit = left[may]
            ties += [(int(ids[x]), int(ids[y])) for y in hit]
            queue += hit.tolist()
            left = left[~may]
    return ties


def _possible(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n_a, c_a, n_b, c_b in any order) that sketches allow to link."""
    for b in batches:
        n = (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()).tolist()
        keep = [may_link(t, least_difference(x, y), num, den) for x, y, t in zip(b.column("c_a").to_pylist(), b.column("c_b").to_pylist(), n, strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def prefix_length(n, num: int, den: int):
    """A partner has ceil(n * num / den) of the n tokens at least, so one among the first n - that + 1 under any order."""
    return n - (n * num + den - 1) // den + 1


def order_keys(s: np.ndarray, frequent: np.ndarray, frequency: np.ndarray, order: int) -> np.ndarray:
    """Tokens by frequency class, then by the order's own shuffle. The key is the token's place in the order."""
    rank = np.zeros(len(s), dtype=U)
    if len(frequent):
        at = np.searchsorted(frequent, s)
        at[at == len(frequent)] = 0
        rank = np.where(frequent[at] == s, frequency[at], 0).astype(U)
    return (rank << U(58)) | (mix(s, 3 + order) >> U(6))


def block_links(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, orders: int, halves: np.ndarray | None = None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the sets that suffice to connect all that are connected: (id, id). halves: if given, only pairs of
    sets from different halves are wanted, other links being found elsewhere. labels: sets with equal ones are connected already."""
    sizes = np.array([len(s) for s in sets])
    m = len(sets)
    by = np.lexsort((ids, sizes))
    ids, sizes, sets = ids[by], sizes[by], [sets[i] for i in by]
    side = None if halves is None else halves[by]
    of = np.repeat(np.arange(m), sizes)
    tokens, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    inv = inv.ravel()
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def postings(doc: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = np.argsort(tok, kind="stable")
        return doc[o], np.concatenate([[0], np.cumsum(np.bincount(tok, minlength=len(tokens)))])

    all_doc, all_at = postings(of, inv)
    wanted = prefix_length(sizes, num, den)
    filters = []
    for k in range(orders):
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[np.lexsort((mix(tokens, 3 + k), df))] = np.arange(len(tokens))
        o = np.lexsort((rank[inv], of))
        first = np.arange(len(of)) - np.repeat(starts[:-1], sizes) < np.repeat(wanted, sizes)
        doc, tok = of[o][first], inv[o][first]
        listed, at = postings(doc, tok)
        filters.append((tok, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=m))]), listed, at))
    comp, links = np.arange(m) if labels is None else np.unique(labels[by], return_inverse=True)[1].ravel(), []
    if (comp == comp[0]).all():
        return links
    for x in range(1, m):
        maybe = None
        low = int(np.searchsorted(sizes[:x], -(-int(sizes[x]) * num // den)))
        if low == x:
            continue
        for tok, own, listed, at in filters:
            hit = np.zeros(m, dtype=bool)
            for t in tok[own[x] : own[x + 1]]:
                if at[t + 1] - at[t] > 1:
                    hit[listed[at[t] : at[t + 1]]] = True
            maybe = hit if maybe is None else maybe & hit
        found = low + np.flatnonzero(maybe[low:x])
        if side is not None:
            found = found[side[found] != side[x]]
        found = found[comp[found] != comp[x]]
        if not len(found):
            continue
        mine = inv[starts[x] : starts[x + 1]]
        shared = np.bincount(np.concatenate([all_doc[all_at[t] : all_at[t + 1]] for t in mine[df[mine] > 1]]), minlength=m)[found]
        for y in found[den * shared >= num * (sizes[x] + sizes[found] - shared)]:
            if comp[y] != comp[x]:
                links.append((int(ids[x]), int(ids[y])))
                comp[comp == comp[y]] = comp[x]
    return links


def _set_array(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)), pa.array(flat))


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, orders: int = 3,
    few: int = 32, often: int = 3, most_frequent: int = 1 << 20, part_tokens: int = 300_000, long_list: int = 1_000, id_bits: int = 64, salt: int = 0, tag: Column | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id; with ``tag`` (a string column that tells rows of one id apart) also tag, and
    component, a number of the component (null without a set), which ids that repeat don't confuse.

    A set is the distinct n-grams of words (A-Z lowered; white space: the six characters), with fewer words the whole
    sequence; sets link when den * |intersection| >= num * |union|. component_id: the smallest id reachable. Null or empty texts,
    or those without words, have no set and link with nothing (component: their own id). Repeated rows and equal sets are one node and link at any threshold.
    Other columns are ignored; an empty table gives an empty result; texts of any length are hashed whole, a slice at a time.
    No link is lost: ``few`` (nodes a token may have before its pairs are left to a block), ``often`` (count within a task from which
    a token's count is reported), ``most_frequent`` (counts that are broadcast, 16 bytes each), ``part_tokens`` (tokens of a block's part)
    and ``long_list`` (nodes of a list that is searched for ties) change only the order of the work. Different sets never
    share a node: identities have ``id_bits`` bits, a second hash of 64 bits tells if two sets share one, and then all is done
    again with another ``salt``.
    """
    spark = docs.sparkSession
    make_importable(spark)
    tagged = tag is not None
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([tag.alias("tag")] if tagged else []))

    names = ["doc_id", "n", "key", "proof", "token", "fresh", "sketch", *["tag"] * tagged]
    node_of = lambda s: identity(s, salt) >> (64 - id_bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, held, size = Shingler(n), set(), [], 0

        def counts() -> pa.RecordBatch:
            tokens, c = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            tokens, c = tokens[c >= often].view(np.int64), c[c >= often]
            none = pa.nulls(len(c), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(c.astype(np.int64)), pa.array(tokens), none, pa.array(np.ones(len(c), dtype=bool)), pa.array(np.zeros(len(c), dtype=bool)), pa.nulls(len(c), pa.binary()), *[pa.nulls(len(c), pa.string())] * tagged], names)

        for b in batches:
            sizes, keys, proofs, fresh, sketches = [], [], [], [], []
            for s in shingler.sets(b.column("text")):
                sizes.append(len(s))
                keys.append(node_of(s) if len(s) else 0)
                proofs.append(identity(s, salt, 14) if len(s) else 0)
                fresh.append(len(s) > 0 and keys[-1] not in seen)
                sketches.append(sketch(s) if fresh[-1] else None)
                if fresh[-1]:
                    seen.add(keys[-1])
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(proofs, pa.int64()), pa.array(np.zeros(len(b), dtype=bool)), pa.array(fresh), pa.array(sketches, pa.binary()), *([b.column("tag")] if tagged else [])], names)
            if size > 1_000_000:
                yield counts()
                held, size, seen = [], 0, set()
        yield counts()
        give_back()

    scanned = settle(texts.mapInArrow(scan, "doc_id long, n long, key long, proof long, token boolean, fresh boolean, sketch binary" + ", tag string" * tagged), "ngram-scan")
    nodes = scanned.filter(~F.col("token") & (F.col("n") > 0)).groupBy(F.col("key").alias("sid"))
    nodes = settle(nodes.agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("proof").alias("p"), F.max("proof").alias("q")), "ngram-nodes")
    if not nodes.filter(F.col("p") != F.col("q")).isEmpty():
        discard(scanned, nodes)
        return ngram_jaccard_join(docs, id_col, text_col, n, num, den, orders, few, often, most_frequent, part_tokens, long_list, id_bits, salt + 1, tag)
    counted = scanned.filter("token").groupBy("key").agg(F.sum("n").alias("c")).filter(F.col("c") > few)
    top = counted.orderBy(F.desc("c"), "key").limit(most_frequent).toPandas()
    frequent, frequency = top["key"].to_numpy(dtype=np.int64).view(U), np.minimum(63, np.log2(top["c"].to_numpy(dtype=float) + 1)).astype(np.int64)
    o = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[o], frequency[o]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(n), set()
        known, rank = shared.value
        for b in batches:
            ids, sizes, keys = [], [], [[] for _ in range(orders)]
            for s in shingler.sets(b.column("text")):
                if not len(s) or (i := node_of(s)) in seen:
                    continue
                seen.add(i)
                ids.append(i)
                sizes.append(len(s))
                p = prefix_length(len(s), num, den)
                for k in range(orders):
                    own = order_keys(s, known, rank, k)
                    keys[k].append(np.partition(own, p - 1)[:p] if p < len(own) else own)
            if len(seen) > 500_000:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *[_set_array(k) for k in keys]], ["sid", "n", *[f"k{k}" for k in range(orders)]])
        give_back()

    pre = texts.select("text").mapInArrow(prefixes, "sid long, n long, " + ", ".join(f"k{k} array<long>" for k in range(orders)))
    exploded = pre.select("sid", F.col("n").cast("int").alias("n"), F.posexplode(F.array(*[F.col(f"k{k}") for k in range(orders)])).alias("k", "keys"))
    rows = exploded.select("sid", "n", F.col("k").cast("byte").alias("k"), F.explode("keys").alias("key"))
    w = Window.partitionBy("key", "k")
    listed = rows.select("*", F.count(F.lit(1)).over(w).alias("many"), F.min("sid").over(w).alias("low"), F.max("sid").over(w).alias("high"))
    ahead = F.collect_list(F.struct("n", "sid")).over(w.orderBy("n", "sid").rowsBetween(1, few))  # a list of few has no more
    listed = listed.filter(F.col("low") < F.col("high")).select("key", "k", "sid", "n", "many", "low", ahead.alias("ahead"))
    no = F.lit(None).cast("long")
    pairs = F.transform(
        F.filter("ahead", lambda y: (F.col("n") * den >= y["n"].cast("long") * num) & (F.col("sid") != y["sid"])),
        lambda y: F.struct("k", F.least("sid", y["sid"]).alias("a"), F.greatest("sid", y["sid"]).alias("b"), no.alias("key"), no.alias("n"), no.alias("head")),
    )
    head = F.when(F.col("many") > long_list, F.col("low"))
    alone = F.array(F.struct("k", F.col("sid").alias("a"), no.alias("b"), "key", F.col("n").cast("long").alias("n"), head.alias("head")))
    lists = settle(listed.select(F.explode(F.when(F.col("many") <= few, pairs).otherwise(alone)).alias("e")).select("e.*"), "ngram-lists")
    pairs = lists.filter(F.col("b").isNotNull()).select("a", "b", F.expr("shiftleft(1, cast(k as int))").alias("bit"))
    crowded = lists.filter(F.col("b").isNull()).select("key", "k", F.col("a").alias("sid"), "n", "head")
    excused = crowded.groupBy("sid").agg(F.bit_or(F.expr("shiftleft(1, cast(k as int))")).alias("x"))
    found = pairs.groupBy("a", "b").agg(F.bit_or("bit").alias("bits"))
    for side in ("a", "b"):  # what a crowded token would have shown isn't asked of the pair
        found = found.join(excused.select(F.col("sid").alias(side), F.col("x").alias(f"x_{side}")), side, "left")
    excuse = F.coalesce("x_a", F.lit(0)).bitwiseAND(F.coalesce("x_b", F.lit(0)))
    agreed = settle(found.filter(F.col("bits").bitwiseOR(excuse) == 2**orders - 1).select("a", "b"), "ngram-agreed")
    first = crowded.filter(F.col("k") == 0)  # one order suffices to find what a list ties
    heads = first.filter(F.col("head") != F.col("sid")).select(F.col("head").alias("a"), F.col("sid").alias("b")).distinct()
    listed = first.filter(F.col("head").isNull()).select("key", "sid", "n").distinct()
    asked = agreed.select(F.col("a").alias("key")).unionByName(agreed.select(F.col("b").alias("key"))).unionByName(listed.select(F.col("sid").alias("key"))).distinct()
    known = scanned.filter("fresh").select("key", "n", "sketch").join(asked, "key", "left_semi")
    sketches = settle(known.dropDuplicates(["key"]).select(F.col("key").alias("sid"), F.col("n").alias("size"), "sketch"), "ngram-sketches")
    possible = agreed
    for side in ("a", "b"):
        possible = possible.join(sketches.select(F.col("sid").alias(side), F.col("size").alias(f"n_{side}"), F.col("sketch").alias(f"c_{side}")), side)
    possible = possible.mapInArrow(lambda batches: _possible(batches, num, den), "a long, b long")
    tied = _by_key(listed.join(sketches.drop("size"), "sid").select("key", "n", "sid", "sketch"), ["key"], "a long, b long", lambda key, rows: _ties_of(rows, num, den))
    blocks = settle(connected_components(possible.unionByName(tied).unionByName(heads)), "ngram-blocks")
    discard(lists, agreed, sketches)

    placed = blocks.withColumnRenamed("node", "sid").join(nodes.select("sid", "least_id", "n"), "sid")
    cells = placed.groupBy("component").agg(F.sum("n").alias("tokens")).select("component", F.ceil(F.col("tokens") / part_tokens).cast("int").alias("parts"))
    placed = settle(placed.join(cells, "component").select("sid", "n", "component", "parts", "least_id", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part")), "ngram-placed")
    work = _Links(texts, n, num, den, orders, node_of, part_tokens)
    labels = connected_components(work.of(placed))
    labels = settle(labels.select(F.col("node").alias("sid"), F.col("component").alias("label")), "ngram-labels")
    discard(blocks, placed, *work.tables)
    named = nodes.select("sid", "least_id", "rows").join(labels, "sid", "left")
    tied = named.filter(F.col("label").isNotNull())
    least = tied.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    tied = look_up(tied.select("sid", "label", "rows"), least, "label", "nodes", F.col("sid")).select(F.col("sid").alias("key"), "component_id", F.col("label").alias("component"), "rows")
    alone = named.filter(F.col("label").isNull()).select(F.col("sid").alias("key"), F.col("least_id").alias("component_id"), F.col("sid").alias("component"), "rows")
    owner = settle(tied.unionByName(alone), "ngram-owners")
    discard(nodes, labels)
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *["tag", "component"] * tagged]
    rows = scanned.filter(~F.col("token")).select("doc_id", "n", "key", *["tag"] * tagged)
    empty = rows.filter(F.col("n") == 0).withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    return look_up(rows.filter(F.col("n") > 0), owner, "key", "rows", F.xxhash64("doc_id")).select(*columns).unionByName(empty.select(*columns))


#: Words of the bitmap that tells which documents a block needs: 64 bits each, so 2 MB whatever the input.
BITMAP_WORDS = 1 << 18


class _Links:
    """Links among the sets of blocks, placed(sid, n, component, parts, part, least_id)."""

    def __init__(self, texts: DataFrame, n: int, num: int, den: int, orders: int, node_of: Callable[[np.ndarray], int], part_tokens: int):
        self.texts, self.n, self.num, self.den, self.orders, self.node_of, self.part_tokens = texts, n, num, den, orders, node_of, part_tokens
        self.tables: list[DataFrame] = []

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(settle(df, name))
        return self.tables[-1]

    def of(self, placed: DataFrame) -> DataFrame:
        """(a, b): the links that connect all that are connected."""
        one = F.col("parts") == 1
        links = self.settled(self.met(self.sets(placed.filter(one)), "component", "part"), "ngram-links")
        if placed.filter(~one).isEmpty():
            return links
        # Blocks of several parts: links within each part, then among the first sets of the groups found, which are dealt anew.
        sets = self.settled(self.sets(placed.filter(~one)), "ngram-sets")
        inner = self.settled(self.met(sets, "component", "part"), "ngram-links")
        groups = self.settled(connected_components(inner), "ngram-groups")
        label = F.coalesce("label", "sid").alias("label")
        named = placed.filter(~one).join(groups.select(F.col("node").alias("sid"), F.col("component").alias("label")), "sid", "left").select("sid", "n", "component", "parts", "part", label)
        firsts = named.filter(F.col("label") == F.col("sid"))
        fewer = firsts.groupBy("component").agg(F.ceil(F.sum("n") / self.part_tokens).cast("int").alias("parts"))
        dealt = firsts.select("sid", "component").join(fewer, "component").select("sid", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")).cast("int").alias("part"))
        outer = self.settled(self.met(sets.drop("part").join(dealt, "sid"), "component", "part"), "ngram-links")
        # What is left is between the parts, where the labels differ: one of two such sets is outside its block's largest group.
        groups = self.settled(connected_components(inner.unionByName(outer)), "ngram-groups")
        named = placed.filter(~one).select("sid", "n", "component", "parts", "part").join(groups.select(F.col("node").alias("sid"), F.col("component").alias("label")), "sid", "left")
        named = self.settled(named.withColumn("label", F.coalesce("label", "sid")), "ngram-named")
        largest = named.groupBy("component", "label").agg(F.sum("n").alias("tokens")).groupBy("component").agg(F.max_by("label", F.struct("tokens", "label")).alias("largest"))
        rest = named.join(largest, "component").filter(F.col("label") != F.col("largest"))
        rest = self.settled(rest.select("sid", "component", "n"), "ngram-rest")
        chunks = rest.groupBy("component").agg(F.ceil(F.sum("n") / self.part_tokens).cast("int").alias("chunks"))
        left = sets.join(named.select("sid", "label"), "sid").join(chunks, "component")
        series = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        at_home = left.select("component", "part", F.explode(series("chunks")).alias("chunk"), F.lit(0).alias("side"), "label", "sid", "tokens")
        visiting = left.join(rest.select("sid"), "sid").select("component", F.col("part").alias("home"), F.pmod(F.xxhash64("sid", F.lit(2)), F.col("chunks")).cast("int").alias("chunk"), "label", "sid", "tokens", F.explode(series("parts")).alias("part"))
        visiting = visiting.filter(F.col("part") != F.col("home")).select("component", "part", "chunk", F.lit(1).alias("side"), "label", "sid", "tokens")
        across = self.settled(self.met(at_home.unionByName(visiting), "component", "part", "chunk"), "ngram-links")
        return links.unionByName(inner).unionByName(outer).unionByName(across)

    def sets(self, placed: DataFrame) -> DataFrame:
        """sid, tokens, component, parts, part. One more scan; texts that no block needs aren't hashed."""
        spark, n, node_of = self.texts.sparkSession, self.n, self.node_of
        place = F.pmod(F.xxhash64("least_id"), F.lit(BITMAP_WORDS * 64))
        words = placed.select(place.alias("h")).groupBy((F.col("h") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits")).toPandas()
        bitmap = np.zeros(BITMAP_WORDS, dtype=np.int64)
        bitmap[words["w"].to_numpy(dtype=int)] = words["bits"].to_numpy(dtype=np.int64)
        shared = spark.sparkContext.broadcast(bitmap.view(U))
        hashed = self.texts.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_WORDS * 64)).alias("h"))

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, bits = Shingler(n), shared.value
            for b in batches:
                h = b.column("h").to_numpy(zero_copy_only=False).astype(U)
                part = b.filter(pa.array((bits[h >> U(6)] >> (h & U(63))) & U(1) == 1))
                sets = [s for s in shingler.sets(part.column("text")) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "tokens"])
            give_back()

        return hashed.mapInArrow(needed, "sid long, tokens binary").join(placed.select("sid", "component", "parts", "part"), "sid")

    def met(self, sets: DataFrame, *keys: str) -> DataFrame:
        """Links among the sets that share these keys; between sets of different sides and labels, where there are such columns."""
        num, den, orders = self.num, self.den, self.orders
        sided = "side" in sets.columns

        def links(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
            held = {row[-2]: (*row[len(key) : -2], np.frombuffer(row[-1], dtype=U)) for row in rows}
            if len(held) < 2:
                return []
            side, label = (np.array(x) for x in zip(*(v[:2] for v in held.values()), strict=True)) if sided else (None, None)
            if sided and (side == side[0]).all():
                return []
            return block_links(np.array(list(held), dtype=np.int64), [v[-1] for v in held.values()], num, den, orders, side, label)

        return _by_key(sets.select(*keys, *(["side", "label"] * sided), "sid", "tokens"), list(keys), "a long, b long", links)


def _ties_of(rows: list[tuple], num: int, den: int) -> list[tuple[int, int]]:
    _, sizes, ids, sketches = zip(*rows, strict=True)
    return list_ties(np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64), list(sketches), num, den)


def _by_key(df: DataFrame, keys: list[str], schema: str, work: Callable[[tuple, list[tuple]], list[tuple]]) -> DataFrame:
    """work(key, rows) for each key's rows (the keys are the first columns), one key in memory at a time; longs come out."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))], names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[: len(keys)] != key:
                    if held:
                        out += work(key, held)
                    key, held = row[: len(keys)], []
                held.append(row)
            if len(out) > 10_000:
                yield batch()
                out.clear()
        if held:
            out += work(key, held)
        yield batch()
        give_back()

    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word shingles are 90 % alike. Odd rows as in ngram_jaccard_join."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE_CLASS}+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (t) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT g.doc_id, any_value(len(g.g)) AS n_shingles, min(r.to_id) AS component_id FROM g JOIN r USING (doc_id) GROUP BY g.doc_id
"""
