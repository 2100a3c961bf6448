"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's segmentations form a lattice over the pieces. Each has a weight, the product of its pieces' weights, and all
together a tree: unit by unit (a word with the spaces before it; no piece crosses from one to the next), and within a unit from its last piece back. Perturbed
A-star search over that tree: every subtree's bound is the largest Gumbel-perturbed log-probability in it, drawn top down,
and the heap's best subtree is opened next. Its leaves come out as k distinct segmentations, sampled without replacement.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_importable, table, with_columns

U = np.uint64
_UNITS = re.compile(r" *[^ ]+| +")
#: The same, but also cut between a letter and a comma or full stop after it.
_CUT_UNITS = re.compile(r" *(?:[^ .,]|(?<![^\W\d_])[.,])+|[.,](?:[^ .,]|(?<![^\W\d_])[.,])*| +")
_SPACE = "▁"


class Pieces:
    """A SentencePiece vocabulary as a byte trie with log-weights; texts keep their spaces as bytes.

    Pieces are weighted by Zipf's law over their rank in the file, -alpha * log(rank + 2), as its scores are ranks. A
    character without a piece of its own is spelt by byte pieces. U+2581 in a text is spelt so too, and decodes to itself.
    """

    kept: ClassVar[dict[tuple[str, float], Pieces]] = {}

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text_of: list[bytes] = [b""] * n
        crossing = any(re.search(r"[^\W\d_][.,]", sp.id_to_piece(i)) for i in range(n))
        self.units = _UNITS if crossing else _CUT_UNITS  # no piece may go from one unit to the next
        self.byte_id = np.zeros(256, dtype=np.int32)
        words: dict[bytes, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text_of[i] = piece.replace(_SPACE, " ").encode()
                words[self.text_of[i]] = (i, -alpha * float(np.log(abs(sp.get_score(i)) + 2)))
        self.byte_weight = -alpha * float(np.log(n + 2))
        nodes: list[dict[int, int]] = [{}]
        self.ends, self.weights, self.single = [-1], [0.0], set()
        for text, (i, w) in words.items():
            at = 0
            for c in text:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    self.ends.append(-1)
                    self.weights.append(0.0)
                at = nodes[at][c]
            self.ends[at], self.weights[at] = i, w
            if len(text.decode()) == 1:
                self.single.add(text)
        inner = [k for k, to in enumerate(nodes) if to]
        row = np.full(len(nodes), 0, dtype=np.int32)  # row 0: nothing follows
        row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.full((len(inner) + 1, 256), -1, dtype=np.int32)
        for k in inner:
            for c, to in nodes[k].items():
                self.next[row[k], c] = to
        self.row, self.ends, self.weights = row, np.array(self.ends, dtype=np.int32), np.array(self.weights)

    @classmethod
    def of(cls, path: str, alpha: float) -> Pieces:
        if (path, alpha) not in cls.kept:
            cls.kept[path, alpha] = cls(path, alpha)
        return cls.kept[path, alpha]

    def decode(self, ids: list[int]) -> str:
        """The text of any of its segmentations, exactly."""
        raw = b"".join(self.text_of[i] for i in ids)[1:]
        try:
            return raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")


class _Column:
    """An array that grows at its end by doubling."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1024, dtype=kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.size + len(x) > len(self.room):
            more = np.zeros(2 * (self.size + len(x)), dtype=self.room.dtype)
            more[: self.size] = self.room[: self.size]
            self.room = more
        self.room[self.size : self.size + len(x)] = x
        self.size += len(x)


class Lattices:
    """Units' lattices side by side in arrays. A unit of n bytes has n + 1 nodes; edges are sorted by the node they end in,
    longest first. cum and logp: the chance to come by an edge, given its end, summed up within the node, and its log."""

    kept: ClassVar[dict[int, Lattices]] = {}

    @classmethod
    def of(cls, pieces: Pieces) -> Lattices:
        """One for each vocabulary in a worker, kept from task to task."""
        if id(pieces) not in cls.kept:
            cls.kept[id(pieces)] = cls(pieces)
        return cls.kept[id(pieces)]

    def __init__(self, pieces: Pieces, memory: int = 500_000):
        self.pieces, self.memory = pieces, memory
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.columns = {k: _Column(t) for k, t in (("first", np.int32), ("last", np.int32), ("into", np.int32), ("source", np.int32), ("piece", np.int32), ("cum", np.float32), ("logp", float))}
        self._show()

    def _show(self) -> None:
        for k, c in self.columns.items():
            setattr(self, k, c.room[: c.size])

    def ids(self, units: list[str]) -> np.ndarray:
        new = set(units).difference(self.known)
        if len(self.known) + len(new) > self.memory:
            self.forget()
            new = set(units)
        if new:
            self._add(list(new))
        return np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=len(units))

    def _add(self, units: list[str]) -> None:
        p, raw = self.pieces, [u.encode("utf-8", "surrogatepass") for u in units]
        sizes = np.array([len(r) for r in raw])
        joined = b"".join(raw)
        data = np.frombuffer(joined, dtype=np.uint8)
        unit = np.repeat(np.arange(len(raw)), sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        node = np.arange(len(data)) + unit  # node of each byte's start; a unit's last node has no byte
        room = starts[1:][unit] - np.arange(len(data))  # bytes left in the unit
        flat, rows = p.next.ravel(), p.row * np.int32(256)
        at, state, depth, edges = np.arange(len(data)), np.zeros(len(data), dtype=np.int32), 0, []
        while len(at):
            state = flat.take(rows.take(state) + data[at + depth])
            go = state >= 0
            at, state, depth = at[go], state[go], depth + 1
            hit = p.ends[state] >= 0
            edges.append((node[at[hit]], node[at[hit]] + depth, p.ends[state[hit]], p.weights[state[hit]]))
            go = room[at] > depth
            at, state = at[go], state[go]
        lone = self._spelt(units, joined)
        edges.append((node[lone], node[lone] + 1, p.byte_id[data[lone]], np.full(len(lone), p.byte_weight)))
        source, end, piece, weight = (np.concatenate(x) for x in zip(*edges[::-1], strict=True))
        total = len(data) + len(raw)
        begin = starts[:-1] + np.arange(len(raw))
        level_of = np.arange(total) - np.repeat(begin, sizes + 1)
        o = np.argsort(end, kind="stable")
        source, end, piece, weight = source[o], end[o], piece[o], weight[o]
        alpha = np.full(total, -np.inf)
        alpha[begin] = 0.0
        levels = level_of[end]
        by = np.argsort(levels.astype(np.uint16) if levels.size and levels.max() < 1 << 16 else levels, kind="stable")  # short keys sort by radix
        cuts = np.concatenate([[0], np.cumsum(np.bincount(levels))])
        for low, high in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
            e = by[low:high]
            if not len(e):
                continue
            v, to = alpha[source[e]] + weight[e], end[e]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(v, head)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                alpha[to[head]] = safe + np.log(np.add.reduceat(np.exp(v - np.repeat(safe, np.diff(np.append(head, len(e))))), head))
        with np.errstate(invalid="ignore"):
            logp = alpha[source] + weight - alpha[end]
        logp = np.where(np.isnan(logp), -np.inf, np.minimum(logp, 0.0))
        chance = np.exp(logp)
        into = np.searchsorted(end, np.arange(total + 1))
        sums = np.concatenate([[0.0], np.cumsum(chance)])
        into_col = self.columns["into"]
        into_col.size = max(0, into_col.size - 1)  # the last says where the edges end
        base_node, base_edge, base_unit = into_col.size, len(self.source), len(self.known)
        self.known.update(zip(units, range(base_unit, base_unit + len(units)), strict=True))
        new = {"first": begin + base_node, "last": begin + sizes + base_node, "into": into + base_edge, "source": source + base_node, "piece": piece}
        new |= {"cum": sums[1:] - sums[into[end]], "logp": logp}
        for k, x in new.items():
            self.columns[k].add(x)
        self._show()

    def _spelt(self, units: list[str], data: bytes) -> np.ndarray:
        """Places of the bytes of characters that are no piece."""
        unknown = [e for c in set("".join(units)) if (e := c.encode("utf-8", "surrogatepass")) not in self.pieces.single]
        if not unknown:
            return np.zeros(0, dtype=np.int64)
        found = re.finditer(b"|".join(map(re.escape, unknown)), data)  # no character's bytes begin within another's
        return np.fromiter((at for m in found for at in range(m.start(), m.end())), dtype=np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(seed: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's seed, the place in its text and the stream alone."""
    x = _mix(seed ^ _mix(place.astype(U) + U(stream * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Sampler:
    def __init__(self, lattices: Lattices):
        self.l = lattices

    def paths(self, units: np.ndarray, seed: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
        """One sampled path for each unit occurrence: edges, each unit's from its last piece back, and where units start."""
        lat = self.l
        node, active, step, levels = lat.last[units], np.arange(len(units)), 0, []
        stop = lat.first[units]
        while len(active):
            u = uniform(seed[active], np.array([step]), stream)
            e = lat.into[node]
            last = lat.into[node + 1] - 1
            more = np.flatnonzero((u > lat.cum[e]) & (e < last))
            while len(more):
                e[more] += 1
                more = more[(u[more] > lat.cum[e[more]]) & (e[more] < last[more])]
            levels.append((active, e))
            node = lat.source[e]
            go = node != stop[active]
            active, node, step = active[go], node[go], step + 1
        count = np.bincount(np.concatenate([a for a, _ in levels]), minlength=len(units)) if levels else np.zeros(len(units), np.int64)
        starts = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(starts[-1], dtype=np.int64)
        for t, (a, e) in enumerate(levels):
            out[starts[a] + t] = e
        return out, starts


def gumbel_top_k(texts: list[str], seeds: np.ndarray, lattices: Lattices, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its k sampled segmentations at most: (piece ids, log-probability, perturbed value, log inclusion score).

    The inclusion score is 1 - exp(-exp(logp - kappa)), kappa being the best perturbed value that isn't among the k;
    log-probability over inclusion score gives unbiased weights. Fewer than k come out only if there are no more.
    """
    cut = [lattices.pieces.units.findall(" " + t) if t else [] for t in texts]
    counts = np.array([len(c) for c in cut])
    units = lattices.ids([u for c in cut for u in c])
    text_of, begins = np.repeat(np.arange(len(texts)), counts), np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(units)) - begins[text_of]
    seed = _mix(seeds[text_of] ^ _mix(place.astype(U) + U(1)))
    sampler = Sampler(lattices)
    fresh = [sampler.paths(units, seed, stream) for stream in range(k)]
    draws = [np.log(-np.log(uniform(seeds[:, None], np.arange(NEAR)[None], 1_000 + n))) for n in range(k)]
    top = -np.log(-np.log(uniform(seeds, np.zeros(len(seeds)), 999)))
    out = []
    for i in range(len(texts)):
        if not counts[i]:
            out.append([(np.zeros(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        a, b = int(begins[i]), int(begins[i + 1])
        search = _Search(lattices, [(e[s[a] : s[b]], s[a : b + 1] - s[a]) for e, s in fresh], units[a:b], int(seeds[i]), [x[i] for x in draws], k)
        out.append(search.run(float(top[i])))
    return out


#: Places of a path whose draws are made for a whole batch at once; more are drawn where they might matter.
NEAR = 256
#: No draw's logarithm is below: uniform() stays 2**-54 away from 1.
LEAST_DRAW = -38.0
_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _one_uniform(seed: int, place: int, stream: int) -> float:
    """uniform() for one number."""
    return ((_mixed(seed ^ _mixed((place + stream * 0x9E3779B97F4A7C15) & _MASK)) >> 11) + 0.5) * 2.0**-53


class _Path:
    """A sampled segmentation: edges in the tree's order and where its units start, log-chances, the value it reached, and the edges that are
    barred at the place where it left its parent (``fixed`` - 1; from ``fixed`` on it went its own way)."""

    __slots__ = ("barred", "edges", "fixed", "logps", "starts", "value")

    def __init__(self, edges: np.ndarray, starts: np.ndarray, logps: np.ndarray, value: float, fixed: int, barred: list[int]):
        self.edges, self.starts, self.logps, self.value, self.fixed, self.barred = edges, starts, logps, value, fixed, barred


class _Search:
    """Perturbed A-star over one text, given unit paths sampled freely for each of the k rounds."""

    def __init__(self, lat: Lattices, fresh: list[tuple[np.ndarray, np.ndarray]], units: np.ndarray, seed: int, draws: list[np.ndarray], k: int):
        self.lat, self.fresh, self.units, self.seed, self.draws, self.k = lat, fresh, units, seed, draws, k
        self.heap: list[tuple[float, int, int]] = []  # (-bound, path, place): what else branches off at that place of that path
        self.paths: list[_Path] = []

    def run(self, value: float) -> list[tuple[np.ndarray, float, float, float]]:
        self.reach(*self.fresh[0], value, 0, [])
        while self.heap and len(self.paths) < self.k:
            self.branch(*heapq.heappop(self.heap))
        kappa = -self.heap[0][0] if self.heap else -np.inf
        out = []
        for p in self.paths:
            size = np.diff(p.starts)
            order = np.repeat(p.starts[:-1] + p.starts[1:] - 1, size) - np.arange(len(p.edges))  # each unit from its first piece on
            logp = float(p.logps.sum())
            x = logp - kappa
            out.append((self.lat.piece[p.edges[order]], logp, p.value, 0.0 if x > 4 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x))
        return out

    def reach(self, edges: np.ndarray, starts: np.ndarray, value: float, fixed: int, barred: list[int]) -> None:
        """A leaf of this value; the places from ``fixed`` on get bounds under it, the place before it what its barred edges leave."""
        n, logps = len(self.paths), self.lat.logp[edges]
        first, wide, k = max(0, fixed - 1), NEAR - 1, self.k
        above = float(logps[:fixed].sum())
        while True:  # places further on have too little mass to be among the next k, whatever they draw
            part = logps[fixed : fixed + wide]
            before = np.cumsum(part)
            before += above
            with np.errstate(divide="ignore"):
                mass = np.log1p(-np.exp(part))
            mass[1:] += before[:-1]
            mass[:1] += above
            if fixed:
                left = 1.0 - sum(math.exp(self.lat.logp[e]) for e in barred)
                mass = np.concatenate([[above - logps[fixed - 1] + math.log(left) if left > 1e-12 else -np.inf], mass])
            draw = self.draws[n][: len(mass)] if len(mass) <= NEAR else np.log(-np.log(uniform(np.full(len(mass), self.seed, dtype=U), np.arange(len(mass)), 1_000 + n)))
            x = draw - mass
            best = np.argpartition(x, k)[: k + 1] if len(x) > k + 1 else np.arange(len(x))
            best = best[x[best].argsort(kind="stable")]
            if fixed + wide >= len(edges) or len(best) > k and x[best[-1]] < LEAST_DRAW - before[-1]:
                break
            wide *= 4
        for j, v in zip(best.tolist(), x[best].tolist(), strict=True):
            if v < math.inf:
                low, high = (-value, v) if -value < v else (v, -value)
                heapq.heappush(self.heap, (high + math.log1p(math.exp(low - high)), n, first + j))
        self.paths.append(_Path(edges, starts, logps, value, fixed, barred))

    def branch(self, bound: float, n: int, at: int) -> None:
        """Leave path n at a place by an edge that isn't barred there, and go on freely."""
        lat, p = self.lat, self.paths[n]
        u = int(p.starts.searchsorted(at, "right")) - 1
        barred = list(p.barred) if p.fixed and at == p.fixed - 1 else [int(p.edges[at])]
        node = int(lat.last[self.units[u]]) if at == p.starts[u] else int(lat.source[p.edges[at - 1]])
        own, stop, step = [], int(lat.first[self.units[u]]), 0
        while node != stop:
            low, high = int(lat.into[node]), int(lat.into[node + 1])
            chance = [math.exp(v) for v in lat.logp[low:high].tolist()]
            if not step:
                for e in barred:
                    chance[e - low] = 0.0
            x, e = _one_uniform(self.seed, step, 2_000 + len(self.paths)) * sum(chance), -1
            for j, c in enumerate(chance):
                if c > 0:
                    e, x = low + j, x - c
                    if x < 0:
                        break
            if e < 0:
                return
            own.append(e)
            node, step = int(lat.source[e]), step + 1
        edges, starts = self.fresh[len(self.paths)]
        joined = np.concatenate([p.edges[:at], own, edges[starts[u + 1] :]]).astype(np.int64)
        shift = at + len(own) - int(starts[u + 1])
        self.reach(joined, np.concatenate([p.starts[: u + 1], starts[u + 1 :] + shift]), -bound, at + 1, [*barred, own[0]])


def sample_segmentations(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, alpha: float = 1.0, seed: int = 0, with_ids: bool = False
) -> DataFrame:
    """doc_id, sample (from 1, in order of the perturbed values), n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, and
    with ``with_ids`` the ids, which Pieces.decode turns back into the text. No shuffle; whole texts.

    Samples depend on the row's key (its id), ``seed`` and the text alone, so repeated rows get equal samples. Null or empty text
    has one segmentation, without pieces. Fewer than k rows come out of a text with fewer segmentations. Texts of any length are sampled whole; null ids
    stay null and are seeded alike. Other columns are ignored. An empty table gives an empty result.
    """
    make_importable(docs.sparkSession)
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.of(model_file, alpha)
        lattices = Lattices.of(pieces)
        for rows in batches:
            out, size, low = [], np.cumsum(rows["text"].str.len().to_numpy()), 0
            while low < len(rows):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + 1_000_000, "right")))
                part = rows.iloc[low:high]
                low = high
                seeds = part["key"].to_numpy().astype(np.int64).view(U)
                for doc, none, found in zip(part["doc_id"].tolist(), part["none"], gumbel_top_k(part["text"].tolist(), seeds, lattices, k), strict=True):
                    for n, (ids, logp, value, inclusion) in enumerate(found, 1):
                        out.append((None if none else doc, n, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), logp, value, inclusion, *([ids.tolist()] * with_ids)))
            frame = pd.DataFrame([x[1:] for x in out], columns=names[1:])
            frame.insert(0, "doc_id", pd.array([x[0] for x in out], dtype="Int64"))
            yield frame

    doc = F.col(id_col).cast("long")
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    return docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("none"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, schema)


def decode_pieces(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text that the ids of each row spell, whatever their segmentation: encoding's exact inverse.

    No ids are the empty text, null ids null; an id beyond the vocabulary is an error. Bytes that are no UTF-8 (ids that no text gave) come out as
    replacement characters. Rows of any length and repeated rows stay; an input column of the text's name gives way. An empty table gives an empty result.
    """
    make_importable(rows.sparkSession)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces.of(model_file, 1.0)
        for p in parts:
            yield pd.Series([None if ids is None else pieces.decode(ids) for ids in p], dtype=object)

    return with_columns(rows, {text_col: decode(F.col(ids_col))})


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def segmentation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_sha256 of the text decoded from each document's first sample."""
    sampled = sample_segmentations(table(spark, sf_dir, "documents"), default_model(), k=1, with_ids=True)
    return decode_pieces(sampled, default_model()).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


ROUND_TRIP_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents"


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every document's whole text. Odd rows as in sample_segmentations."""
    return sample_segmentations(table(spark, sf_dir, "documents"), default_model())
