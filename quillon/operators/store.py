"""Collections as Parquet in hash buckets: create, upsert, partial update, export, snapshot, drop, status, resume."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import as_list, strip

#: The column, and in the names of folders, that says which bucket a row is in.
BUCKET = "store_bucket"
#: The column that says, while a bucket's parts are read, which of them a row is from.
PART = "store_part"


def latest(rows: DataFrame, key: str | Sequence[str], order: Sequence[str], part: str | None = None) -> DataFrame:
    """One row of each key: the last in ``order`` (last write wins); of rows that are alike in it the last by the column ``part``, if given; those that are alike
    in that too go by a hash of all they hold, so the choice doesn't depend on the plan."""
    keys = [key] if isinstance(key, str) else list(key)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if c != part and not t.startswith(("map", "variant"))])
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *([F.desc(part)] if part else []), F.desc(whole))
    return rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") == 1).drop("__k")


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str], batch_col: str | Sequence[str] = "batch") -> DataFrame:
    """old with new rows added or put in their place; of several, the highest batch wins, or the last in an order of columns."""
    return latest(old.unionByName(new, allowMissingColumns=True), key, [batch_col] if isinstance(batch_col, str) else batch_col)


def partial_update(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """old with the given columns replaced where new has the key and a value; keys that only new has are left out. Of a key's new rows the
    last in the order of the columns counts, so no row of old is doubled."""
    new = latest(new.select(key, *columns), key, columns)
    n = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(n, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Order-preserving distinct."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") == 1).drop("__k")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the processed ones."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def status(points: DataFrame, expected: DataFrame, name: str = "collection") -> DataFrame:
    """collection, points, missing: every expected collection, and others that are there."""
    have = points.groupBy(name).agg(F.count(F.lit(1)).alias("points"))
    want = expected.select(F.col(name)).distinct().withColumn("__want", F.lit(True))
    return have.join(want, name, "full").select(name, F.coalesce("points", F.lit(0)).alias("points"), F.col("points").isNull().alias("missing"))


#: Buckets of a new collection: aim at a few hundred MB each, as one task folds a bucket. Tables of the past that readers may still be reading.
BUCKETS, KEEP = 64, 3
#: A bucket is folded when what was added to it is this share of its first part, or when it has more than so many parts.
FOLD_SHARE, MOST_PARTS = 0.5, 16


@dataclass(frozen=True)
class State:
    """What a commit says of a collection: its number, the buckets it is dealt into, its schema, the order in which the last row of a key wins, and of each
    bucket the parts (folder, bytes), oldest first."""

    number: int = 0
    buckets: int = BUCKETS
    schema: str | None = None
    order: tuple[str, ...] = ()
    parts: dict[int, list[tuple[str, int]]] = field(default_factory=dict)

    def of(self, buckets: Iterable[int] | None = None) -> list[int]:
        return sorted(self.parts if buckets is None else set(buckets) & set(self.parts))


class Store:
    """Collections under one path, each dealt into buckets by a hash of the key.

    An upsert writes the new rows only, as one more part of the buckets that they fall in; a read takes the last row of each key in buckets of several
    parts, and now and then these are folded into one. A change counts once its numbered commit file is there. Its creation is exclusive: of two writers
    one makes the next number, and the other reads that commit and tries again on top of it; it has to do its work again only if
    the parts that it replaces are no longer there. So readers never see half a write, no writer loses another's rows, and a writer that dies leaves
    everything as it was. The last KEEP commits stay readable; what only older ones named is deleted.

    The folder must make a name only once: a rename to a name that is there has to fail, as it does on HDFS; local folders use hard links. Keys of one
    upsert meet in a task a bucket. Only an upsert takes the last row of a key; write() keeps what it is given.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._new_path, self._fs = jvm.Path, jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # names and files

    def _at(self, name: str):
        return self._new_path(f"{self.path}/{name}")

    def _names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def collections(self) -> list[str]:
        root = self._new_path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith("_")) if self._fs.exists(root) else []

    def open_collections(self, system: Sequence[str] = ("_", "."), having: str | None = None) -> list[str]:
        """Collections without a system prefix; with ``having``, those that lack this column yet (or are empty)."""
        names = [n for n in self.collections() if not n.startswith(tuple(system))]
        return names if having is None else [n for n in names if (rows := self.read(n)) is None or having not in rows.columns]

    def create(self, name: str, recreate: bool = False) -> None:
        if recreate:
            self.drop(name)
        self._fs.mkdirs(self._at(f"{name}/commits"))

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    # commits

    def _numbers(self, name: str) -> list[int]:
        return [int(x) for x in self._names(f"{name}/commits") if x.isdigit()]

    def _load(self, name: str, number: int) -> State:
        stream = self._fs.open(self._at(f"{name}/commits/{number:012d}"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return State(number, told["buckets"], told["schema"], tuple(told["order"]), {int(k): [(v, n) for v, n in x] for k, x in told["parts"].items()})

    def state(self, name: str) -> State:
        """The last commit; number 0 if there is none."""
        for _ in range(10):
            numbers = self._numbers(name)
            if not numbers:
                return State(buckets=self.buckets)
            try:
                return self._load(name, numbers[-1])
            except Py4JJavaError as e:  # deleted meanwhile, as later ones have come
                if "FileNotFoundException" not in str(e.java_exception):
                    raise
        raise OSError(f"commits of {name} keep changing")

    def _publish(self, name: str, state: State) -> bool:
        """Make the state's commit file, whole and exclusively; False if its number is taken."""
        told = {"buckets": state.buckets, "schema": state.schema, "order": state.order, "parts": state.parts}
        begun, at = self._at(f"{name}/commits/_{uuid.uuid4().hex}"), self._at(f"{name}/commits/{state.number:012d}")
        out = self._fs.create(begun, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        try:
            if begun.toUri().getScheme() in (None, "file"):
                os.link(begun.toUri().getPath(), at.toUri().getPath())
                return True
            return self._fs.rename(begun, at)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(begun, False)

    def _commit(self, name: str, base: State, made: dict[int, tuple[str, int]], replaced: Iterable[int] = (), schema: str | None = None, order: Sequence[str] | None = None, whole: bool = False) -> bool:
        """Add the parts ``made``, in place of those that ``base`` has of the buckets ``replaced``; with ``whole`` in place of all that is there. Later commits
        than base's stay in force; False if one of them has replaced what is to be replaced here."""
        replaced = set(replaced)
        while True:
            now = self.state(name)
            if not whole and now.number and now.buckets != base.buckets:
                return False
            parts = {} if whole else dict(now.parts)
            for b in replaced | set(made):
                known = base.parts.get(b, []) if b in replaced else []
                if parts.get(b, [])[: len(known)] != known:
                    return False
                own = [*([made[b]] if b in made and b in replaced else []), *parts.get(b, [])[len(known) :], *([made[b]] if b in made and b not in replaced else [])]
                parts.pop(b, None)
                if own:
                    parts[b] = own
            kept = now.order if order is None else tuple(order)
            if self._publish(name, State(now.number + 1, base.buckets, _merged_schema(None if whole else now.schema, schema), kept, parts)):
                self.vacuum(name)
                return True

    def vacuum(self, name: str, keep: int = KEEP) -> None:
        """Delete commits but the last ``keep``, and the parts that only they named. Parts that no commit names yet are another writer's."""
        numbers = self._numbers(name)
        states = {}
        for n in numbers:
            try:
                states[n] = self._load(name, n)
            except Py4JJavaError:  # another writer has deleted it
                continue
        places = lambda s: {(v, b) for b, x in s.parts.items() for v, _ in x}
        live = set().union(*[places(states[n]) for n in numbers[-keep:] if n in states])
        versions = {v for v, _ in live}
        for n in numbers[:-keep]:
            if n in states:
                for v, b in places(states[n]) - live:
                    self._fs.delete(self._at(f"{name}/{v}/{BUCKET}={b}" if v in versions else f"{name}/{v}"), True)
            self._fs.delete(self._at(f"{name}/commits/{n:012d}"), False)

    # rows

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`").cast("string")), F.lit(buckets)).cast("int")

    def _stage(self, name: str, rows: DataFrame, buckets: int) -> dict[int, tuple[str, int]]:
        """Write rows as one part of each of their buckets; of each bucket the folder and the bytes."""
        version = f"v-{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET)
        dealt.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{name}/{version}")
        sizes: dict[int, int] = {}
        files = self._fs.listFiles(self._at(f"{name}/{version}"), True)
        while files.hasNext():
            f = files.next()
            folder = f.getPath().getParent().getName()
            if folder.startswith(f"{BUCKET}="):
                b = int(folder.partition("=")[2])
                sizes[b] = sizes.get(b, 0) + f.getLen()
        return {b: (version, n) for b, n in sizes.items()}

    def _discard(self, name: str, made: dict[int, tuple[str, int]]) -> None:
        for version in {v for v, _ in made.values()}:
            self._fs.delete(self._at(f"{name}/{version}"), True)

    def _rows(self, name: str, state: State, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a state, or of some of its buckets; those of several parts by the last row of each key: of rows that are alike in the order, the one that
        was written last."""
        schema = StructType.fromJson(json.loads(state.schema))
        paths = lambda some, at=0: [f"{self.path}/{name}/{x[at][0]}/{BUCKET}={b}" for b in some if len(x := state.parts[b]) > at]
        own = state.of(buckets)
        single, several = [b for b in own if len(state.parts[b]) == 1], [b for b in own if len(state.parts[b]) > 1]
        frames = []
        if single or not several:
            frames.append(self.spark.read.schema(schema).parquet(*paths(single)) if single else self.spark.createDataFrame([], schema))
        if several:
            parts = [self.spark.read.schema(schema).parquet(*paths(several, k)).withColumn(PART, F.lit(k)) for k in range(max(len(state.parts[b]) for b in several))]
            frames.append(latest(reduce(DataFrame.unionByName, parts), self.key, state.order, PART).drop(PART))
        return reduce(DataFrame.unionByName, frames)

    def read(self, name: str) -> DataFrame | None:
        """The collection's rows as of now; None if it is missing or has none."""
        state = self.state(name)
        return self._rows(name, state) if state.parts else None

    def readable(self, names: Sequence[str]) -> dict[str, DataFrame | None]:
        """Each collection's rows; None for one that is missing, empty, or whose files can't be read (their footers are all looked at), so that one
        broken collection is an empty list to a search over many."""
        out: dict[str, DataFrame | None] = {}
        for name in names:
            try:
                rows = self.read(name)
                if rows is not None:
                    rows.count()
            except (Py4JJavaError, PySparkException):
                if self.spark.sparkContext._jsc.sc().isStopped():
                    raise
                rows = None
            out[name] = rows
        return out

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace all rows, whatever others write meanwhile."""
        self.create(name)
        self._commit(name, State(buckets=self.buckets), self._stage(name, rows, self.buckets), schema=rows.schema.json(), order=(), whole=True)

    def upsert(self, name: str, rows: DataFrame, batch_col: str | Sequence[str] = "batch") -> None:
        """Rows added, or put in the place of those with their key; the last in ``batch_col`` stays. Columns that the collection has are cast to its types,
        others are added to it. An order other than the one of earlier upserts is an error."""
        order = (batch_col,) if isinstance(batch_col, str) else tuple(batch_col)
        self.create(name)
        made: dict[int, tuple[str, int]] = {}
        while True:
            now = self.state(name)
            if now.order and now.order != order:
                raise ValueError(f"rows of {name} are ordered by {now.order}")
            have = {f.name: f.dataType for f in StructType.fromJson(json.loads(now.schema)).fields} if now.schema else {}
            cast = rows.select(*[F.col(f"`{c}`").cast(have[c]).alias(c) if c in have else F.col(f"`{c}`") for c in rows.columns])
            made = self._stage(name, latest(cast, self.key, order), now.buckets)
            if self._commit(name, now, made, schema=cast.schema.json(), order=order):
                break
            self._discard(name, made)
        self.fold(name, made)

    def fold(self, name: str, buckets: Iterable[int] | None = None, share: float = FOLD_SHARE, most: int = MOST_PARTS) -> list[int]:
        """Fold the parts of those buckets to which more than ``share`` of their first part's bytes was added, or that have more than ``most`` parts. If others
        fold them meanwhile, theirs counts."""
        now = self.state(name)
        todo = [b for b in now.of(buckets) if len(x := now.parts[b]) > 1 and (len(x) > most or sum(n for _, n in x[1:]) > share * x[0][1])]
        if todo:
            made = self._stage(name, self._rows(name, now, todo), now.buckets)
            if not self._commit(name, now, made, todo):
                self._discard(name, made)
        return todo

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame], touched: Callable[[State], Iterable[int] | None]) -> None:
        """Make the touched buckets anew from their rows; again if someone else did meanwhile."""
        while (now := self.state(name)).parts:
            some = now.of(touched(now))
            rows = change(self._rows(name, now, some))
            made = self._stage(name, rows, now.buckets)
            if self._commit(name, now, made, some, schema=rows.schema.json()):
                return
            self._discard(name, made)

    def update(self, name: str, rows: DataFrame, columns: Sequence[str]) -> None:
        """partial_update of the buckets that the rows fall in; the others aren't read."""
        touched = lambda s: [r.b for r in rows.select(self._bucket(s.buckets).alias("b")).distinct().collect()]
        self._change(name, lambda old: partial_update(old, rows, self.key, columns), touched)

    def rebuild(self, name: str, change: Callable[[DataFrame], DataFrame], snapshot: str | None = None) -> DataFrame | None:
        """All rows of the collection, changed (by a further column, say), in the place of the old ones; the manifest of a snapshot that is made before, if
        a path for it is given. A missing collection is created empty."""
        if (old := self.read(name)) is None:
            self.create(name)
            return None
        manifest = self._copy(old, snapshot) if snapshot else None
        self._change(name, change, lambda s: None)
        return manifest

    def reingest(self, names: Sequence[str], rows_of: Callable[[str], DataFrame | None], snapshots: str, dry_run: bool = False) -> DataFrame:
        """collection, outcome (success, failed, skipped), rows, error: each collection is copied to a folder of ``snapshots`` and made anew from
        ``rows_of`` its name; None skips it. A failure leaves the collection as it was and doesn't stop the others, but for the loss of the session. ``dry_run``
        only counts."""
        out = []
        for name in names:
            try:
                rows = rows_of(name)
                if rows is None:
                    out.append((name, "skipped", None, None))
                    continue
                if not dry_run:
                    if (old := self.read(name)) is not None:
                        self._copy(old, f"{snapshots}/{name}")
                    self.write(name, rows)
                    rows = self.read(name)
                out.append((name, "success", 0 if rows is None else rows.count(), None))
            except Exception as e:  # the outcome is a row of the summary
                if self.spark.sparkContext._jsc.sc().isStopped():
                    raise
                out.append((name, "failed", None, str(e).split("\n")[0]))
        return self.spark.createDataFrame(out, "collection string, outcome string, rows long, error string")

    def snapshot(self, name: str, to: str) -> DataFrame:
        """Copy the collection to a path; its manifest: file, bytes, SHA-256 of each file. A missing collection is an error."""
        rows = self.read(name)
        if rows is None:
            raise ValueError(f"no collection {name}")
        return self._copy(rows, to)

    def _copy(self, rows: DataFrame, to: str) -> DataFrame:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(to)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(to)
        return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _merged_schema(old: str | None, new: str | None) -> str | None:
    """The old schema and the columns that only the new one has; all may be null."""
    both = [StructType.fromJson(json.loads(s)).fields for s in (old, new) if s]
    fields = {f.name: StructField(f.name, f.dataType, True) for x in reversed(both) for f in x}
    names = list(dict.fromkeys(f.name for x in both for f in x))
    return StructType([fields[n] for n in names]).json() if names else None


def outcomes(summary: DataFrame) -> DataFrame:
    """success, failed, skipped: sorted names by outcome, in one row. A summary has one row a collection, so lists are of bounded size."""
    of = lambda o: F.sort_array(F.collect_list(F.when(F.col("outcome") == o, F.col("collection")))).alias(o)
    return summary.agg(of("success"), of("failed"), of("skipped"))


# The columns of an export, in order, and their types.
EXPORTED = {
    "arxiv_id": "string", "title": "string", "abstract": "string", "categories": "array<string>", "authors": "array<string>", "first_created": "string", "last_updated": "string", "doi": "string", "pdf_url": "string", "collection": "string",
    "dense_embedding": "array<float>", "sparse_indices": "array<bigint>", "sparse_values": "array<float>",
}


def exported(points: DataFrame, dim: int) -> DataFrame:
    """Points as rows of an export: the fixed columns, lists from delimited text where they aren't lists, empty for what is missing. Rows whose vector hasn't ``dim``
    components are left out."""
    have = dict(points.dtypes)

    def column(name: str, kind: str) -> Column:
        if name not in have:
            return F.lit("").alias(name) if kind == "string" else F.array().cast(kind).alias(name)
        c = F.col(f"`{name}`")
        if kind == "array<string>" and have[name] == "string":
            c = as_list(c, "," if name == "authors" else r"\s+")
        return F.coalesce(c.cast(kind), F.lit("") if kind == "string" else F.array().cast(kind)).alias(name)

    return points.filter(F.size("dense_embedding") == dim).select(*[column(n, k) for n, k in EXPORTED.items()])


def export(points: DataFrame, path: str, dim: int, vector: str = "dense_embedding", by: str = "collection") -> None:
    """One folder for each collection, zstd; rows whose vector hasn't ``dim`` components are left out."""
    points.filter(F.size(vector) == dim).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def export_files(points: DataFrame, path: str, dim: int) -> None:
    """exported() rows in one zstd file for each collection, written by one task each, row group by row group."""
    exported(points, dim).repartition("collection").sortWithinPartitions("collection", "arxiv_id").write.mode("overwrite").option("compression", "zstd").partitionBy("collection").parquet(path)


def lacks_sparse(indices: Column) -> Column:
    """A point without a sparse vector, which is still to be made."""
    return indices.isNull()


def has_text(title: Column, abstract: Column) -> Column:
    """Something to make a vector of: a title or an abstract that isn't blank."""
    there = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    return there(title) | there(abstract)
