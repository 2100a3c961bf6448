"""Collections that are kept page by page, as an interface with a cursor gives them, read by Spark: in parallel by ranges of pages, and as a stream.

A page is a JSON file ``page-<cursor>.json`` of {"cursor", "next", "points": [{…}]}, in order of ids; ``index.json`` has each page's cursor, rows, least and
greatest id, and is written last, so it names whole pages only. The folder must be mounted on all machines.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.hierarchy import kept
from ..session import make_importable

# Fixed value: rows of a page.
PAGE = 256
#: Pages that one partition reads; the source's name; the column that pages are in order of.
PAGES, FORMAT, ID = 64, "paged_collection", "id"


def local(path: str) -> Path:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"pages must be in a folder that is mounted on all machines, not {path}")
    return Path(unquote(at.path))


def write_pages(points: DataFrame, path: str, size: int = PAGE, id_col: str = ID, start: int = 0) -> int:
    """Points (any columns, JSON-able) as pages of ``size`` rows in order of id, numbered from ``start`` on and added to what the folder has; the number of the next page.
    Null ids come first. Pages are written where they are made; a task that runs again writes the same ones."""
    make_importable(points.sparkSession)
    rows = points.select(F.col(id_col).alias("__id"), F.to_json(F.struct("*")).alias("point"))
    ranged = kept(rows.repartitionByRange("__id").withColumn("pid", F.spark_partition_id()), "page-rows")
    counts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy("__id", "point")) - 1
    placed = ranged.join(F.broadcast(before), "pid").select((F.floor(place / size) + start).alias("page"), place.alias("place"), "__id", "point", F.ceil(F.col("total") / size).alias("pages"))
    folder = local(path)

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        cursor, pages = int(pdf["page"].iloc[0]), int(pdf["pages"].iloc[0])
        points = [json.loads(p) for p in pdf["point"]]
        page = {"cursor": cursor, "next": cursor + 1 if cursor + 1 < start + pages else None, "points": points}
        folder.mkdir(parents=True, exist_ok=True)
        begun = folder / f".page-{cursor}.{os.getpid()}"
        begun.write_text(json.dumps(page))
        os.replace(begun, folder / f"page-{cursor}.json")
        ids = [p[id_col] for p in points if p.get(id_col) is not None]
        return pd.DataFrame({"cursor": [cursor], "rows": [len(points)], "least": [json.dumps(min(ids, default=None))], "greatest": [json.dumps(max(ids, default=None))], "nulls": [len(ids) < len(points)]})

    told = placed.groupBy("page").applyInPandas(store, "cursor long, rows long, least string, greatest string, nulls boolean").collect()
    index = [x for x in _index(folder) if x["cursor"] < start]
    index += sorted(({"cursor": r.cursor, "rows": r["rows"], "least": json.loads(r.least), "greatest": json.loads(r.greatest), "nulls": r.nulls} for r in told), key=lambda x: x["cursor"])
    folder.mkdir(parents=True, exist_ok=True)
    begun = folder / ".index"
    begun.write_text(json.dumps(index))
    os.replace(begun, folder / "index.json")
    return start + len(told)


def _index(folder: Path) -> list[dict]:
    at = folder / "index.json"
    return json.loads(at.read_text()) if at.exists() else []


class Pages(InputPartition):
    def __init__(self, cursors: list[int]):
        super().__init__(cursors[0])
        self.cursors = cursors


def _rows(folder: Path, cursors: list[int], names: list[str], fits: list[tuple] = ()) -> Iterator[tuple]:
    for c in cursors:
        for p in json.loads((folder / f"page-{c}.json").read_text())["points"]:
            if all(_holds(p.get(ID), kind, value) for kind, value in fits):
                yield tuple(p.get(n) for n in names)


def _holds(x, kind: str, value) -> bool:
    if x is None:
        return False
    return {"=": lambda: x == value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "in": lambda: x in value}[kind]()


class PagedReader(DataSourceReader):
    """A partition for every PAGES pages that may hold what is asked for. Filters on the id are applied here: they leave out pages by the index, and rows as pages are
    read. Of each point only the schema's columns go to Spark."""

    def __init__(self, folder: Path, names: list[str], pages: int):
        self.folder, self.names, self.pages, self.fits = folder, names, pages, []

    def pushFilters(self, filters: list[Filter]):
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in kinds and f.attribute == (ID,) and f.value is not None:
                self.fits.append((kinds[type(f)], f.value))
            else:
                yield f

    def _may(self, page: dict) -> bool:
        low, high = page["least"], page["greatest"]
        if low is None:
            return not self.fits
        may = {"=": lambda v: low <= v <= high, ">": lambda v: high > v, ">=": lambda v: high >= v, "<": lambda v: low < v, "<=": lambda v: low <= v, "in": lambda v: any(low <= x <= high for x in v)}
        return all(may[kind](value) for kind, value in self.fits)

    def partitions(self) -> list[InputPartition]:
        cursors = [p["cursor"] for p in _index(self.folder) if self._may(p)]
        return [Pages(cursors[k : k + self.pages]) for k in range(0, len(cursors), self.pages)] or [Pages([-1])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return iter(()) if partition.cursors == [-1] else _rows(self.folder, partition.cursors, self.names, self.fits)


class PagedStream(DataSourceStreamReader):
    """Pages as they are added; the offset is the next cursor, so a stream that goes on repeats none."""

    def __init__(self, folder: Path, names: list[str], pages: int):
        self.folder, self.names, self.pages = folder, names, pages

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        return {"cursor": max((p["cursor"] + 1 for p in _index(self.folder)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        cursors = list(range(start["cursor"], end["cursor"]))
        return [Pages(cursors[k : k + self.pages]) for k in range(0, len(cursors), self.pages)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.folder, partition.cursors, self.names)

    def commit(self, end: dict) -> None:
        pass


class PagedCollection(DataSource):
    """Format ``paged_collection``. Load a folder with a schema of the columns that are wanted (``id`` among them for filters to work); option pages: pages of a
    partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _parts(self, schema: StructType) -> tuple[Path, list[str], int]:
        return local(self.options["path"]), schema.names, int(self.options.get("pages", PAGES))

    def schema(self) -> str:
        raise ValueError("name the columns that are wanted: .schema(…)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(*self._parts(schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(*self._parts(schema))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters down."""
    make_importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCollection)
