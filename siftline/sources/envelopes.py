"""Saved result envelopes as a data source: read by key range, with filters pushed down and offsets kept (SRC-12, SRC-13).

`save` writes envelopes in folders named by the range of entity numbers that they hold. The source plans a task for each folder
that a filter on `number` leaves, so a page "after the last key" opens no file below it; as a stream its offset is the last folder
read, which Spark keeps in the query's checkpoint. Files are reached through pyarrow's file systems, on a cluster as on one machine.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "number long, qid string, websites array<string>"
ARROW = pa.schema([("number", pa.int64()), ("qid", pa.string()), ("websites", pa.list_(pa.string()))])
#: Fixed value: where entities live.
ENTITY = "http://www.wikidata.org/entity/"


def save(rows: DataFrame, folder: str, per_range: int = 1000) -> None:
    """Writes rows (number, website) as envelopes, one for each range of per_range numbers, in the order of number and website."""
    binding = F.struct(F.struct(F.concat(F.lit(f"{ENTITY}Q"), "number").alias("value")).alias("company"), F.struct(F.col("website").alias("value")).alias("website"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("number", "website", binding.alias("b")))), lambda x: x["b"])
    envelopes = rows.groupBy(F.expr(f"number div {per_range}").alias("range")).agg(F.to_json(F.struct(F.struct(sorted_.alias("bindings")).alias("results"))).alias("value"))
    envelopes.write.partitionBy("range").mode("append").text(folder)


def grouped(payload: object) -> list[tuple[int, str, list[str]]]:
    """number, qid and distinct websites, in order, of an envelope's entities, by number. What isn't an envelope is an error."""
    try:
        bindings = payload["results"]["bindings"]
        pairs = [(b["company"]["value"].rsplit("/", 1)[-1], b["website"]["value"]) for b in bindings]
    except (KeyError, TypeError, AttributeError) as wrong:
        raise ValueError("a saved envelope lacks bindings, a company or a website") from wrong
    if not isinstance(bindings, list) or not all(re.fullmatch("Q[0-9]+", qid) for qid, _ in pairs):
        raise ValueError("a saved envelope names something that isn't an entity")
    sites: dict[str, dict[str, None]] = {}
    for qid, site in pairs:
        sites.setdefault(qid, {})[site] = None
    return sorted((int(qid[1:]), qid, list(s)) for qid, s in sites.items())


@dataclass
class Bounds:
    """The numbers from low to high that are asked for."""

    low: int = 0
    high: int = (1 << 63) - 1

    def narrow(self, f: Filter) -> bool:
        """Takes a filter on number over; false for others."""
        if getattr(f, "attribute", None) != ("number",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or f.value is None:
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        return True


@dataclass
class Range(InputPartition):
    value: int
    bounds: Bounds


class Folder:
    def __init__(self, options: dict):
        self.path, self.per_range = options["path"], int(options.get("per_range", 1000))

    def ranges(self) -> list[int]:
        where, path = fs.FileSystem.from_uri(self.path)
        return sorted(int(m.group(1)) for f in where.get_file_info(fs.FileSelector(path)) if (m := re.search(r"/range=(\d+)$", f.path)))

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(self.path)
        for f in sorted(where.get_file_info(fs.FileSelector(f"{path}/range={part.value}")), key=lambda f: f.path):
            if not f.path.rsplit("/", 1)[-1].startswith((".", "_")):
                with where.open_input_stream(f.path) as stream:
                    for line in stream.readall().decode().splitlines():
                        found = [x for x in grouped(json.loads(line)) if part.bounds.low <= x[0] <= part.bounds.high]
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], ARROW.field(k).type) for k in range(3)], schema=ARROW)


class EnvelopeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.bounds = Folder(options), Bounds()

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if not self.bounds.narrow(f):
                yield f

    def partitions(self) -> list[Range]:
        per, b = self.folder.per_range, self.bounds
        return [Range(k, b) for k in self.folder.ranges() if k * per <= b.high and (k + 1) * per > b.low]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition) if isinstance(partition, Range) else ()  # without ranges Spark asks for nothing once


class EnvelopeStream(DataSourceStreamReader):
    """Offsets are the last range read; a range is read once it is there, and a later file of an earlier range isn't."""

    def __init__(self, options: dict):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"range": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"range": max(self.folder.ranges(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(k, Bounds()) for k in self.folder.ranges() if start["range"] < k <= end["range"]]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(partition)


class SavedEnvelopes(DataSource):
    """spark.read.format("saved_envelopes").option("per_range", n).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "saved_envelopes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EnvelopeReader:
        return EnvelopeReader(self.options)

    def streamReader(self, schema) -> EnvelopeStream:  # noqa: N802
        return EnvelopeStream(self.options)


def saved(spark: SparkSession, folder: str, per_range: int = 1000, after: int | None = None, upto: int | None = None) -> DataFrame:
    """number, qid, websites of the envelopes in a folder, of numbers after one and up to another; filters on number reach the source.

    Spark keeps what is pushed down with the loaded frame: two ranges in one query need a frame each, as this gives."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedEnvelopes)
    rows = spark.read.format("saved_envelopes").option("per_range", per_range).load(folder)
    rows = rows if after is None else rows.where(F.col("number") > after)
    return rows if upto is None else rows.where(F.col("number") <= upto)


def arriving(spark: SparkSession, folder: str, per_range: int = 1000) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(SavedEnvelopes)
    return spark.readStream.format("saved_envelopes").option("per_range", per_range).load(folder)
