"""Exports that are published once: parts, a digest, and a manifest that makes them readable (SNK-12).

Tasks write parts under names of their own and return what they wrote (name, first key, rows, digest) as commit messages; the
driver writes the manifest last, in one move over the old one. A reader knows nothing but the manifest: parts of failed tasks,
second attempts and aborted writes are in no manifest, and a reader of the old one keeps its parts until it is `swept`.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import formula_safe

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    name: str
    first: int
    rows: int
    digest: str


def digest_of(parts: list[Part]) -> str:
    """The digest of an export: of its parts' digests, in order."""
    return hashlib.sha256("".join(p.digest for p in parts).encode()).hexdigest()


class Publisher(DataSourceArrowWriter):
    """Rows: their number in the export, then cells. Spark calls write in tasks, commit or abort on the driver."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns, self.run = options["path"], columns, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        where, path = fs.FileSystem.from_uri(self.path)
        name, first, rows, sha = f"{self.run}-{uuid.uuid4().hex}.csv", -1, 0, hashlib.sha256()
        where.create_dir(f"{path}/parts")
        with where.open_output_stream(f"{path}/parts/{name}") as out:
            for batch in iterator:
                if batch.num_rows:
                    first = batch.column(0)[0].as_py() if first < 0 else first
                    text = io.StringIO()
                    csv.writer(text, lineterminator="\r\n").writerows(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True))
                    data = text.getvalue().encode()
                    out.write(data)
                    sha.update(data)
                    rows += batch.num_rows
        return Part(name, first, rows, sha.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        where, path = fs.FileSystem.from_uri(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        shown = {"columns": self.columns, "rows": sum(p.rows for p in parts), "digest": digest_of(parts), "parts": [vars(p) for p in parts]}
        where.create_dir(path)
        with where.open_output_stream(f"{path}/.{self.run}") as out:
            out.write(json.dumps(shown).encode())
        where.move(f"{path}/.{self.run}", f"{path}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        where, path = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{path}/parts/{m.name}")


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema, overwrite: bool) -> Publisher:
        return Publisher(self.options, schema.fieldNames()[1:])


def publish(df: DataFrame, folder: str, order: list[Column]) -> dict:
    """Writes df's columns as cells that no spreadsheet runs, in order over the parts, and publishes them; returns the manifest.

    A part is a range of the order; its first number is its partition's. Null cells are empty. An empty df publishes no parts."""
    spark = df.sparkSession
    cells = (formula_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns)
    placed = df.orderBy(*order).select(F.monotonically_increasing_id().alias("_number"), *cells)
    spark.dataSource.register(Published)
    placed.write.format("published").mode("append").save(folder)
    return manifest(folder)


def manifest(folder: str) -> dict:
    """What is published: columns, rows, digest, parts. Nothing, if nothing is."""
    where, path = fs.FileSystem.from_uri(folder)
    if where.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        return {"columns": [], "rows": 0, "digest": digest_of([]), "parts": []}
    with where.open_input_stream(f"{path}/{MANIFEST}") as stream:
        return json.loads(stream.readall())


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of what is published, as strings."""
    shown = manifest(folder)
    schema = ", ".join(f"`{c}` string" for c in shown["columns"]) or "nothing string"
    if not shown["parts"]:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv([f"{folder}/parts/{p['name']}" for p in shown["parts"]])
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in shown["columns"]))


def swept(folder: str) -> int:
    """Removes parts that the manifest doesn't name, once no reader of an older one is left; how many."""
    where, path = fs.FileSystem.from_uri(folder)
    named = {p["name"] for p in manifest(folder)["parts"]}
    left = [f.path for f in where.get_file_info(fs.FileSelector(f"{path}/parts", allow_not_found=True)) if f.base_name not in named]
    for f in left:
        where.delete_file(f)
    return len(left)
