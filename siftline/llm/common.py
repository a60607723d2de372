"""What the operators of this subpackage share: scratch tables, checked broadcasts, row streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import mix

#: A side is broadcast only when it was stored, counted and found to have no more rows than this.
BROADCAST_ROWS = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


_made: list[str] = []


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siftline-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Removes the tables that `stored` wrote for this process, once no result that reads them is needed any more; how many there were."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A stored df with a broadcast hint if its counted rows stay within limit; beyond that Spark shuffles both sides.

    For tables that don't grow with the corpus. weight: what a row counts as, for rows of no fixed width."""
    n = df.agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= limit else df


def own(columns: list[str], *names: str) -> list[str]:
    """Names for an operator's own columns: as given, with underscores before them until no column of the input has them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class KeyFilter:
    """A Bloom filter of a table's longs: `has` is true for all of them and for few others.

    Its size follows the number of keys up to most_bits, so what is sent to tasks is bounded; beyond that more
    keys pass that needn't, and results stay the same, for what passes is joined exactly afterwards."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(keys.view(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(3)]

    @classmethod
    def of(cls, keys: DataFrame, most_bits: int = 1 << 26) -> KeyFilter:
        """keys: a stored table whose only column is long."""
        n = keys.count()
        size = 1 << 16
        while size < min(most_bits, 12 * n):
            size *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size, bool)
            for batch in batches:
                for at in cls.places(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)), size):
                    bits[at] = True
            words = np.packbits(bits).view(np.int64)
            used = np.flatnonzero(words)
            for a in range(0, len(used), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(used[a : a + (1 << 16)]), pa.array(words[used[a : a + (1 << 16)]])], ["slot", "word"])

        whole = np.zeros(size // 64, np.int64)
        if n:
            table = keys.mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
            whole[table.column(0).to_numpy()] = table.column(1).to_numpy()
        return cls(whole.view(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(np.ascontiguousarray(keys, np.int64), 8 * len(self.bits)):
            out &= ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
        return out

    def column(self, key: Column) -> Column:
        """Whether a row's key may be among the keys; only the key passes through Python."""
        has = self.has

        @F.pandas_udf("boolean")
        def maybe(k: pd.Series) -> pd.Series:
            return pd.Series(has(k.to_numpy(np.int64)))

        return maybe(key)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit("")).alias(col)


def lists(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[list[list]]:
    """The columns of each batch as Python lists, at most step rows at a time, so that a few long texts don't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield [c.to_pylist() for c in batch.slice(at, step).columns]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in shorter runs of rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    """How many blocks hold rows at per_block each."""
    return max(least, -(-rows // per_block))
