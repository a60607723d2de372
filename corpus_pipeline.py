"""From documents to packed sequences: quality, lines, near duplicates, mixture, packing.

run() applies the stages in order. Each stage's rows are written as Parquet and read again as the
next one's docs, so a lost executor never costs more than the stage at hand.

Defined results: null and empty texts go in the first stage, which finds no word in them; null and
repeated doc_ids are rows of their own in every stage, and rows that repeat doc_id and text share
their fate until the mixture, which counts each; texts of any length are read whole; ties go as each
operator's docstring says; other columns are passed through up to the mixture, whatever their
names; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import line_dedup, mixing, near_dup, packing, quality
from siftline.llm.common import stored
from siftline.llm.queries import table, vocabulary


#: Rows that Spark hands to a Python worker at once. A batch of whole texts stands in the JVM's direct memory and in the worker, for
#: each core of an executor and beside its heap; results don't depend on it.
BATCH_ROWS = 2048


def in_small_batches(stage):
    """The stage, with the session's batches for Python workers lowered to BATCH_ROWS; a smaller setting stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        rows = int(spark.conf.get(key))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus, the same or within one edited word."""
    return line_dedup.select(docs)


@in_small_batches
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.select(docs)


@in_small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mixture takes them."""
    return mixing.repeated(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0)


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in a sequence of at most 1024 tokens."""
    cut = packing.pieces(docs, vocabulary("byte_bpe_50k.json"), spaced=True, end_id=2, capacity=1024)
    return packing.pack(cut, capacity=1024)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages' models and sketches can't be written as SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
