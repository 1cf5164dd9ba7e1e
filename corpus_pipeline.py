"""Corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs. All but
the last return the columns of documents. When a stage starts, its predecessor has been written, so the tables in the shared folder
that only the predecessor needed are deleted.

Nulls: null texts count as empty, are nobody's near copy and hold no benchmark item; rows without an id are kept by near dedup. Ties
and repeated rows: of rows that repeat both id and text exactly one leaves exact dedup. Very long texts go through whole. Empty
table: no rows, with the columns of the stage. Extra columns pass through all stages but the last; inner names avoid theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notespark.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from notespark.llm.common import few_files, new_path, read, release
from notespark.session import ready


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality or toxic go."""
    ready(spark)
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest id stays."""
    ready(spark)
    return few_files(exact_dedup.keep_latest(docs))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on 5-word shingles, the one of the smallest id stays."""
    ready(spark)
    release("exact")
    return near_dedup.keep_first(docs, words=5, num=80, den=100)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's 5-word shingles go."""
    ready(spark)
    release("near")
    return few_files(decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark")))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", _quality),
    ("exact dedup", _exact),
    ("near dedup", _near),
    ("benchmark decontamination", _benchmark),
    ("packing", _pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"), "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
