"""The corpus pipeline: documents to packed sequences in five stages, each written as Parquet and read again.

Of all stages: null texts count as empty; ids may be null or repeated; repeated rows are rows of their own; very long texts are read whole; an empty
table gives an empty result of the same columns; extra columns, whatever their names, go through the first four stages as they are.

A task that reads Parquet holds a row group of it, compressed, and one that writes it does too. The first four stages hand on whole texts, so they set the
session's ``parquet.block.size`` to ``GROUP`` bytes, unless it has one: whoever writes a stage's rows then writes row groups that small executors can read.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import neardup, packing, pii, quality, toxicity
from pathloom.llm.common import checkpoint_folder, removed, table

#: Bytes of a row group of what stages hand on, before compression. Parquet's own 128 MB are a whole file of a stage.
GROUP = 8 << 20


def _small_groups(spark: SparkSession) -> None:
    """From now on the session writes Parquet in row groups of GROUP bytes, if nothing else was set."""
    if spark.conf.get("parquet.block.size", None) is None and spark._jsc.hadoopConfiguration().get("parquet.block.size") is None:
        spark.conf.set("parquet.block.size", str(GROUP))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. A score equal to the threshold is rejected; empty texts score alike, by the bias, and repeated rows too."""
    _small_groups(spark)
    return toxicity.drop_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and classifier. Empty texts have too few words; a probability equal to the threshold passes; repeated rows pass or fail together."""
    _small_groups(spark)
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the row of its smallest id (null only if all are), of several such the one of the smallest digest. Empty texts are one class."""
    _small_groups(spark)
    return neardup.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars is the new text's. A null text stays null; equal texts change alike; of overlapping spans the first, then the longer is marked."""
    _small_groups(spark)
    return pii.sanitised(docs, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens. Empty texts are one token; of windows that fit alike the first opened is taken; extra columns are left out."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("near-dedup", near_dedup), ("pii", redact), ("packing", pack)]

#: SQL can't express the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's rows lie in the session's checkpoint folder until the next stage's are written; the last one's stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    top = os.path.join(checkpoint_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
