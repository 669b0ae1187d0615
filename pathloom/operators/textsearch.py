"""Search in plain sequences without an index: the baseline of the path index.

A sequence's windows of the patterns' common seed length meet the patterns by an equi-join; what remains of a
pattern is compared in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def locate(texts: DataFrame, patterns: DataFrame, seed: int) -> DataFrame:
    """pid, id, pos (from 0) of every occurrence of patterns(pid, pattern) of ``seed`` characters or more in texts(id, text)."""
    windows = texts.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("text") - seed))).where(F.length("text") >= seed)
    keyed = windows.withColumn("__s", F.substr("text", F.col("pos") + 1, F.lit(seed)))
    wanted = patterns.where(F.length("pattern") >= seed).withColumn("__s", F.substr("pattern", F.lit(1), F.lit(seed)))
    met = keyed.join(wanted, "__s").where(F.substr("text", F.col("pos") + 1, F.length("pattern")) == F.col("pattern"))
    return met.select("pid", "id", F.col("pos").cast("long").alias("pos"))


def count(texts: DataFrame, patterns: DataFrame, seed: int) -> DataFrame:
    """pid, n: occurrences of every pattern."""
    n = locate(texts, patterns, seed).groupBy("pid").agg(F.count("*").alias("n"))
    return patterns.select("pid").join(n, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
