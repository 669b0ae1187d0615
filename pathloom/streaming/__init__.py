"""Pattern batches from a stream against a static index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import PathIndex
from ..operators.ranking import kept
from ..operators.search import empty_as, label_nodes


def find_stream(index: PathIndex, patterns: DataFrame, lengths: list[int]) -> DataFrame:
    """pid, pattern, sp, ep of a streaming ``patterns`` of the given lengths: a stream-static join with the prefixes, of these lengths alone, of all full-length labels."""
    table = kept(prefix_table(index, lengths))
    sp, ep = empty_as(F.col("sp"), F.col("ep"))
    return patterns.join(table, "pattern", "left").select("pid", "pattern", sp.alias("sp"), ep.alias("ep"))


def prefix_table(index: PathIndex, lengths: list[int]) -> DataFrame:
    """pattern, sp, ep of every prefix of a full-length label of one of the lengths."""

    def cut(n: int) -> Column:
        return F.substr("label", F.lit(1), F.lit(n))

    spread = label_nodes(index).select("path_id", F.explode(F.array(*[cut(n) for n in lengths])).alias("pattern"))
    return spread.groupBy("pattern").agg(F.min("path_id").alias("sp"), F.max("path_id").alias("ep"))
