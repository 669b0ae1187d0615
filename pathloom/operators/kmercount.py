"""Distinct k-mers of an index, and the comparison of two indexes' k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from .index import PathIndex
from .ranking import kept
from .search import step_back


def _wanted(with_n: bool) -> str:
    return "^[1-5]+$" if with_n else "^[1-4]+$"


def kmers_of(index: PathIndex, k: int, with_n: bool = False) -> DataFrame:
    """kmer: distinct k-mers of bases (or N too), for k up to the order, from full-length labels."""
    if index.occurrences is None:
        raise ValueError("the index was built without occurrences")
    return index.occurrences.select(F.substr("label", F.lit(1), F.lit(k)).alias("kmer")).where(F.length("kmer") == k).where(F.col("kmer").rlike(_wanted(with_n))).distinct()


def expand_kmers(index: PathIndex, k: int, with_n: bool = False, report: Column | None = None, expand: Column | None = None) -> DataFrame:
    """kmer, sp, ep of k-mers that backward steps find, for any k: one join for each position. Over the order, some may not occur.

    By default the k-mers of length k are reported. ``report`` and ``expand`` (over kmer, sp, ep) choose which states of up to k characters are
    reported, and which go on.
    """
    digits = list(range(1, 6 if with_n else 5))
    now = index.key_ranges.where((F.length("prefix") == 1) & F.col("prefix").cast("int").isin(digits)).select(F.col("prefix").alias("kmer"), "sp", "ep")
    report = F.length("kmer") == k if report is None else report
    out = now.where(report)
    for _ in range(k - 1):
        live = now if expand is None else now.where(expand)
        every = live.select("kmer", "sp", "ep", F.explode(F.array(*[F.lit(d) for d in digits])).alias("comp"))
        back = step_back(index, every, "comp", ("kmer", "comp"))
        now = kept(back.select(F.concat(F.col("comp").cast("string"), "kmer").alias("kmer"), "sp", "ep"))
        out = out.unionByName(now.where(report))
    return out


def count_kmers(index: PathIndex, k: int, with_n: bool = False, force: bool = False) -> int:
    """Number of distinct k-mers; 1 for k = 0; 0 for k over the order without ``force``."""
    if k == 0:
        return 1
    if k > index.order and not force:
        return 0
    return expand_kmers(index, k, with_n).count() if k > index.order or index.occurrences is None else kmers_of(index, k, with_n).count()


def compare_kmers(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: shared, left_only, right_only of two tables of distinct kmer."""
    both = left.select("kmer", F.lit(1).alias("l")).join(right.select("kmer", F.lit(1).alias("r")), "kmer", "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def compare_indexes(left: PathIndex, right: PathIndex, k: int, with_n: bool = False, force: bool = False, output: str | None = None) -> DataFrame:
    """``compare_kmers`` of two indexes: (1, 0, 0) for k = 0, zeros for k over an order without ``force`` or over 64. ``output``: writes both differences below it."""
    spark = left.meta.sparkSession
    one = lambda *row: spark.createDataFrame([row], "shared long, left_only long, right_only long")
    if k == 0:
        return one(1, 0, 0)
    if k > 64 or k > min(left.order, right.order) and not force:
        return one(0, 0, 0)
    of = lambda i: (expand_kmers(i, k, with_n).select("kmer") if k > i.order or i.occurrences is None else kmers_of(i, k, with_n))
    l, r = kept(of(left)), kept(of(right))  # noqa: E741
    if output:
        for name, a, b in (("left", l, r), ("right", r, l)):
            a.join(b, "kmer", "left_anti").select(A.decode("kmer").alias("kmer")).write.mode("overwrite").parquet(f"{output}.{name}")
    return compare_kmers(l, r)


def sizes(index: PathIndex, kmers: DataFrame) -> DataFrame:
    """what, n: k-mers, their distinct labels and starts, and the index's nodes, edges, samples and LCP values."""
    one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    out = one("kmers", kmers)
    for what, df in (("labels", kmers.select("label").distinct()), ("starts", kmers.select("from_node").distinct()), ("nodes", index.nodes), ("edges", index.edges), ("samples", index.samples), ("values", index.lcp)):
        out = out.unionByName(one(what, df))
    return out
