"""An index checked against its input: one batch of joins, a row for every failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from . import search as S
from . import suffixtree as T
from .index import PathIndex
from .ranking import kept


def failures(index: PathIndex, kmers: DataFrame, most: int | None = 100, sample: int = 2) -> DataFrame:
    """what, label: find, parent and depth, count, locate and sampled locate against the input, for each distinct label up to its first sink.

    At most ``most`` rows, or all.
    """
    cut = F.regexp_extract("label", "^([^0]*0?)", 1)
    truth = kept(kmers.select(cut.alias("pattern"), "from_node").distinct())
    labels = truth.select("pattern").distinct().withColumn("pid", F.col("pattern"))
    found = kept(S.find(index, labels))
    out = found.where("sp > ep").select(F.lit("find").alias("what"), "pattern")

    # The parent is the longest shorter pattern with another range; its depth that pattern's length.
    shorter = found.where("sp <= ep").select("pid", F.col("sp").alias("s"), F.col("ep").alias("e"), F.explode(A.prefixes("pattern", 0)).alias("p")).where(F.length("p") < F.length("pid"))
    ranges = index.key_ranges.withColumnRenamed("prefix", "p")
    wider = shorter.join(ranges, "p").where("sp < s OR ep > e").groupBy("pid").agg(F.max_by(F.struct("sp", "ep", F.length("p").alias("d")), F.length("p")).alias("x")).select("pid", "x.*")
    up = kept(T.parent(index, found.where("sp <= ep").select("pid", "sp", "ep")))
    deep = T.depth(index, up.select("pid", "sp", "ep")).select("pid", F.col("depth").alias("below"))
    wrong = wider.join(up.select("pid", F.col("sp").alias("s"), F.col("ep").alias("e"), "depth"), "pid").join(deep, "pid")
    out = out.unionByName(wrong.where("sp <> s OR ep <> e OR depth <> below").select(F.lit("parent").alias("what"), F.col("pid").alias("pattern")))

    located = kept(S.locate(index, found))
    own = truth.select(F.col("pattern").alias("pid"), F.col("from_node").alias("node"))
    for name, rows in (("locate misses", own.join(located, ["pid", "node"], "left_anti")), ("locate adds", located.join(own, ["pid", "node"], "left_anti"))):
        out = out.unionByName(rows.select(F.lit(name).alias("what"), F.col("pid").alias("pattern")).distinct())
    n = own.groupBy("pid").agg(F.count("*").alias("true_n"))
    out = out.unionByName(n.join(S.count(index, found), "pid", "left").where("NOT n <=> true_n").select(F.lit("count").alias("what"), F.col("pid").alias("pattern")))
    some = kept(S.locate_some(index, found, sample))
    sizes = n.join(some.groupBy("pid").agg(F.count("*").alias("got")), "pid", "left").where(F.coalesce("got", F.lit(0)) != F.least("true_n", F.lit(sample)))
    out = out.unionByName(sizes.select(F.lit("sampled locate").alias("what"), F.col("pid").alias("pattern"))).unionByName(some.join(located, ["pid", "node"], "left_anti").select(F.lit("sampled locate").alias("what"), F.col("pid").alias("pattern")).distinct())
    out = out.select("what", A.decode("pattern").alias("label"))
    return out if most is None else out.limit(most)
