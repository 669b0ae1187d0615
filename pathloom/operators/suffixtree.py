"""Suffix-tree navigation over the LCP column of an index.

Neighbours with smaller values need no scan: two positions with no smaller LCP between them have keys with a common
prefix, so the nearest smaller value of a position lies at the border of the key range of a prefix of its key.
Positions and ranges come as rows; missing neighbours are (size, size), as in a table of ``size`` values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import PathIndex

#: Children of a node of the range-minimum tree.
BRANCHING = 64


def root(index: PathIndex) -> DataFrame:
    """sp, ep, left_lcp, right_lcp, depth of the root."""
    return index.meta.select(F.lit(0).cast("long").alias("sp"), (F.col("path_nodes") - 1).alias("ep"), F.lit(0).alias("left_lcp"), F.lit(0).alias("right_lcp"), F.lit(0).alias("depth"))


def node_for(index: PathIndex, ranges: DataFrame) -> DataFrame:
    """ranges(pid, sp, ep) with left_lcp at sp and right_lcp behind ep (0 at the end)."""
    left = index.lcp.select(F.col("path_id").alias("sp"), F.col("lcp").alias("left_lcp"))
    right = index.lcp.select((F.col("path_id") - 1).alias("ep"), F.col("lcp").alias("right_lcp"))
    return ranges.join(left, "sp", "left").join(right, "ep", "left").select("pid", "sp", "ep", "left_lcp", F.coalesce("right_lcp", F.lit(0)).alias("right_lcp"))


def _values(index: PathIndex) -> DataFrame:
    """path_id, lcp, key and the range (s, e) of the nodes whose keys share the first lcp digits."""
    rows = index.lcp.join(index.nodes.select("path_id", "key"), "path_id").withColumn("prefix", F.substr("key", F.lit(1), F.col("lcp")))
    return rows.join(index.key_ranges.select("prefix", F.col("sp").alias("s"), F.col("ep").alias("e")), "prefix")


def neighbours(index: PathIndex, positions: DataFrame | None = None) -> DataFrame:
    """path_id, lcp and positions and values of psv, psev, nsv, nsev: the nearest smaller (or equal) values before and after.

    With positions(path_id), of these alone: only values of their prefixes are looked at. Equal values in one prefix's range are at most as many as there are digits, so the windows are small.
    """
    size = index.size
    v = _values(index)
    if positions is not None:
        wanted = v.join(positions.select("path_id").distinct(), "path_id", "left_semi").select("prefix", "lcp").distinct()
        v = v.join(wanted, ["prefix", "lcp"])
    value = index.lcp.select(F.col("path_id").alias("__p"), F.col("lcp").alias("__v"))
    w = Window.partitionBy("prefix", "lcp").orderBy("path_id")
    rows = v.select(
        "path_id", "lcp",
        F.when(F.col("lcp") > 0, F.col("s")).otherwise(size).alias("psv"),
        F.when(F.col("path_id") == 0, size).otherwise(F.coalesce(F.lag("path_id").over(w), F.when(F.col("lcp") > 0, F.col("s")).otherwise(F.lit(0)))).alias("psev"),
        F.when((F.col("lcp") > 0) & (F.col("e") + 1 < size), F.col("e") + 1).otherwise(size).alias("nsv"),
        F.coalesce(F.lead("path_id").over(w), F.when((F.col("lcp") > 0) & (F.col("e") + 1 < size), F.col("e") + 1).otherwise(size)).alias("nsev"),
    )
    if positions is not None:
        rows = rows.join(positions.select("path_id").distinct(), "path_id", "left_semi")
    for name in ("psv", "psev", "nsv", "nsev"):
        rows = rows.join(value, F.col(name) == F.col("__p"), "left").withColumn(f"{name}_lcp", F.coalesce("__v", F.lit(size)).cast("long")).drop("__p", "__v")
    return rows


def parent(index: PathIndex, ranges: DataFrame) -> DataFrame:
    """pid, sp, ep, left_lcp, right_lcp, depth of the parents of ranges(pid, sp, ep); the root is its own parent."""
    size = index.size
    nodes = node_for(index, ranges)
    depth = F.greatest("left_lcp", "right_lcp")
    keyed = nodes.join(index.nodes.select(F.col("path_id").alias("sp"), "key"), "sp").select("pid", "sp", "ep", "left_lcp", "right_lcp", depth.alias("depth"), F.substr("key", F.lit(1), depth).alias("prefix"))
    up = keyed.join(index.key_ranges.select("prefix", F.col("sp").alias("s"), F.col("ep").alias("e")), "prefix")
    whole = (F.col("sp") == 0) & (F.col("ep") == size - 1)
    # a side moves only if it bounds the parent's depth; the other side's border has a smaller value already
    sides = up.select("pid", F.when(whole, 0).otherwise(F.col("s")).alias("sp"), F.when(whole, size - 1).otherwise(F.col("e")).alias("ep"), F.when(whole, 0).otherwise(F.col("depth")).alias("depth"))
    return node_for(index, sides.select("pid", "sp", "ep")).join(sides.select("pid", "depth"), "pid").select("pid", "sp", "ep", "left_lcp", "right_lcp", "depth")


def minimum_tree(index: PathIndex, branching: int = BRANCHING) -> DataFrame:
    """level, pos, lcp, at: the least value of every block of ``branching`` ** level positions and its first place; level 0 are the values."""
    now = index.lcp.select(F.col("path_id").alias("pos"), "lcp", F.col("path_id").alias("at"))
    levels, size, level = now.select(F.lit(0).alias("level"), "pos", "lcp", "at"), index.size, 0
    while size > 1:
        level, size = level + 1, -(-size // branching)
        best = now.groupBy(F.floor(F.col("pos") / branching).alias("pos")).agg(F.min(F.struct("lcp", "at")).alias("m"))
        now = best.select("pos", "m.lcp", "m.at")
        levels = levels.unionByName(now.select(F.lit(level).alias("level"), "pos", "lcp", "at"))
    return levels


def rmq(index: PathIndex, ranges: DataFrame, tree: DataFrame | None = None, branching: int = BRANCHING) -> DataFrame:
    """pid, pos, lcp: the first place of the least value in each closed range; (size, size) for ranges that are empty or leave the table.

    A range is cut into whole blocks of the range-minimum tree, at most two runs of blocks on each level, which meet the tree by an equi-join.
    """
    tree = minimum_tree(index, branching) if tree is None else tree
    size, levels, n = index.size, 1, index.size
    while n > 1:
        levels, n = levels + 1, -(-n // branching)
    good = (F.col("sp") <= F.col("ep")) & (F.col("sp") >= 0) & (F.col("ep") < size)
    rows = ranges.where(good).select("pid", F.col("sp").alias("lo"), (F.col("ep") + 1).alias("hi"), F.array().cast("array<struct<level:int,pos:bigint>>").alias("cut"))
    none = F.array().cast("array<struct<level:int,pos:bigint>>")

    def run(level: int, a, b):
        return F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda p: F.struct(F.lit(level).alias("level"), p.cast("long").alias("pos")))).otherwise(none)

    for level in range(levels):
        up, down = F.ceil(F.col("lo") / branching), F.floor(F.col("hi") / branching)
        inner = (up < down) if level < levels - 1 else F.lit(False)
        rows = rows.select(
            "pid",
            F.when(inner, up).otherwise(F.col("lo")).cast("long").alias("__lo"), F.when(inner, down).otherwise(F.col("lo")).cast("long").alias("__hi"),
            F.concat("cut", F.when(inner, F.concat(run(level, F.col("lo"), up * branching), run(level, down * branching, F.col("hi")))).otherwise(run(level, F.col("lo"), F.col("hi")))).alias("cut"),
        ).select("pid", F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), "cut")
    cut = rows.select("pid", F.inline("cut"))
    best = cut.join(tree, ["level", "pos"]).groupBy("pid").agg(F.min(F.struct("lcp", "at")).alias("m"))
    return ranges.select("pid").join(best, "pid", "left").select("pid", F.coalesce("m.at", F.lit(size)).cast("long").alias("pos"), F.coalesce("m.lcp", F.lit(size)).cast("long").alias("lcp"))


def depth(index: PathIndex, ranges: DataFrame) -> DataFrame:
    """pid and depth: the least LCP behind sp up to ep; null for ranges of one position or none."""
    got = rmq(index, ranges.where("ep > sp").select("pid", (F.col("sp") + 1).alias("sp"), "ep"))
    return ranges.select("pid").join(got.select("pid", F.col("lcp").alias("depth")), "pid", "left").select("pid", "depth")


def tree_parent(pos, branching: int = BRANCHING):
    """Position of the parent, one level up."""
    return F.floor(pos / branching).cast("long")


def tree_first_child(pos, branching: int = BRANCHING):
    return pos * branching


def tree_last_child(pos, width, branching: int = BRANCHING):
    """Position of the last child where the level below has ``width`` nodes."""
    return F.least((pos + 1) * branching, width) - 1


def tree_first_sibling(pos, branching: int = BRANCHING):
    return pos - pos % branching


def tree_last_sibling(pos, width, branching: int = BRANCHING):
    return F.least(pos - pos % branching + branching, width) - 1


def tree_is_first(pos, branching: int = BRANCHING):
    return pos % branching == 0
