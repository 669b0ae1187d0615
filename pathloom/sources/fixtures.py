"""Labelled graphs from ordinary tables, and the k-mers of graphs.

A graph is nodes(file, node, comp) and edges(file, src, dst).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import nodeid as N

#: Digits of the event types (fixed values of the derived graph).
EVENT_DIGITS = {"click": "1", "error": "2", "purchase": "3", "signup": "4", "view": "5"}


@dataclass
class Graph:
    """nodes(file, node, comp), edges(file, src, dst)."""

    nodes: DataFrame
    edges: DataFrame


def event_rows(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """user_id, pos, comp, node, file of every event in its user's order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    pairs = [F.lit(x) for kv in EVENT_DIGITS.items() for x in kv]
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.select("user_id", pos.cast("long").alias("pos"), F.create_map(*pairs)[F.col("event_type")].alias("comp"))
    return rows.select("user_id", "pos", "comp", N.encode(F.col("user_id") + 1, "pos").alias("node"), F.pmod("user_id", F.lit(files)).cast("int").alias("file"))


def event_kmers(rows: DataFrame, k: int, ordered: str = "pos") -> DataFrame:
    """K-mers of linear sequences: a path from every event and one from the sink (node 0 of each file); labels are padded by the sink.

    A path that reaches the sink isn't extended; one that ends just before it goes on at the sink's.
    """
    w = Window.partitionBy("user_id").orderBy(ordered)
    ahead = [F.coalesce(F.lead("comp", i).over(w), F.lit(A.SINK)) if i else F.col("comp") for i in range(k + 1)]
    to = F.coalesce(F.lead("node", k).over(w), F.lit(0).cast("long"))
    bit = lambda c: F.pow(F.lit(2), c.cast("int")).cast("int")
    own = rows.select("file", F.concat(*ahead[:k]).alias("label"), bit(F.coalesce(F.lag("comp").over(w), F.lit(A.SOURCE))).alias("preds"), bit(ahead[k]).alias("succs"), F.col("node").alias("from_node"), to.alias("to_node"))
    ends = rows.select("file", "comp", F.lead("node").over(w).alias("next")).where("next IS NULL")
    sink = ends.groupBy("file").agg(F.bit_or(bit(F.col("comp"))).alias("preds")).select("file", F.lit(A.SINK * k).alias("label"), "preds", F.lit(1).alias("succs"), F.lit(0).cast("long").alias("from_node"), F.lit(None).cast("long").alias("to_node"))
    return own.withColumn("to_node", F.when(F.substr("label", F.lit(-1)) == A.SINK, F.lit(None)).otherwise(F.col("to_node"))).unionByName(sink)


def parts_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that follow each other in orders; of each part the two most frequent successors."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    counts = lines.select(F.col("l_partkey").alias("a"), after.alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("r <= 2")
    edges = best.select(F.lit(0).alias("file"), N.encode(F.col("a") + 1, F.lit(0)).alias("src"), N.encode(F.col("b") + 1, F.lit(0)).alias("dst"))
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(0).alias("file"), N.encode(F.col("p_partkey") + 1, F.lit(0)).alias("node"), (F.pmod(brand, F.lit(4)) + 1).cast("string").alias("comp"))
    return Graph(nodes, edges)


def graph_kmers(graph: Graph, k: int) -> DataFrame:
    """All paths of k nodes and, for each, every node after its last, as k-mer rows. Sink-labelled nodes end a path.

    Paths grow by joins on the edges' source; the number of rows is the number of paths, which the graph must bound.
    """
    bit = lambda c: F.pow(F.lit(2), F.col(c).cast("int")).cast("int")
    nodes, edges = graph.nodes, graph.edges
    comp = nodes.select("file", F.col("node").alias("dst"), F.col("comp").alias("next_comp"))
    hops = edges.join(comp, ["file", "dst"])
    prev = edges.join(nodes.select("file", F.col("node").alias("src"), F.col("comp").alias("pc")), ["file", "src"]).groupBy("file", F.col("dst").alias("node")).agg(F.bit_or(bit("pc")).alias("preds"))
    paths = nodes.select("file", F.col("node").alias("from_node"), F.col("comp").alias("label"), F.col("node").alias("last"))
    for _ in range(k - 1):
        grown = paths.join(hops.select("file", F.col("src").alias("last"), "dst", "next_comp"), ["file", "last"])
        paths = grown.select("file", "from_node", F.concat("label", "next_comp").alias("label"), F.col("dst").alias("last"))
    paths = paths.distinct()
    ahead = paths.join(hops.select("file", F.col("src").alias("last"), F.col("dst").alias("to_node"), "next_comp"), ["file", "last"])
    succs = ahead.groupBy("file", "from_node", "label").agg(F.bit_or(bit("next_comp")).alias("succs"))
    rows = ahead.select("file", "from_node", "label", "to_node").distinct().join(succs, ["file", "from_node", "label"])
    out = rows.join(prev, (rows.file == prev.file) & (rows.from_node == prev.node), "left").select(rows.file, "label", F.coalesce("preds", F.lit(1 << int(A.SOURCE))).alias("preds"), "succs", "from_node", "to_node")
    return out.withColumn("to_node", F.when(F.substr("label", F.lit(-1)) == A.SINK, F.lit(None)).otherwise(F.col("to_node")))
