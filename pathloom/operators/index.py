"""The path index: tables, building, saving, loading, statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import nodeid as N
from . import paths as P
from .ranking import kept, ranked_among

#: Versions from FIRST on can be read; those before 2 lack the blocks of edges, which are made again.
TAG, VERSION, FIRST = "pathloom-index", 2, 1
#: Rows of a bucket of path ids, for joins of id ranges; ids of a block of edges; blocks of a group.
BUCKET, EDGE_BLOCK, GROUP = 1024, 256, 1024
TABLES = ("nodes", "node_values", "edges", "edge_blocks", "lcp", "key_ranges", "redundancy", "samples", "meta", "occurrences")


class Later:
    """A table that is made when it is first asked for, once."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.made = make, None

    def get(self) -> DataFrame:
        if self.made is None:
            self.made = self.make()
        return self.made


@dataclass
class PathIndex:
    """nodes(path_id, key, preds), node_values(path_id, node), edges(src, dst, comp), lcp(path_id, lcp),

    edge_blocks(comp, block, prev, next): for every digit and block of ids the last edge before and the first one behind it,
    key_ranges(prefix, sp, ep): the nodes below the empty prefix, each first digit and each prefix at which keys branch, redundancy(path_id, a_cum, r_cum): running sums of
    further starts and of repeats, samples(path_id, node), meta(one row), occurrences(label, file, from_node): full-length labels, optional;
    labels(label, rnk, path_id): the distinct ones in order, if the build found them, not saved. A table given as ``Later`` is made when it is asked for.
    """

    nodes: DataFrame
    node_values: DataFrame
    edges: DataFrame
    edge_blocks: DataFrame
    lcp: DataFrame
    key_ranges: DataFrame
    redundancy: DataFrame
    samples: DataFrame
    meta: DataFrame
    occurrences: DataFrame | None = None
    labels: DataFrame | None = None
    #: What the build knows of meta before it is made.
    head: tuple[int, int] | None = None

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        return value.get() if isinstance(value, Later) else value

    @property
    def size(self) -> int:
        return self.head[0] if self.head else self.meta.first()["path_nodes"]

    @property
    def order(self) -> int:
        return self.head[1] if self.head else self.meta.first()["order"]

    def save(self, path: str) -> None:
        """Parquet tables below ``path``."""
        for name in TABLES:
            if (df := getattr(self, name)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PathIndex:
        """A saved index; raises on another tag, version or flags."""
        meta = spark.read.parquet(f"{path}/meta").first()
        if state(meta["tag"], meta["version"], meta["flags"]) != "readable":
            raise RuntimeError(f"{path}: {state(meta['tag'], meta['version'], meta['flags'])}; this is version {VERSION}")
        tables = {n: _optional(spark, f"{path}/{n}") if n in ("occurrences", "edge_blocks") else spark.read.parquet(f"{path}/{n}") for n in TABLES}
        if tables["edge_blocks"] is None:
            tables["edge_blocks"] = kept(edge_blocks_of(tables["edges"], meta["path_nodes"]))
        return cls(**tables)


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        return None


def state(tag: str, version: int, flags: int) -> str:
    """Whether an index of this header can be read: readable, no index, unknown flags, too old or too new."""
    return "no index" if tag != TAG else "unknown flags" if flags else "too old" if version < FIRST else "too new" if version > VERSION else "readable"


def edges_of(nodes: DataFrame) -> DataFrame:
    """src, dst, comp: for each node and predecessor character the node whose key is a prefix of character and key.

    It is the greatest key that isn't greater, if any: ids are dense in the order of keys, so the source is the text's rank among them. Predecessors
    that aren't in the graph, as before its sources, have no node.
    """
    digits = F.array(*[F.lit(str(d)) for d in range(A.SIGMA)])
    steps = nodes.select(F.col("path_id").alias("dst"), "key", F.explode(F.filter(digits, lambda d: A.has_bit("preds", d))).alias("comp"))
    met = ranked_among(nodes, "key", steps.select("dst", "comp", F.concat("comp", "key").alias("text")), "text", "n")
    there = met.withColumn("src", F.col("n") - 1).join(nodes.select(F.col("path_id").alias("src"), F.col("key").alias("own")), "src")
    return there.where(F.col("text").startswith(F.col("own"))).select("src", "dst", F.col("comp").cast("int").alias("comp"))


def edge_blocks_of(edges: DataFrame, total: int) -> DataFrame:
    """comp, block, prev, next (struct of dst, src): for every digit and block of EDGE_BLOCK ids the last edge before the block and the first one behind it.

    Found within groups of blocks, and between groups from one row for each.
    """
    from pyspark.sql import Window

    ends = edges.groupBy("comp", F.floor(F.col("dst") / EDGE_BLOCK).cast("long").alias("block")).agg(F.min(F.struct("dst", "src")).alias("first"), F.max(F.struct("dst", "src")).alias("last"))
    digits = F.array(*[F.lit(d) for d in range(A.SIGMA)])

    def around(rows: DataFrame, size: int, at: str, of: list[str]) -> DataFrame:
        """All places of a digit, with what lies before and behind within ``of``."""
        every = rows.sparkSession.range(size).select(F.col("id").alias(at), F.explode(digits).alias("comp"))
        w = Window.partitionBy("comp", *of).orderBy(at)
        grid = every.join(rows, ["comp", at], "left")
        grid = grid.withColumn("grp", F.floor(F.col(at) / GROUP).cast("long")) if of else grid
        before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        return grid.select("comp", at, *of, F.last("last", ignorenulls=True).over(before).alias("prev"), F.first("first", ignorenulls=True).over(behind).alias("next"))

    blocks = -(-total // EDGE_BLOCK)
    groups = ends.groupBy("comp", F.floor(F.col("block") / GROUP).cast("long").alias("grp")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    outer = around(groups, -(-blocks // GROUP), "grp", []).select("comp", "grp", F.col("prev").alias("p"), F.col("next").alias("n"))
    inner = around(ends, blocks, "block", ["grp"])
    return inner.join(outer, ["comp", "grp"]).select("comp", "block", F.coalesce("prev", "p").alias("prev"), F.coalesce("next", "n").alias("next"))


def lcp_of(nodes: DataFrame) -> DataFrame:
    """path_id and lcp with the key before it (0 for the first). Neighbours meet by id: no global window."""
    before = nodes.select((F.col("path_id") + 1).alias("path_id"), F.col("key").alias("before"))
    return nodes.join(before, "path_id", "left").select("path_id", F.coalesce(A.lcp("before", "key"), F.lit(0)).alias("lcp"))


def branching_prefixes(nodes: DataFrame) -> DataFrame:
    """prefix: the empty one, every first digit, and what neighbouring keys have in common; so each prefix at which keys branch."""
    before = nodes.select((F.col("path_id") + 1).alias("path_id"), F.col("key").alias("before"))
    shared = nodes.join(before, "path_id").select(F.substr("before", F.lit(1), A.lcp("before", "key")).alias("prefix"))
    first = nodes.select(F.explode(F.array(F.lit(""), F.substr("key", F.lit(1), F.lit(1)))).alias("prefix"))
    return shared.unionByName(first).distinct()


def ranges_of(nodes: DataFrame, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``prefixes`` with sp, ep: the first and last node whose key starts with the prefix (sp > ep if there is none), by the ranks of its borders among the keys."""
    # ":" follows the digits, so all keys with the prefix lie between it and prefix + ":"; the lower border is put just before the prefix itself
    low = ranked_among(nodes.select(F.concat("key", F.lit("!")).alias("key")), "key", prefixes, prefix, "sp")
    high = ranked_among(nodes, "key", low.withColumn("__high", F.concat(prefix, F.lit(":"))), "__high", "ep")
    return high.select(*prefixes.columns, "sp", (F.col("ep") - 1).alias("ep"))


def key_ranges_of(nodes: DataFrame) -> DataFrame:
    """prefix, sp, ep of the prefixes at which keys branch."""
    return ranges_of(nodes, branching_prefixes(nodes))


def redundancy_of(nodes: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """path_id, a_cum, r_cum: running sums of the starts beyond the first of each node and of the repeats.

    Two next occurrences of a start count as one repeat at their lowest common ancestor: the common prefix of their keys.
    It is counted one before the first place inside the ancestor's range where the LCP is the prefix's length.
    """
    from pyspark.sql import Window

    keyed = values.join(nodes.select("path_id", "key"), "path_id")
    w = Window.partitionBy("node").orderBy("path_id")
    pairs = keyed.select(F.lag("key").over(w).alias("before"), "key").where("before IS NOT NULL")
    at = lambda a, b: F.substr(b, F.lit(1), A.lcp(a, b)).alias("prefix")
    repeats = pairs.select(at("before", F.col("key"))).groupBy("prefix").agg(F.count("*").alias("r"))
    before = nodes.select((F.col("path_id") + 1).alias("path_id"), F.col("key").alias("before"))
    firsts = nodes.join(before, "path_id").select("path_id", at("before", F.col("key"))).groupBy("prefix").agg((F.min("path_id") - 1).alias("path_id"))
    r = repeats.join(firsts, "prefix").groupBy("path_id").agg(F.sum("r").alias("r"))
    a = values.groupBy("path_id").agg((F.count("*") - 1).alias("a"))
    rows = nodes.select("path_id").join(a, "path_id", "left").join(r, "path_id", "left").fillna(0)
    return running_sums(rows, "path_id", total, {"a": "a_cum", "r": "r_cum"})


def running_sums(rows: DataFrame, by: str, total: int, sums: dict[str, str]) -> DataFrame:
    """Running sums of columns over dense ids: within blocks by a window, before them by the blocks' sums.

    The blocks' sums are a table of ``total / size`` rows whose own running sum is taken the same way while it is large.
    """
    from pyspark.sql import Window

    size, own = 1 << 14, f"{by}_block"
    rows = rows.withColumn(own, F.floor(F.col(by) / size).cast("long"))
    w = Window.partitionBy(own).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select(by, own, *[F.sum(c).over(w).alias(n) for c, n in sums.items()])
    if total <= size:
        return inner.select(by, *sums.values())
    blocks = rows.groupBy(own).agg(*[F.sum(c).alias(c) for c in sums])
    outer = running_sums(blocks, own, -(-total // size), {c: f"__{n}" for c, n in sums.items()}).withColumn(own, F.col(own) + 1)
    return inner.join(outer, own, "left").select(by, *[(F.col(n) + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in sums.values()])


def samples_of(nodes: DataFrame, values: DataFrame, edges: DataFrame, period: int) -> DataFrame:
    """path_id and node of the nodes whose starts can't be derived from a predecessor.

    Sampled are nodes with several predecessors or the sink before them, with a start that the period divides, or whose
    starts aren't those of their only predecessor plus one each. Sets of starts are compared by digest.
    """
    sets = values.groupBy("path_id").agg(P.set_digest(F.col("node"), "own"), P.set_digest(F.col("node") + 1, "next"), F.bool_or(F.col("node") % period == 0).alias("marked"))
    before = edges.join(sets.select(F.col("path_id").alias("src"), "next"), "src").groupBy(F.col("dst").alias("path_id")).agg(F.min("next").alias("prev"))
    rows = nodes.join(sets.select("path_id", "own", "marked"), "path_id").join(before, "path_id", "left")
    simple = (F.bit_count(F.col("preds")) > 1) | A.has_bit("preds", 0) | F.col("marked")
    chosen = rows.where(simple | F.col("prev").isNull() | (F.col("prev") != F.col("own")))
    return values.join(chosen.select("path_id"), "path_id")


def build_index(kmers: DataFrame, steps: int = 4, mapping: DataFrame | None = None, sample_period: int = 1024, occurrences: bool = False, max_rows: int | None = None, max_bytes: int | None = None) -> PathIndex:
    """The index of k-mers after ``steps`` doublings (1 to 4). With ``occurrences``, also all full-length labels."""
    if not 1 <= steps <= 4:
        raise ValueError("1 to 4 doubling steps")
    first = kept(P.initial_paths(kmers))
    k = first.agg(F.max(F.length("label"))).first()[0] or 0
    if not occurrences:
        nodes, values = P.merge(mapped_starts(P.double(first, steps, max_rows=max_rows, max_bytes=max_bytes), mapping))
        return index_of(nodes, values, k, steps, sample_period)
    long, alike = P.double_whole(first, steps, max_rows=max_rows, max_bytes=max_bytes)
    padded = mapped_starts(long.select(F.rpad("label", k << steps, A.SINK).alias("label"), "file", "from_node", "preds"), mapping)
    whole = kept(padded.groupBy("label", "file", "from_node").agg(F.bit_or("preds").alias("preds")))
    full = whole.select("label", "file", "from_node")
    if not alike:
        nodes, values = P.merge(mapped_starts(P.double(first, steps, max_rows=max_rows, max_bytes=max_bytes), mapping))
        return index_of(nodes, values, k, steps, sample_period, full)
    files = whole.agg(F.min("file"), F.max("file")).first()
    starts = whole if files[0] == files[1] else kept(whole.groupBy("label", "from_node").agg(F.bit_or("preds").alias("preds")))
    nodes, values, labels = P.merge_starts(starts.select("label", "from_node", "preds"))
    return index_of(nodes, values, k, steps, sample_period, full, labels)


def mapped_starts(rows: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """``rows`` with mapped start nodes."""
    return rows if mapping is None else N.mapped(rows, mapping, "from_node")


def index_of(nodes: DataFrame, values: DataFrame, k: int, steps: int, sample_period: int = 1024, full: DataFrame | None = None, labels: DataFrame | None = None) -> PathIndex:
    """An index of merged nodes. Tables beyond these are made when they are first asked for: a search needs few of them."""
    total = nodes.count()
    edges = Later(lambda: kept(edges_of(nodes)))
    sampled = Later(lambda: kept(samples_of(nodes, values, edges.get(), sample_period)))

    def meta() -> DataFrame:
        one = sampled.get().agg(F.countDistinct("path_id").alias("sampled_positions"), F.count("*").alias("sample_count"), F.coalesce(F.max(F.length(F.bin("node"))), F.lit(1)).cast("long").alias("sample_bits")).first()
        return kept(nodes.sparkSession.createDataFrame(
            [(TAG, VERSION, total, edges.get().count(), k << steps, k, A.SIGMA, one[0], one[1], one[2], 0)],
            "tag string, version int, path_nodes long, edges long, order int, base_k int, sigma int, sampled_positions long, sample_count long, sample_bits long, flags int",
        ))

    blocks, lcp, ranges = Later(lambda: kept(edge_blocks_of(edges.get(), total))), Later(lambda: kept(lcp_of(nodes))), Later(lambda: kept(key_ranges_of(nodes)))
    return PathIndex(nodes, values, edges, blocks, lcp, ranges, Later(lambda: kept(redundancy_of(nodes, values, total))), sampled, Later(meta), full, labels, (total, k << steps))


def statistics(index: PathIndex) -> DataFrame:
    """One row: paths, edges, samples, sampled positions, bits of a sample, longest exact pattern."""
    return index.meta.select("path_nodes", "edges", "sample_count", "sampled_positions", "sample_bits", F.col("order").alias("max_query"))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """The header of a saved index of any version, its ``state`` and whether this version can read it."""
    head = spark.read.parquet(f"{path}/meta")
    now = F.when(F.col("tag") != TAG, "no index").when(F.col("flags") != 0, "unknown flags").when(F.col("version") < FIRST, "too old").when(F.col("version") > VERSION, "too new").otherwise("readable")
    return head.withColumn("state", now).withColumn("readable", F.col("state") == "readable")
