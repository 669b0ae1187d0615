"""Path generations: distinct keys, ranks, pruning by prefix groups, extension by doubling, merging.

A generation is paths(file, label, from_node, to_node, preds); a null target means the path is final.

The key of a path is the shortest prefix of its label such that all labels with that prefix have the same value.
There are two ways to it, both without a one-task sort or window:

* short labels: all prefixes of all labels are grouped in one shuffle with partial aggregation (least and greatest value),
  so short prefixes, which all rows share, shrink before the shuffle;
* labels over PREFIXES digits: labels are sorted by range partitions, and a label is compared with the nearest labels of other values, before
  and after its run of equal values (``ordered``). The work doesn't grow with the square of the length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import nodeid as N
from .ordered import ordered
from .ranking import dense_ids, kept

#: Longest labels whose keys are found by grouping prefixes.
PREFIXES = 12
PATHS = ("file", "label", "from_node", "to_node", "preds")


def distinct_keys(kmers: DataFrame) -> DataFrame:
    """label, preds, succs: distinct labels with their sets united."""
    return kmers.groupBy("label").agg(F.bit_or("preds").alias("preds"), F.bit_or("succs").alias("succs"))


def distinct_starts(kmers: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """node: distinct start nodes, after mapping."""
    rows = kmers.select(F.col("from_node").alias("node"))
    return (N.mapped(rows, mapping, "node") if mapping is not None else rows).distinct()


def ranked_labels(kmers: DataFrame) -> DataFrame:
    """label, preds, succs and rnk: the place of each distinct label in their order, from 0."""
    return dense_ids(distinct_keys(kmers), ["label"], "rnk")


def initial_paths(kmers: DataFrame) -> DataFrame:
    """The first generation."""
    return kmers.select(*PATHS)


def shortest_keys(values: DataFrame) -> DataFrame:
    """label and key of every label that has one value; values(label, value) may have several rows for a label."""
    one = kept(values.groupBy("label").agg(F.min("value").alias("low"), F.max("value").alias("high")).select("label", F.when(F.col("low") == F.col("high"), F.col("low")).alias("value")))
    longest = one.agg(F.max(F.length("label"))).first()[0] or 0
    return keys_by_borders(one) if longest > PREFIXES else keys_by_prefixes(one)


def keys_by_prefixes(one: DataFrame) -> DataFrame:
    """``shortest_keys`` of one row for each label, value null where it has several, by grouping all prefixes."""
    spread = one.select("label", "value", F.explode(A.prefixes("label")).alias("prefix"))
    alike = spread.groupBy("prefix").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.bool_or(F.col("value").isNull()).alias("none")).where("a = b AND NOT none").select("prefix")
    return spread.select("label", "prefix").join(alike, "prefix").groupBy("label").agg(F.min_by("prefix", F.length("prefix")).alias("key"))


def numbered_runs(rows: DataFrame, value: str) -> DataFrame:
    """rows(id, ...), id dense from 0, with run: the number (from 1) of the run of equal values, one after another, that a row is in. A null value is a run of its own."""
    from .index import running_sums

    before = rows.select((F.col("id") + 1).alias("id"), F.col(value).alias("__before"), F.lit(True).alias("__there"))
    starts = kept(rows.join(before, "id", "left").select(*rows.columns, F.when(F.col("__there") & (F.col(value) == F.col("__before")), 0).otherwise(1).alias("__start")))
    runs = running_sums(starts.select("id", "__start"), "id", starts.count(), {"__start": "run"})
    return kept(starts.join(runs, "id").select(*rows.columns, "run"))


def keys_by_borders(one: DataFrame) -> DataFrame:
    """As ``keys_by_prefixes``, by comparing each label with the nearest ones of other values."""
    return ordered(one.select("label", "value")).where("key IS NOT NULL").select("label", "key")


def prune(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The generation with redundant paths merged, and its counters by kind.

    Labels with one start in one file are cut to their key and become final, one path for each key. Labels with one start in several
    files become final and keep a path each. All others stay as they are.
    """
    starts = paths.groupBy("label").agg((F.min("from_node") == F.max("from_node")).alias("one"), (F.min("file") == F.max("file")).alias("own"))
    value = paths.select("label", F.struct("from_node", "file").alias("value"))
    keys = shortest_keys(value)
    rows = paths.join(starts, "label").join(keys, "label", "left")
    unique = F.col("one") & F.col("own")
    marked = rows.withColumn("kind", F.when(unique, "unique").when(F.col("one"), "redundant").when(F.col("to_node").isNull(), "nondeterministic").otherwise("unsorted"))
    marked = kept(marked)
    merged = marked.where("kind = 'unique'").groupBy("file", F.col("key").alias("label"), "from_node").agg(F.bit_or("preds").alias("preds")).withColumn("to_node", F.lit(None).cast("long"))
    final = marked.where("kind = 'redundant'").withColumn("to_node", F.lit(None).cast("long"))
    same = marked.where("kind IN ('nondeterministic', 'unsorted')")
    out = merged.select(*PATHS).unionByName(final.select(*PATHS)).unionByName(same.select(*PATHS))
    counts = merged.select(F.lit("unique").alias("kind")).unionByName(marked.where("kind <> 'unique'").select("kind")).groupBy("kind").agg(F.count("*").alias("paths"))
    return kept(out), counts


def ranges(paths: DataFrame) -> DataFrame:
    """One row: how many different labels a generation has, and how many of them several paths share."""
    return paths.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("ranges"), F.count_if(F.col("n") > 1).alias("shared"))


def extend(paths: DataFrame, lost: bool = False) -> DataFrame:
    """Paths that aren't final joined with those that start at their target in the same file; final ones as they are. With ``lost``, also those that meet none, marked by ``__lost``."""
    left = paths.where("to_node IS NOT NULL")
    right = paths.select("file", F.col("from_node").alias("__at"), F.col("label").alias("__label"), F.col("to_node").alias("__to"))
    joined = left.join(right, (left.file == right.file) & (left.to_node == right["__at"]), "left" if lost else "inner").select(left.file, F.concat(left.label, "__label").alias("label"), left.from_node, F.col("__to").alias("to_node"), left.preds, F.col("__at").isNull().alias("__lost"))
    if lost:
        return paths.where("to_node IS NULL").withColumn("__lost", F.lit(False)).unionByName(joined)
    return paths.where("to_node IS NULL").unionByName(joined.drop("__lost"))


def extension_fanout(paths: DataFrame) -> DataFrame:
    """file, label, from_node, to_node and fanout: how many paths an extension would make of each path that isn't final."""
    starts = paths.groupBy("file", F.col("from_node").alias("__at")).agg(F.count("*").alias("fanout"))
    left = paths.where("to_node IS NOT NULL")
    return left.join(starts, (left.file == starts.file) & (left.to_node == starts["__at"]), "left").select(left.file, "label", "from_node", "to_node", F.coalesce("fanout", F.lit(0)).cast("long").alias("fanout"))


def extended_size(paths: DataFrame) -> tuple[int, int]:
    """Rows and label bytes of the next generation, from counts of starts alone, before anything is joined."""
    fan = extension_fanout(paths).select(F.col("fanout").alias("n"), (F.col("fanout") * F.length("label") * 2).alias("bytes"))
    final = paths.where("to_node IS NULL").select(F.lit(1).cast("long").alias("n"), F.length("label").cast("long").alias("bytes"))
    return tuple(fan.unionByName(final).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first())


def double(paths: DataFrame, steps: int, pruned: bool = True, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Generations of prune and extend; without ``pruned``, all full-length paths.

    ``max_rows`` and ``max_bytes`` (of labels) raise before a larger generation is written.
    """
    for _ in range(steps):
        paths = prune(paths)[0] if pruned else paths
        guarded(paths, max_rows, max_bytes)
        paths = kept(extend(paths))
    return paths


def guarded(paths: DataFrame, max_rows: int | None, max_bytes: int | None) -> None:
    """Raises if the next generation would be larger."""
    if max_rows is not None or max_bytes is not None:
        rows, size = extended_size(paths)
        if max_rows is not None and rows > max_rows:
            raise MemoryError(f"{rows} paths, more than {max_rows}; prune the graph first")
        if max_bytes is not None and size > max_bytes:
            raise MemoryError(f"{size} bytes of labels, more than {max_bytes}; prune the graph first")


def set_digest(node, n: str = "value"):
    """A value by which sets of distinct nodes are compared without being gathered: their number and two sums (bit by bit) of unlike 64-bit hashes."""
    return F.struct(F.count(node).alias("n"), F.bit_xor(F.xxhash64(F.lit(1), node)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), node)).alias("h2")).alias(n)


def double_whole(paths: DataFrame, steps: int, max_rows: int | None = None, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """``double`` without pruning, and whether pruning would change nothing in what ``merge`` gives.

    It wouldn't if labels have one length, the sink's digit only at their end, end in it where they are final, and no path has a target without paths: then every path
    that pruning cuts and ends goes on, and all that it goes on to has its start.
    """
    label = F.col("label")
    odd = F.count_if(label.rlike(f"{A.SINK}[^{A.SINK}]") | (F.col("to_node").isNull() & ~label.endswith(A.SINK)))
    one = paths.agg((F.min(F.length("label")) == F.max(F.length("label"))).alias("same"), odd.alias("odd")).first()
    alike = bool(one["same"]) and one["odd"] == 0
    for step in range(steps):
        guarded(paths, max_rows, max_bytes)
        if step == 0 and alike:
            grown = kept(extend(paths, lost=True))
            alike = grown.where("__lost").isEmpty()
            paths = grown.where("NOT __lost").drop("__lost")
        else:
            paths = kept(extend(paths))
    return paths, alike


def merge(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(path_id, key, preds) and node_values(path_id, node) of the maximally pruned graph.

    The value of a label is its set of starts, compared by digest; labels with one prefix and one set become one node.
    """
    nodes, values, _ = merge_starts(kept(paths.groupBy("label", "from_node").agg(F.bit_or("preds").alias("preds"))))
    return nodes, values


def merge_starts(starts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``merge`` of starts(label, from_node, preds), a row for each label and start; and label, rnk, path_id of the labels in order, if their ranks were found on the way."""
    sets = kept(starts.groupBy("label").agg(set_digest(F.col("from_node")), F.bit_or("preds").alias("preds")))
    longest = sets.agg(F.max(F.length("label"))).first()[0] or 0
    if longest > PREFIXES:
        keyed = ordered(sets, ("preds",))
        nodes = kept(keyed.groupBy("path_id", "key").agg(F.bit_or("preds").alias("preds")))
        labels = keyed.select("label", "rnk", "path_id")
        return nodes, kept(starts.join(labels, "label").select("path_id", F.col("from_node").alias("node")).distinct()), labels
    keyed = kept(sets.join(keys_by_prefixes(sets.select("label", "value")), "label").select("label", "key", "preds"))
    nodes = kept(dense_ids(keyed.groupBy("key").agg(F.bit_or("preds").alias("preds")), ["key"], "path_id").select("path_id", "key", "preds"))
    there = keyed.join(nodes.select("path_id", "key"), "key").select("label", "path_id")
    return nodes, kept(starts.join(there, "label").select("path_id", F.col("from_node").alias("node")).distinct()), None
