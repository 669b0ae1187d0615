"""K-mer files: text and binary sources and sinks, patterns, mappings.

A row is a path of k labels: file, label (digits), preds and succs (bit sets), from_node, to_node
(null where the path can't be extended).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import nodeid as N
from ..operators.ranking import kept, kept_in_order, shared_folder

SCHEMA = "file int, label string, preds int, succs int, from_node long, to_node long"
#: Largest k of packed keys; suffixes that base names get, binary and text.
MAX_K, BINARY, TEXT = 16, ".graph", ".kmers"
#: A section's header: flags, records, k.
_HEADER = "<QQQ"
_NO_NODE = -1  # all bits set
#: Bytes of a part of a binary file that a task writes at once.
CHUNK = 4 << 20


def from_lines(lines: DataFrame, value: str = "value", file: Column | int = 0) -> DataFrame:
    """Rows of text lines: k-mer, from, predecessors, successors and a comma list of targets, tab separated.

    Lines with another number of fields are skipped; every target makes a row.
    """
    f = F.split(F.col(value), "\t", -1)
    rows = lines.withColumn("__f", f).where(F.size("__f") == 5).withColumn("__to", F.explode(F.split(F.col("__f")[4], ",")))
    cells = [F.col("__f")[i] for i in range(4)]
    out = rows.select(
        (file if isinstance(file, Column) else F.lit(file)).cast("int").alias("file"), A.encode(cells[0]).alias("label"), A.char_set(cells[2]).alias("preds"),
        A.char_set(cells[3]).alias("succs"), N.parse(cells[1]).alias("from_node"), N.parse("__to").alias("to_node"),
    )
    return mark_sinks(out)


def mark_sinks(kmers: DataFrame) -> DataFrame:
    """Rows whose label ends in the sink lose their target: they can't be extended."""
    return kmers.withColumn("to_node", F.when(F.substr("label", F.lit(-1)) == A.SINK, F.lit(None)).otherwise(F.col("to_node")).cast("long"))


def checked(kmers: DataFrame, max_k: int = MAX_K) -> int:
    """The common length of all labels; raises if there is none, or it is no number from 1 to ``max_k``."""
    found = common_length(kmers, max_k).first()
    if found["k"] is None:
        raise ValueError(f"labels must have one length from 1 to {max_k}; found {found['least']} to {found['most']}")
    return found["k"]


def common_length(kmers: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """One row: least and most digits of a label, and k if they are one number from 1 to ``max_k``."""
    sizes = kmers.agg(F.min(F.length("label")).alias("least"), F.max(F.length("label")).alias("most"))
    return sizes.select("least", "most", F.when((F.col("least") == F.col("most")) & F.col("most").between(1, max_k), F.col("most")).alias("k"))


def read_text(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """K-mers of text files; ``file`` is a path's place in the list."""
    parts = [from_lines(spark.read.text(p), file=k) for k, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths_of(names: Sequence[str], text: bool) -> list[str]:
    """Paths of k-mer files by name, or by base name without its suffix."""
    return [n if os.path.splitext(n)[1] else n + (TEXT if text else BINARY) for n in names]


def _words(spark: SparkSession, path: str, words: int) -> DataFrame:
    """pos, w0, w1, ... of a file of rows of 64-bit little-endian numbers. The file is split at any row, and read by Spark's own file systems."""

    def numbered(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
        for raw, pos in rows:
            yield (pos, *struct.unpack(f"<{words}q", raw))

    rows = spark.sparkContext.binaryRecords(path, 8 * words).zipWithIndex().mapPartitions(numbered)
    return spark.createDataFrame(rows, "pos long, " + ", ".join(f"w{k} long" for k in range(words)), verifySchema=False)


def _sections(rows: DataFrame) -> tuple[list[int], int | None]:
    """Places of the headers of a binary file's sections and their k; raises where the chain of sections breaks.

    A header is as long as a record. Rows that look like one (flags 0, a possible k) come to the driver: one for each section, and records without sets and digits.
    """
    last = rows.agg(F.max("pos")).first()[0]
    heads = {r["pos"]: (r["w1"], r["w2"]) for r in rows.where((F.col("w0") == 0) & F.col("w2").between(1, MAX_K)).collect()}
    at, found, k = 0, [], None
    while last is not None and at <= last:
        count, size = heads.get(at, (-1, None))
        if count < 0 or k not in (None, size) or at + count > last:
            raise ValueError("no valid k-mer section")
        found.append(at)
        at, k = at + 1 + count, size
    return found, k


def read_binary(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """K-mers of binary files: sections of a header (flags 0, number of records, k) and records of key, from and to. ``file`` is a path's place in the list."""
    out = spark.createDataFrame([], SCHEMA)
    for file, path in enumerate(paths):
        rows = _words(spark, path, 3)
        heads, k = _sections(rows)
        if k is None:
            continue
        at = spark.createDataFrame([(h,) for h in heads], "pos long")
        records = rows.join(F.broadcast(at), "pos", "left_anti")
        to = F.when(F.col("w2") != _NO_NODE, F.col("w2"))
        out = out.unionByName(records.select(F.lit(file).cast("int").alias("file"), A.unpack("w0", k).alias("label"), A.key_preds("w0").alias("preds"), A.key_succs("w0").alias("succs"), F.col("w1").alias("from_node"), to.alias("to_node")))
    return mark_sinks(out)


def _joined(rows: DataFrame, path: str, header: bytes) -> None:
    """A file of any of Spark's file systems: ``header``, then the rows of longs as little-endian bytes, in the order of the rows' partitions.

    Tasks write parts of CHUNK bytes, about, as one line each to the shared folder; the driver's file system client strings them together,
    since not all file systems can. No bytes come to the driver as results.
    """
    spark, parts = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/parts-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], names=["content"])
        for b in batches:
            for at in range(0, b.num_rows, CHUNK // 64):
                own.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.slice(at, CHUNK // 64).columns], 1).astype("<i8").tobytes())
                size += len(own[-1])
                if size >= CHUNK:
                    yield row()
                    own, size = [], 0
        if own:
            yield row()

    rows.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    found = [(re.match(r"part-(\d+)-.*-c(\d+)\.txt$", f.getPath().getName()), f) for f in fs.listStatus(folder)]
    out = to.getFileSystem(conf).create(to, True)
    try:
        out.write(bytearray(header))
        for _, f in sorted((((int(m[1]), int(m[2])), f) for m, f in found if m and f.getLen() > 1), key=lambda x: x[0]):
            part = fs.open(f.getPath())
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, f.getLen() - 1)  # without the line's end
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def binary_records(kmers: DataFrame) -> DataFrame:
    """file and key, from_node, to_node as a binary file holds them."""
    return kmers.select("file", A.pack("label", "preds", "succs").alias("key"), "from_node", F.coalesce("to_node", F.lit(_NO_NODE)).cast("long").alias("to_node"))


def write_binary(kmers: DataFrame, path: str, k: int | None = None) -> str:
    """One binary file of one section, whatever the ``file`` of the rows; written in parts by the tasks, which the driver strings together."""
    rows = kept(binary_records(kmers).drop("file"))
    header = struct.pack(_HEADER, 0, rows.count(), k or checked(kmers))
    _joined(rows, path, header)
    return path


def export_binary(kmers: DataFrame, base: str) -> str:
    """The file ``base.graph``."""
    return write_binary(kmers, base + BINARY)


def convert(spark: SparkSession, names: Sequence[str]) -> list[str]:
    """A binary file beside each text file."""
    return [export_binary(read_text(spark, [p]), os.path.splitext(p)[0]) for p in paths_of(names, True)]


def to_lines(kmers: DataFrame) -> DataFrame:
    """Text lines of k-mers, one for each start: its targets in a comma list."""
    chars = lambda bits: F.array_join(F.filter(F.array(*[F.when(A.has_bit(bits, d), A.CHARACTERS[d]).otherwise("") for d in range(A.SIGMA)]), lambda c: c != ""), ",")
    grouped = kmers.groupBy("file", "label", "preds", "succs", "from_node").agg(F.array_join(F.array_sort(F.collect_set(N.show(F.coalesce("to_node", F.lit(0))))), ",").alias("to"))
    return grouped.select("file", F.concat_ws("\t", A.decode("label"), N.show("from_node"), chars("preds"), chars("succs"), "to").alias("value"))


def stats(kmers: DataFrame) -> DataFrame:
    """Rows and range of label lengths by file."""
    return kmers.groupBy("file").agg(F.count("*").alias("kmers"), F.min(F.length("label")).alias("min_k"), F.max(F.length("label")).alias("max_k"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern of every line of a file that isn't empty or all N."""
    return useful_patterns(spark.read.text(path).withColumnRenamed("value", "pattern"))


def useful_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns that aren't empty and don't consist of N alone."""
    return patterns.where(~F.col("pattern").rlike("^N*$"))


def pattern_totals(patterns: DataFrame) -> DataFrame:
    """One row: patterns and their characters."""
    return patterns.agg(F.count("*").alias("patterns"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("characters"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """id, mapped of a binary mapping file: first id, next id, and a new id for each from the first to before the next."""
    rows = _words(spark, path, 1)
    head = {r["pos"]: r["w0"] for r in rows.where("pos < 2").collect()}
    size = rows.count()
    if len(head) < 2 or head[1] < head[0] or size < 2 + head[1] - head[0]:
        raise ValueError("no valid mapping")
    return rows.where(F.col("pos").between(2, 1 + head[1] - head[0])).select((F.col("pos") - 2 + head[0]).alias("id"), F.col("w0").alias("mapped"))


def write_mapping(mapping: DataFrame, path: str) -> str:
    """A binary mapping file of mapping(id, mapped); ids between the first and the last that it lacks map to themselves."""
    first, last = mapping.agg(F.min("id"), F.max("id")).first()
    first, end = (0, 0) if first is None else (first, last + 1)
    spark = mapping.sparkSession
    every = spark.range(first, end).join(mapping, "id", "left").select("id", F.coalesce("mapped", "id").alias("mapped"))
    ordered = kept_in_order(every.repartitionByRange("id").sortWithinPartitions("id")).select("mapped")
    _joined(ordered, path, struct.pack("<qq", first, end))
    return path


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, kmer of the k-mers of one of two tables of distinct kmer alone."""
    only = lambda side, a, b: a.join(b, "kmer", "left_anti").select(F.lit(side).alias("side"), A.decode("kmer").alias("kmer"))
    return only("left", left, right).unionByName(only("right", right, left))
