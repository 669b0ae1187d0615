"""Command line: ``python -m pathloom.cli build|query|count|describe|convert|fanout|version ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alphabet as A
from .functions import report
from .operators import index as I
from .operators import kmercount as K
from .operators import paths as P
from .operators import search as S
from .operators import suffixtree as T
from .operators import verify as V
from .sources import kmers as R


def read(spark: SparkSession, names: list[str], text: bool) -> DataFrame:
    """K-mers of files, by name or by base name without its suffix."""
    paths = R.paths_of(names, text)
    return R.read_text(spark, paths) if text else R.read_binary(spark, paths)


def build(spark: SparkSession, args: argparse.Namespace) -> int:
    kmers = read(spark, args.names, args.text)
    R.checked(kmers)
    mapping = None if not args.mapping else R.read_mapping(spark, args.mapping) if args.mapping.endswith(".mapping") else spark.read.parquet(args.mapping)
    if args.load:
        index = I.PathIndex.load(spark, args.load)
    else:
        index = I.build_index(kmers, args.doublings, mapping, args.sample_period, occurrences=True, max_rows=args.max_rows, max_bytes=args.max_bytes)
    index.save(args.output or args.names[0])
    I.statistics(index).show()
    if args.verify:
        bad = V.failures(index, I.mapped_starts(kmers, mapping)).collect()
        for row in bad:
            print(f"{row.what}: {row.label}")
        return int(bool(bad))
    return 0


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    index = I.PathIndex.load(spark, args.index)
    I.statistics(index).show()
    if not args.patterns:
        return 0
    patterns = R.read_patterns(spark, args.patterns).select(F.monotonically_increasing_id().alias("pid"), A.encode("pattern").alias("pattern"))
    found = S.find(index, patterns).where("sp <= ep").cache()
    up = T.parent(index, found.select("pid", "sp", "ep"))
    counts, located = S.count(index, found), S.locate(index, found).groupBy("pid").agg(F.count("*").alias("located"))
    row = counts.join(located, "pid", "left").agg(F.count("*").alias("found"), F.sum("n").alias("count"), F.sum("located").alias("located"), F.count_if(~F.col("n").eqNullSafe(F.col("located"))).alias("inconsistent")).first()
    depths = T.depth(index, up.select("pid", "sp", "ep")).agg(F.avg("depth")).first()[0]
    print(f"patterns {patterns.count()}, found {row.found}, occurrences {row['count']}, located {row.located}, inconsistent {row.inconsistent}, mean parent depth {depths}")
    return int(bool(row.inconsistent))


def count(spark: SparkSession, args: argparse.Namespace) -> int:
    indexes = [I.PathIndex.load(spark, n) for n in args.indexes]
    if len(indexes) == 1:
        print(K.count_kmers(indexes[0], args.k, args.with_n, args.force))
    else:
        K.compare_indexes(*indexes[:2], args.k, args.with_n, args.force, args.output).show()
    return 0


def describe(spark: SparkSession, args: argparse.Namespace) -> int:
    I.describe(spark, args.index).show(vertical=True, truncate=False)
    return 0


def convert(spark: SparkSession, args: argparse.Namespace) -> int:
    print(*R.convert(spark, args.names), sep="\n")
    return 0


def fanout(spark: SparkSession, args: argparse.Namespace) -> int:
    """Paths that an extension would multiply by 100 or more."""
    P.extension_fanout(P.initial_paths(read(spark, args.names, args.text))).where("fanout >= 100").show(truncate=False)
    return 0


def version(spark: SparkSession, args: argparse.Namespace) -> int:
    print(report.version())
    if report.level(args.verbosity) > 1:
        print("verbosity:", report.LEVELS[report.level(args.verbosity)])
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pathloom")
    sub = top.add_subparsers(required=True)

    def add(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, kw in options:
            p.add_argument(*flags, **kw)

    text = (("-t", "--text"), {"action": "store_true"})
    names = (("names",), {"nargs": "+"})
    k = [(("-k",), {"type": int, "default": 32}), (("-N", "--with-n"), {"action": "store_true"}), (("-f", "--force"), {"action": "store_true"}), (("-o", "--output"), {}), (("indexes",), {"nargs": "+"})]
    add("build", build, text, names, (("-o", "--output"), {}), (("-d", "--doublings"), {"type": int, "default": 4}), (("-m", "--mapping"), {}), (("-s", "--sample-period"), {"type": int, "default": 1024}), (("-v", "--verify"), {"action": "store_true"}), (("-l", "--max-rows"), {"type": int}), (("-D", "--max-bytes"), {"type": int}), (("-L", "--load"), {"help": "check a saved index instead of building one"}))
    add("version", version, (("-V", "--verbosity"), {"type": int, "default": 1}))
    add("query", query, (("index",), {}), (("patterns",), {"nargs": "?"}))
    add("count", count, *k)
    add("describe", describe, (("index",), {}))
    add("convert", convert, names)
    add("fanout", fanout, text, names)
    return top


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("pathloom").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
