"""Steps that grow with the input: what is made, joined and sent, and that the cheap ways give what the plain ones give."""

import itertools
import os
import random
import re
import struct

import pytest
from pathloom.operators import index as I
from pathloom.operators import ordered as O
from pathloom.operators import paths as P
from pathloom.operators import search as S
from pathloom.sources import fixtures as X
from pathloom.sources import kmers as R
from pyspark.sql import functions as F


def kmers(spark, n=12, dead=False):
    """K-mers of two digits of a ring with a few chords; with ``dead``, a chord leads to a node without successors."""
    rng = random.Random(n)
    nodes = [(0, i << 11, rng.choice("1234")) for i in range(1, n + 1)] + [(0, (n + 1) << 11, "5")] * dead
    edges = {(i, i % n + 1) for i in range(1, n + 1)} | {(2, 7), (5, 3)} | ({(4, n + 1)} if dead else set())
    return X.graph_kmers(X.Graph(spark.createDataFrame(nodes, "file int, node long, comp string"), spark.createDataFrame([(0, a << 11, b << 11) for a, b in edges], "file int, src long, dst long")), 2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most", [7, 40])
def test_keys_over_many_partitions(spark, monkeypatch, most):
    monkeypatch.setattr(O, "MOST", most)
    monkeypatch.setattr(O, "LEAST", most)
    rng = random.Random(most)
    labels = sorted({"".join(rng.choice("123") for _ in range(5)) for _ in range(150)})
    # long runs of one value, that fill whole partitions, and changes
    values = [None if 40 <= k < 43 else k // 30 if k < 90 else rng.randint(0, 2) for k in range(len(labels))]
    want = {}
    for t, v in zip(labels, values, strict=True):
        fit = (n for n in range(1, 6) if all(w == v for u, w in zip(labels, values, strict=True) if u.startswith(t[:n])))
        want[t] = t[: next(fit)] if v is not None else None
    one = spark.createDataFrame([(t, v, k) for k, (t, v) in enumerate(zip(labels, values, strict=True))], "label string, value long, own int").repartition(3)
    got = {r.label: r for r in O.ordered(one, ("own",)).collect()}
    assert {t: r.key for t, r in got.items()} == want
    assert all(got[t].rnk == k == got[t].own for k, t in enumerate(labels))
    keys = sorted({k for k in want.values() if k})
    full = O.ordered(one.where("value IS NOT NULL")).collect()
    assert sorted({r.key for r in full}) == [k for _, k in sorted({(r.path_id, r.key) for r in full})] and {r.path_id for r in full} == set(range(len({r.key for r in full})))
    assert keys


@pytest.mark.parametrize("dead", [False, True])
def test_unpruned_paths_give_the_nodes_that_pruned_ones_give(spark, monkeypatch, dead):
    """Labels and nodes come from one doubling, unless pruning would keep paths that doubling loses."""
    own = kmers(spark, dead=dead)
    nodes, values = P.merge(P.double(P.initial_paths(own), 2))
    if not dead:
        monkeypatch.setattr(P, "double", lambda *a, **b: 1 / 0)  # never reached
    for prefixes in (P.PREFIXES, 0):
        monkeypatch.setattr(P, "PREFIXES", prefixes)
        index = I.build_index(own, steps=2, occurrences=True)
        assert rows(index.nodes.select("path_id", "key", "preds")) == rows(nodes) and rows(index.node_values) == rows(values)
        if prefixes == 0 and not dead:
            plain = I.PathIndex(**{**index.__dict__, "labels": None})
            assert rows(index.labels.select("label", "rnk", "path_id")) == rows(S.label_nodes(plain))


def test_a_build_makes_no_table_before_it_is_asked_for(spark, monkeypatch):
    for name in ("edges_of", "edge_blocks_of", "lcp_of", "key_ranges_of", "redundancy_of", "samples_of"):
        monkeypatch.setattr(I, name, lambda *a, **b: 1 / 0)
    index = I.build_index(kmers(spark), steps=2, occurrences=True)
    assert index.size == index.nodes.count() and index.order == 8 and index.node_values.count()
    patterns = spark.createDataFrame([("12", "12"), ("1", "1")], "pid string, pattern string")
    assert S.locate(index, S.find_by_labels(index, patterns)).count() >= 0


def test_ranges_meet_rows_by_id(spark):
    """A range of few ids of many rows each isn't joined as one bucket in one task."""
    ranges = spark.createDataFrame([("a", 0, 5), ("b", 3, 3), ("c", 1, 0), ("d", 1000, 2100)], "pid string, sp long, ep long")
    values = spark.range(4000).select(F.col("id").alias("path_id"), (F.col("id") * 2).alias("node"))
    met = S.by_bucket(ranges, values, "path_id")
    assert "__b" not in str(met._jdf.queryExecution().analyzed().toString()).split("Join")[1].split("\n")[0]
    got = {}
    for r in met.collect():
        got.setdefault(r.pid, []).append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0, 2, 4, 6, 8, 10], "b": [6], "d": [2 * x for x in range(1000, 2101)]}


def test_find_without_the_kernel(spark, monkeypatch):
    """An index too large for the kernel collects no edges, and takes no step for each digit of patterns that its labels hold."""
    index = I.build_index(kmers(spark), steps=2, occurrences=True)
    labels = index.occurrences.select("label").distinct()
    short = labels.select(F.substr("label", F.lit(1), F.lit(5)).alias("pattern")).union(labels.select(F.reverse("label"))).distinct().select(F.col("pattern").alias("pid"), "pattern")
    long = short.select(F.concat("pid", F.lit("1111")).alias("pid"), F.concat("pattern", F.lit("1111")).alias("pattern"))
    want = rows(S.find(index, short.union(long)))
    monkeypatch.setattr(S, "KERNEL_BYTES", 0)
    assert rows(S.find(index, short.union(long))) == want
    monkeypatch.setattr(S, "find_by_edges", lambda *a: 1 / 0)
    assert [r for r in rows(S.find(index, short))] == [r for r in want if len(r[1]) <= 8]
    monkeypatch.setattr(S, "LENGTHS", 0)
    assert [r for r in rows(S.find(index, short))] == [r for r in want if len(r[1]) <= 8]


def test_empty_ranges_do_not_meet_in_one_task(spark):
    index = I.build_index(kmers(spark), steps=1, occurrences=True)
    ranges = spark.createDataFrame([(k, 1, 0 if k < 199 else 1) for k in range(200)], "pid int, sp long, ep long")
    got = S.count(index, ranges)
    assert re.search(r"Filter.*sp#\d+L <= ep#\d+L", got._jdf.queryExecution().optimizedPlan().toString())  # before the joins
    assert rows(got) == rows(S.count_distinct(index, ranges)) and got.where("n > 0").count() == 1


def test_binary_files_are_written_by_tasks(spark, monkeypatch, tmp_path):
    """The records come to the driver as no results, bytes that are no text and the order of many parts stay."""
    monkeypatch.setattr(R, "CHUNK", 640)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **b: 1 / 0)
    labels = ["".join(p) for p in itertools.product("0123456", repeat=3)]
    own = [(0, t, k % 256, 255 - k % 128, (k * 7919 * 2**40) % 2**63, None if k % 5 == 0 or t[-1] == "0" else k * 10) for k, t in enumerate(labels)]
    path = R.export_binary(spark.createDataFrame(own, R.SCHEMA).repartition(3), str(tmp_path / "b"))
    assert os.path.getsize(path) == 24 * (1 + len(own))
    assert rows(R.read_binary(spark, [path])) == sorted(own, key=str)
    ids = [(k, (k * 2654435761) % 2**40) for k in range(5000)]
    path = R.write_mapping(spark.createDataFrame(ids, "id long, mapped long").repartition(4), str(tmp_path / "m"))
    assert open(path, "rb").read() == struct.pack("<qq5000q", 0, 5000, *(m for _, m in ids))
    assert not [x for _, d, _ in os.walk(R.shared_folder(spark).removeprefix("file:")) for x in d if x.startswith("parts-")]
