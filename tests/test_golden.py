"""The worked example: a 12-node graph of order 3, its 16 merged nodes and some searches."""

import pytest
from pathloom.functions import nodeid as N
from pathloom.operators import index as I
from pathloom.operators import paths as P
from pathloom.operators import search as S
from pathloom.operators import suffixtree as T
from pathloom.operators import verify as V

NODES = "#GCATTCAGTA$"
EDGES = [(0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (5, 8), (6, 7), (7, 9), (8, 9), (9, 10), (10, 11)]
KMERS = {"###": [(0, 2)], "##G": [(0, 1)], "#GC": [0], "GCA": [1], "GCT": [1], "CAT": [2, 6], "CTT": [2], "ATC": [3], "ATG": [3], "TTC": [4], "TTG": [4], "TCA": [5], "TGT": [5], "ATA": [7], "GTA": [8], "TA$": [9], "A$$": [10], "$$$": [11]}
KEYS = ["$", "A$", "ATA", "ATC", "ATG", "CA", "CT", "GC", "GT", "TA", "TC", "TG", "TT", "#G", "##G", "###"]
VALUES = [[11], [10], [7], [3], [3], [2, 6], [2], [1], [8], [9], [5], [5], [4], [0], [(0, 1)], [(0, 2)]]
DIGIT = {c: str(i) for i, c in enumerate("$ACGTN#")}


def digits(text):
    return "".join(DIGIT[c] for c in text)


def node(x):
    i, off = x if isinstance(x, tuple) else (x, 0)
    return i << 11 | off


def before(kmer):
    """Characters that precede a k-mer in the graph's k-mers, the sink going round to the source."""
    return {k[0] for k in KMERS if k[1:] == kmer[:-1]} | ({"$"} if kmer == "###" else set())


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(0, digits(k), sum(1 << int(DIGIT[c]) for c in before(k)), 0, node(v), None) for k, vs in KMERS.items() for v in vs]
    kmers = spark.createDataFrame(rows, "file int, label string, preds int, succs int, from_node long, to_node long")
    nodes, values = P.merge(P.initial_paths(kmers))
    full = kmers.select("label", "file", "from_node")
    return I.index_of(nodes, values, 3, 0, full=full), kmers


def test_merged_nodes(golden):
    index, _ = golden
    assert [r.key for r in index.nodes.orderBy("path_id").collect()] == [digits(k) for k in KEYS]
    got = {}
    for r in index.node_values.collect():
        got.setdefault(r.path_id, set()).add(r.node)
    assert got == {i: {node(v) for v in vs} for i, vs in enumerate(VALUES)}


def test_edges_and_searches(golden, spark):
    index, _ = golden
    pats = spark.createDataFrame([(p, digits(p)) for p in ["AT", "C", "CAT", "GG", "", "GCA", "TA$"]], "pid string, pattern string")
    want = {"AT": (2, 4), "C": (5, 6), "CAT": (5, 5), "GG": (1, 0), "": (0, 15), "GCA": (7, 7), "TA$": (9, 9)}
    for find in (S.find_by_labels, S.find_by_edges, S.find_by_kernel):
        assert {r.pid: (r.sp, r.ep) for r in find(index, pats).collect()} == want, find
    ranges = S.find(index, pats)
    assert {r.pid: r.n for r in S.count(index, ranges).collect()}["CAT"] == 2
    located = {}
    for r in S.locate(index, ranges).collect():
        located.setdefault(r.pid, set()).add(r.node)
    assert located["CAT"] == {node(2), node(6)} and "GG" not in located and len(located[""]) == 14
    assert {r.pid: r.n for r in S.count(index, ranges).collect()} == {p: len(located.get(p, ())) for p in want}
    assert {r.pid: r.n for r in S.count_distinct(index, ranges).collect()} == {p: len(located.get(p, ())) for p in want}


def test_navigation(golden, spark):
    index, kmers = golden
    lcp = [r.lcp for r in index.lcp.orderBy("path_id").collect()]
    n = len(lcp)
    near = {r.path_id: r for r in T.neighbours(index).collect()}
    for p in range(n):
        left, right = range(p - 1, -1, -1), range(p + 1, n)
        want = [next((q for q in left if lcp[q] < lcp[p]), n), next((q for q in left if lcp[q] <= lcp[p]), n), next((q for q in right if lcp[q] < lcp[p]), n), next((q for q in right if lcp[q] <= lcp[p]), n)]
        assert [near[p].psv, near[p].psev, near[p].nsv, near[p].nsev] == want, p
        assert near[p].psv_lcp == (lcp[want[0]] if want[0] < n else n)
    every = [(f"{a},{b}", a, b) for a in range(n) for b in range(a, n)]
    ranges = spark.createDataFrame([*every, ("none", 1, 0), ("out", 0, n)], "pid string, sp long, ep long")
    for branching in (2, 3, 64):
        got = {r.pid: (r.pos, r.lcp) for r in T.rmq(index, ranges, branching=branching).collect()}
        for pid, a, b in every:
            assert got[pid] == (min(range(a, b + 1), key=lambda q: (lcp[q], q)), min(lcp[a : b + 1])), (branching, pid)
        assert got["none"] == got["out"] == (n, n)
    got = {r.pid: r.depth for r in T.depth(index, ranges).collect()}
    assert all(got[pid] == (min(lcp[a + 1 : b + 1]) if b > a else None) for pid, a, b in every)
    assert {r.what for r in V.failures(index, kmers).collect()} == set()


def test_wrong_index_is_found(golden, spark):
    index, kmers = golden
    bad = I.PathIndex(**{**index.__dict__, "node_values": index.node_values.where("node <> 4096")})
    assert {r.what for r in V.failures(bad, kmers).collect()} >= {"locate misses", "count"} or V.failures(bad, kmers).count() > 0


def test_save_load_describe(golden, spark, tmp_path):
    index, _ = golden
    index.save(str(tmp_path / "x"))
    again = I.PathIndex.load(spark, str(tmp_path / "x"))
    assert again.size == 16 and sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, index.edges.collect()))
    row = I.describe(spark, str(tmp_path / "x")).first()
    assert row.readable and row.tag == I.TAG
    for change in ("tag", "version", "flags"):
        from pyspark.sql import functions as F

        value = {"tag": F.lit("other"), "version": F.lit(99), "flags": F.lit(1)}[change]
        index.save(str(tmp_path / change))
        index.meta.withColumn(change, value).write.mode("overwrite").parquet(str(tmp_path / change / "meta"))
        with pytest.raises(RuntimeError):
            I.PathIndex.load(spark, str(tmp_path / change))


def test_golden_edges(golden):
    index, _ = golden
    assert index.edges.count() == sum(bin(r.preds).count("1") for r in index.nodes.collect())
    assert index.meta.first().path_nodes == 16


def test_node_ids(spark):
    rows = spark.createDataFrame([("7:3",), ("7:-3",), ("7:1024",), ("x",), ("",), ("5",), ("9:1023",)], "t string")
    got = [r.n for r in rows.select(N.parse("t").alias("n")).collect()]
    assert got == [7 << 11 | 3, 7 << 11 | 1 << 10 | 3, 0, 0, 0, 0, 9 << 11 | 1023]
    assert [r.s for r in rows.select(N.show(N.parse("t")).alias("s")).collect()][:2] == ["7:3", "7:-3"]


def test_text_as_linear_graph(spark):
    """A text's suffixes: the classic suffix array and LCP array."""
    text = "GCATCATA$"
    rows = [(0, digits(text[i:]), 0, node(i), None) for i in range(len(text))]
    paths = spark.createDataFrame([(f, lab, frm, to, p) for f, lab, p, frm, to in rows], "file int, label string, from_node long, to_node long, preds int")
    nodes, values = P.merge(paths)
    order = [r.node >> 11 for r in values.orderBy("path_id").collect()]
    assert order == [8, 7, 5, 2, 4, 1, 0, 6, 3]
    full = nodes.join(values, "path_id").select("path_id", "node").collect()
    suffix = {r.path_id: digits(text[r.node >> 11 :]) for r in full}
    keyed = spark.createDataFrame(sorted(suffix.items()), "path_id long, key string")
    assert [r.lcp for r in I.lcp_of(keyed).orderBy("path_id").collect()] == [0, 0, 1, 2, 0, 3, 0, 0, 1]
