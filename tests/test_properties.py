"""Random graphs against brute force."""

import random

import pytest
from pathloom.functions import alphabet as A
from pathloom.operators import index as I
from pathloom.operators import kmercount as K
from pathloom.operators import paths as P
from pathloom.operators import search as S
from pathloom.operators import verify as V
from pathloom.sources import fixtures as X
from pathloom.sources import kmers as R
from pyspark.sql import functions as F


def graph(seed, n=14):
    """Labels and edges of a cyclic graph where every node has a successor and a predecessor or more."""
    rng = random.Random(seed)
    labels = {i: rng.choice("12345") for i in range(1, n + 1)}
    edges = {(i, i % n + 1) for i in labels} | {(rng.randint(1, n), rng.randint(1, n)) for _ in range(n // 3)}
    return labels, sorted(edges)


def frames(spark, labels, edges):
    nodes = spark.createDataFrame([(0, i << 11, c) for i, c in labels.items()], "file int, node long, comp string")
    return X.Graph(nodes, spark.createDataFrame([(0, a << 11, b << 11) for a, b in edges], "file int, src long, dst long"))


def brute(labels, edges, k):
    """label -> starts of all paths of k nodes."""
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    paths = [(i, i, c) for i, c in labels.items()]
    for _ in range(k - 1):
        paths = [(s, b, t + labels[b]) for s, e, t in paths for b in after[e]]
    out = {}
    for s, _, t in paths:
        out.setdefault(t, set()).add(s << 11)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_index_of_random_graph(spark, seed):
    labels, edges = graph(seed)
    order = 4
    truth = brute(labels, edges, order)
    kmers = X.graph_kmers(frames(spark, labels, edges), 2)
    index = I.build_index(kmers, steps=1, occurrences=True)
    occurrences = {}
    for r in index.occurrences.collect():
        occurrences.setdefault(r.label, set()).add(r.from_node)
    assert occurrences == truth
    rng = random.Random(seed)
    pats = {t[:n] for t in truth for n in range(1, order + 1)} | {"".join(rng.choice("12345") for _ in range(rng.randint(1, order))) for _ in range(60)}
    df = spark.createDataFrame([(p, p) for p in sorted(pats)], "pid string, pattern string")
    ranges = {}
    for find in (S.find_by_labels, S.find_by_edges, S.find_by_kernel):
        got = {r.pid: (r.sp, r.ep) for r in find(index, df).collect()}
        ranges = ranges or got
        assert got == ranges, find
    found = S.find(index, df)
    located = {}
    for r in S.locate(index, found).collect():
        located.setdefault(r.pid, set()).add(r.node)
    want = {p: set().union(*[v for t, v in truth.items() if t.startswith(p)]) for p in pats}
    assert all(located.get(p, set()) == want[p] for p in pats)
    assert {r.pid: r.n for r in S.count(index, found).collect()} == {p: len(want[p]) for p in pats}
    some = {}
    for r in S.locate_some(index, found, 2).collect():
        some.setdefault(r.pid, set()).add(r.node)
    assert all(len(some.get(p, ())) == min(2, len(want[p])) and some.get(p, set()) <= want[p] for p in pats)
    # longer patterns: no false negatives
    long = brute(labels, edges, order + 3)
    more = spark.createDataFrame([(p, p) for p in long], "pid string, pattern string")
    assert S.find_by_kernel(index, more).where("sp > ep").count() == 0
    assert {r.pid: (r.sp, r.ep) for r in S.find_by_edges(index, more).collect()} == {r.pid: (r.sp, r.ep) for r in S.find_by_kernel(index, more).collect()}
    assert V.failures(index, index.occurrences).count() == 0
    for k in (1, 3, 4):
        assert K.count_kmers(index, k, with_n=True) == len({t[:k] for t in truth})
        assert K.count_kmers(index, k) == len({t[:k] for t in truth if "5" not in t[:k]})
    assert K.count_kmers(index, 0) == 1 and K.count_kmers(index, 6) == 0
    assert K.count_kmers(index, 6, with_n=True, force=True) >= len(brute(labels, edges, 6))


def test_doubling_twice_equals_direct_paths(spark):
    labels, edges = graph(5, 9)
    kmers = X.graph_kmers(frames(spark, labels, edges), 2)
    nodes, values = P.merge(P.double(P.initial_paths(kmers), 2))
    direct = spark.createDataFrame([(0, t, s, None, 0) for t, ss in brute(labels, edges, 8).items() for s in ss], "file int, label string, from_node long, to_node long, preds int")
    nodes2, values2 = P.merge(direct)
    assert [r.key for r in nodes.orderBy("path_id").collect()] == [r.key for r in nodes2.orderBy("path_id").collect()]
    assert sorted(map(tuple, values.collect())) == sorted(map(tuple, values2.collect()))


def test_paths_do_not_cross_files(spark):
    rows = [(0, "12", 0, 0, 1, 2), (0, "34", 0, 0, 2, None), (1, "41", 0, 0, 2, None), (1, "13", 0, 0, 5, 9)]
    paths = spark.createDataFrame(rows, "file int, label string, preds int, succs int, from_node long, to_node long").select(*P.PATHS)
    got = {(r.file, r.label) for r in P.extend(paths).collect()}
    assert got == {(0, "1234"), (0, "34"), (1, "41")}
    assert [r.fanout for r in P.extension_fanout(paths).orderBy("file").collect()] == [1, 0]
    with pytest.raises(MemoryError):
        P.double(paths, 1, max_rows=1)


def test_compare_indexes(spark, tmp_path):
    a, b = graph(7), graph(8)
    ia, ib = (I.build_index(X.graph_kmers(frames(spark, *g), 2), steps=1, occurrences=True) for g in (a, b))
    ta, tb = ({t[:3] for t in brute(*g, 4)} for g in (a, b))
    row = tuple(K.compare_indexes(ia, ib, 3, with_n=True, output=str(tmp_path / "k")).first())
    assert row == (len(ta & tb), len(ta - tb), len(tb - ta))
    assert spark.read.parquet(str(tmp_path / "k.left")).count() == row[1]
    assert tuple(K.compare_indexes(ia, ib, 0).first()) == (1, 0, 0) and tuple(K.compare_indexes(ia, ib, 9).first()) == (0, 0, 0)


def test_text_and_binary_files(spark, tmp_path):
    text = "GCA\t1:0\t#\tT\t5:0,6:0\nbroken line\nTA$\t9:0\tA,G\t$\t11:0\nNNX\t7:-3\tA,C\tT\t8:0\n"
    (tmp_path / "a.kmers").write_text(text)
    rows = R.read_text(spark, [str(tmp_path / "a.kmers")])
    got = sorted(map(tuple, rows.collect()), key=str)
    assert got == sorted([(0, "321"[0:1] + "21", 64, 16, 1 << 11, 5 << 11), (0, "321", 64, 16, 1 << 11, 6 << 11), (0, "410", 2 | 8, 1, 9 << 11, None), (0, "555", 2 | 4, 16, 7 << 11 | 1 << 10 | 3, 8 << 11)], key=str)
    assert R.checked(rows) == 3
    path = R.export_binary(rows, str(tmp_path / "b"))
    back = R.read_binary(spark, [path])
    assert sorted(map(tuple, back.collect()), key=str) == got
    with pytest.raises(ValueError):
        R.checked(rows.union(rows.withColumn("label", F.lit("1"))))
    with pytest.raises(ValueError):
        R.checked(rows.where("false"))
    (tmp_path / "p").write_text("GCA\n\nNNN\nCAT\n")
    assert [r.pattern for r in R.read_patterns(spark, str(tmp_path / "p")).collect()] == ["GCA", "CAT"]


def test_sixteen_digits_use_the_sign_bit(spark):
    row = spark.createDataFrame([("6543210123456543", 255, 129)], "label string, preds int, succs int")
    key = row.select(A.pack("label", "preds", "succs").alias("key"))
    assert key.first().key < 0
    got = key.select(A.unpack("key", 16).alias("l"), A.key_preds("key").alias("p"), A.key_succs("key").alias("s")).first()
    assert tuple(got) == ("6543210123456543", 255, 129)


def test_alphabet(spark):
    row = spark.createDataFrame([("acgtnACGTN$#\0xé",)], "t string")
    assert row.select(A.encode("t").alias("d")).first().d == "123451234506055"
    pairs = spark.createDataFrame([("", "", 0), ("12", "12", 2), ("12", "1", 1), ("123", "124", 2), ("3", "1", 0)], "a string, b string, n int")
    assert all(r.got == r.n for r in pairs.select("n", A.lcp("a", "b").alias("got")).collect())


def test_mapping(spark):
    from pathloom.functions import nodeid as N

    rows = spark.createDataFrame([(1 << 11 | 5,), (2 << 11 | 1 << 10 | 7,)], "node long")
    mapping = spark.createDataFrame([(2, 40)], "id long, mapped long")
    assert {r.node for r in N.mapped(rows, mapping, "node").collect()} == {1 << 11 | 5, 40 << 11 | 1 << 10 | 7}
    more = N.append_mapping(mapping, spark.createDataFrame([(9,), (4,)], "id long"), 100)
    assert {(r.id, r.mapped) for r in more.collect()} == {(2, 40), (100, 4), (101, 9)}


def test_streaming_patterns(spark, tmp_path):
    from pathloom.streaming import find_stream

    labels, edges = graph(3)
    index = I.build_index(X.graph_kmers(frames(spark, labels, edges), 2), steps=1, occurrences=True)
    spark.createDataFrame([(t, t) for t in ("1", "2", "12", "21", "555")], "pid string, pattern string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pid string, pattern string").parquet(str(tmp_path / "in"))
    q = find_stream(index, stream, [1, 2, 3]).writeStream.format("memory").queryName("found_patterns").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.pid: (r.sp, r.ep) for r in S.find(index, spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {r.pid: (r.sp, r.ep) for r in spark.table("found_patterns").collect()} == want


def test_large_running_sums(spark):
    total = 40_000
    rows = spark.range(total).select(F.col("id").alias("path_id"), (F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("r"))
    got = I.running_sums(rows, "path_id", total, {"a": "x", "r": "y"}).where(F.col("path_id").isin(0, 16383, 16384, 39999)).collect()
    for row in got:
        assert row.x == sum(i % 7 for i in range(row.path_id + 1)) and row.y == sum(i % 3 for i in range(row.path_id + 1))


def test_expand_with_own_conditions(spark):
    labels, edges = graph(1)
    index = I.build_index(X.graph_kmers(frames(spark, labels, edges), 2), steps=1)
    truth = {t[:n] for t in brute(labels, edges, 4) for n in range(1, 4)}
    got = {r.kmer for r in K.expand_kmers(index, 3, with_n=True, report=F.lit(True)).collect()}
    assert got == truth
    got = {r.kmer for r in K.expand_kmers(index, 3, with_n=True, report=F.length("kmer") >= 1, expand=~F.col("kmer").startswith("1")).collect()}
    assert got == {t for t in truth if "1" not in t[1:]}


def test_binary_mapping(spark, tmp_path):
    import struct

    (tmp_path / "m").write_bytes(struct.pack("<QQ3Q", 5, 8, 50, 60, 70))
    assert sorted(map(tuple, R.read_mapping(spark, str(tmp_path / "m")).collect())) == [(5, 50), (6, 60), (7, 70)]


def test_range_lcps(spark):
    row = spark.createDataFrame([("1123", "1133", "1134", "1211")], "a string, b string, c string, d string")
    assert tuple(row.select(*A.range_lcps("a", "b", "c", "d")).first()) == (1, 3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_ways_to_keys_agree(spark, seed):
    labels, edges = graph(seed)
    rng = random.Random(seed)
    rows = [(t, rng.choice([None, 1, 1, 2])) for t in brute(labels, edges, 4)] + [("60", 3), ("0", None)]
    one = spark.createDataFrame(rows, "label string, value long").repartition(3)
    want = {}
    for t, v in rows:
        for n in range(1, len(t) + 1):
            if v is not None and all(w == v for u, w in rows if u.startswith(t[:n])):
                want[t] = t[:n]
                break
    assert {r.label: r.key for r in P.keys_by_prefixes(one).collect()} == want
    assert {r.label: r.key for r in P.keys_by_borders(one).collect()} == want
    assert P.keys_by_borders(one.where("false")).count() == 0


def test_index_by_borders(spark, monkeypatch):
    labels, edges = graph(4)
    kmers = X.graph_kmers(frames(spark, labels, edges), 2)
    want = P.merge(P.double(P.initial_paths(kmers), 2))
    monkeypatch.setattr(P, "PREFIXES", 0)
    got = P.merge(P.double(P.initial_paths(kmers), 2))
    for a, b in zip(want, got, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_binary_files_of_many_sections(spark, tmp_path):
    import struct

    rec = lambda k, n: (int("".join(format(int(c), "03b") for c in k), 2) << 16 | 2 << 8 | 4, n << 11, 0xFFFFFFFFFFFFFFFF if n % 3 == 0 else (n + 1) << 11)
    keys = [("123", 1), ("321", 2), ("444", 3), ("121", 4), ("512", 5)]
    section = lambda rows, flags=0, k=3: struct.pack("<3Q", flags, len(rows), k) + b"".join(struct.pack("<3Q", *rec(*r)) for r in rows)
    (tmp_path / "a.graph").write_bytes(section(keys[:2]) + section([]) + section(keys[2:]))
    got = sorted((r.file, r.label, r.from_node, r.to_node) for r in R.read_binary(spark, R.paths_of([str(tmp_path / "a")], False)).collect())
    assert got == sorted((0, k, n << 11, None if n % 3 == 0 else (n + 1) << 11) for k, n in keys)
    for bad in (section(keys[:2], flags=1), section(keys[:2]) + section(keys[2:], k=4), section(keys)[:-24], section(keys[:1]) + struct.pack("<3Q", 7, 0, 3)):
        (tmp_path / "b.graph").write_bytes(bad)
        with pytest.raises(ValueError):
            R.read_binary(spark, [str(tmp_path / "b.graph")])


def test_mapping_files_keep_gaps(spark, tmp_path):
    path = R.write_mapping(spark.createDataFrame([(7, 70), (5, 50)], "id long, mapped long"), str(tmp_path / "m"))
    assert sorted(map(tuple, R.read_mapping(spark, path).collect())) == [(5, 50), (6, 6), (7, 70)]
    assert R.read_mapping(spark, R.write_mapping(spark.createDataFrame([], "id long, mapped long"), str(tmp_path / "n"))).count() == 0


def test_offsets_that_have_no_bits_are_refused(spark):
    from pathloom.functions import nodeid as N

    ok = spark.createDataFrame([(3, 1023), (3, None)], "id long, off long").select(N.encode("id", "off").alias("n")).collect()
    assert [r.n for r in ok] == [3 << 11 | 1023, None]
    for off in (1024, -1):
        with pytest.raises(Exception, match="offset"):
            spark.createDataFrame([(3, off)], "id long, off long").select(N.encode("id", "off")).collect()


def test_limits_are_checked_before_a_generation_is_written(spark, monkeypatch):
    labels, edges = graph(2)
    paths = P.initial_paths(X.graph_kmers(frames(spark, labels, edges), 2))
    rows, size = P.extended_size(paths)
    made = P.extend(paths)
    assert rows == made.count() and size == made.agg(F.sum(F.length("label"))).first()[0]
    monkeypatch.setattr(P, "extend", lambda p: 1 / 0)  # never reached
    for limit in ({"max_rows": rows - 1}, {"max_bytes": size - 1}):
        with pytest.raises(MemoryError):
            P.double(paths, 1, pruned=False, **limit)


def test_steps_back_over_many_blocks(spark, monkeypatch):
    for module in (I, S):
        monkeypatch.setattr(module, "EDGE_BLOCK", 2)
    monkeypatch.setattr(I, "GROUP", 3)
    labels, edges = graph(5, 20)
    index = I.build_index(X.graph_kmers(frames(spark, labels, edges), 2), steps=1, occurrences=True)
    ed = [(r.src, r.dst, r.comp) for r in index.edges.collect()]
    n = index.size
    ranges = [(f"{a}-{b}", a, b) for a in range(0, n, 3) for b in range(a, n, 5)]
    got = {(r.pid, r.comp): (r.sp, r.ep) for r in S.lf_all(index, spark.createDataFrame(ranges, "pid string, sp long, ep long")).collect()}
    for name, a, b in ranges:
        for c in range(1, 6):
            src = [s for s, t, d in ed if a <= t <= b and d == c]
            assert got[name, c] == ((min(src), max(src)) if src else (1, 0)), (name, c)


def test_ranks_among_keys(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("0123456") for _ in range(rng.randint(1, 5)))
    keys, probes = sorted({word() for _ in range(200)}), [word() for _ in range(300)]
    got = I.ranked_among(spark.createDataFrame([(k,) for k in keys], "key string").repartition(5), "key", spark.createDataFrame([(k, p) for k, p in enumerate(probes)], "n long, p string").repartition(5), "p", "rank").collect()
    assert {(r.n, r.rank) for r in got} == {(k, sum(x <= p for x in keys)) for k, p in enumerate(probes)}


def test_index_of_an_older_version_is_loaded(spark, tmp_path):
    import shutil

    labels, edges = graph(1)
    index = I.build_index(X.graph_kmers(frames(spark, labels, edges), 2), steps=1)
    index.save(str(tmp_path / "i"))
    shutil.rmtree(tmp_path / "i" / "edge_blocks")
    meta = spark.createDataFrame(index.meta.collect(), index.meta.schema).withColumn("version", F.lit(1))
    meta.write.mode("overwrite").parquet(str(tmp_path / "i" / "meta"))
    old = I.PathIndex.load(spark, str(tmp_path / "i"))
    assert sorted(map(str, old.edge_blocks.collect())) == sorted(map(str, index.edge_blocks.collect()))
    assert I.describe(spark, str(tmp_path / "i")).first().state == "readable"
