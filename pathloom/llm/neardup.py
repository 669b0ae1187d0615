"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. Shingles of five words get the weight ``(1 + ln tf) * idf``. The idf is the logarithm of the inverse share of the documents that hold the
   shingle, counted exactly over all documents, by the logarithm at the share ``COMMON``, where it saturates: rarer shingles have 1. At most
   ``mean shingles / COMMON`` shingles can be more common, whatever the corpus size, which is the
   proven bound of what is broadcast. Documents with one smallest shingle count once: else a large group of near copies would make
   its own shingles common, leave weight to its edits alone, and fall apart.
2. Each distinct text gets ``BANDS * ROWS`` consistent weighted samples; equal bands make candidates.
3. In every bucket each text is compared with one leader, the text that shares most buckets with others (the
   middle of a group of copies); those that don't get into its class are compared with a second leader
   of their own. What still stands outside its leader's class is a set of queries against all texts of that
   leader, in blocks of BLOCK by BLOCK texts, each joined by an inverted list of shingles in one task: no candidate link is
   lost, no pairs are emitted but links, and a group of copies costs a few comparisons for each copy.
   A leader's texts are dealt to tasks in blocks, and joins by leader are salted: a leader may be hot.
4. Verified links (weighted Jaccard of at least ``THRESHOLD``) are joined to classes by label propagation.

Null texts count as empty; all texts without words are compared exactly only. Equal texts are one
class whatever their ids. Repeated rows stay repeated. Ids may be null or repeated: texts are
told apart by digest, and a class is named by its smallest id; classes that share that id differ in their label. Very long texts are
shingled whole. Similarities equal to the threshold are links; of leaders that share equally many buckets the one of the larger digest leads. An empty
table has no classes. Extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, reliable_checkpoint, removed, settled, shingles, slices, written

THRESHOLD, SIZE, BANDS, ROWS = 0.8, 5, 12, 4
#: Share of the documents from which on a shingle's idf is under 1; the idf of what all documents hold, so that no weight is 0.
COMMON, LEAST_IDF = 0.01, 0.01
#: Texts of a block, by mean; blocks that a leader's comparisons are dealt to; keys that its rows are dealt to in a join.
BLOCK, DEALT, SALT = 256, 256, 8
#: Shingles that a task counts at once.
CHUNK = 2_000_000


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Stratified draws of Gamma(2, 1): the quantiles of 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.linspace(0, 1, 200_000, endpoint=False) ** 2, np.linspace(1, 40, 400_000)])
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


_R = _gamma_table()
_LNC = np.log(_R)
_seeds = np.random.default_rng(7).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def weighted(raw: bytes, heavy: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text in order and their weights. heavy: the common shingles in order, with their idf."""
    found, count = np.unique(shingles(raw, SIZE), return_counts=True)
    w = 1 + np.log(count)
    if len(heavy) and len(found):
        at = np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)
        hit = heavy[at] == found
        w[hit] *= idf[at[hit]]
    return found, w


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over the sum of the larger ones."""
    least = 0.0
    if len(a[0]) and len(b[0]):
        at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
        hit = a[0][at] == b[0]
        least = float(np.minimum(a[1][at[hit]], b[1][hit]).sum())
    total = float(a[1].sum()) + float(b[1].sum()) - least
    return least / total if total else 1.0


def samples(found: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One consistent weighted sample (shingle and level) for each hash function."""
    k = BANDS * ROWS
    best, level, item = np.full(k, np.inf, np.float32), np.zeros(k, np.float32), np.zeros(k, np.uint64)
    rows = np.arange(k)
    for at in range(0, len(found), 1024):
        h, lnw = found[at : at + 1024], np.log(w[at : at + 1024]).astype(np.float32)
        x = (h[None, :] ^ _seeds[0][:, None]) * _seeds[1][:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        r, lnc = _R[(x >> np.uint64(48)).astype(np.intp)], _LNC[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)]
        beta = ((x >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(lnw / r + beta)
        lna = lnc - r * (t - beta + 1)
        j = lna.argmin(axis=1)
        got = lna[rows, j]
        less = got < best
        best[less], level[less], item[less] = got[less], t[rows, j][less], h[j][less]
    return item ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def band_keys(found: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; none for a text without shingles."""
    if not len(found):
        return np.empty(0, np.int64)
    s, out = samples(found, w).reshape(BANDS, ROWS), np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        out = (out ^ s[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _chunked(texts: DataFrame, made, schema: str) -> DataFrame:
    """``made(chunk, docs)`` of the distinct shingles of some documents after each other, as many as have CHUNK shingles. texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, part in slices(batch):
                for t in part:
                    held.append(np.unique(shingles(t.encode(), SIZE)))
                    size += len(held[-1])
                if size >= CHUNK:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)
            held = []
            release()

    return texts.select(F.lit(0).alias("id"), "text").mapInArrow(run, schema)


def common_shingles(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles that at least the share COMMON of the documents hold, in order, and their idf. Documents with one smallest shingle count once.

    A shingle with that share overall holds half of it in some chunk; a chunk where it has less adds
    at most that half. So at most 2 * mean shingles / COMMON shingles can pass the first count.
    """
    none, least = (np.empty(0, np.uint64), np.empty(0)), COMMON * total

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        most = n >= COMMON / 2 * len(held)
        return pa.RecordBatch.from_arrays([pa.array(h[most].view(np.int64)), pa.array(n[most].astype(np.int64)), pa.array(np.full(most.sum(), len(held), np.int64))], names=["h", "n", "docs"])

    first = _chunked(texts, frequent, "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = first.where(F.col("n") + COMMON / 2 * (total - F.col("docs")) >= least).where("n > 1").select("h").toArrow()["h"].to_numpy()
    if not len(found):
        return none
    only = np.sort(found.view(np.uint64))

    def sources(held: list[np.ndarray]) -> pa.RecordBatch:
        h, s = [], []
        for own in held:
            if len(own):
                at = np.minimum(np.searchsorted(only, own), len(only) - 1)
                h.append(own[only[at] == own])
                s.append(np.full(len(h[-1]), own[0], np.uint64))
        both = np.unique(np.stack([np.concatenate(h), np.concatenate(s)], 1), axis=0) if h else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in range(2)], names=["h", "source"])

    exact = _chunked(texts, sources, "h long, source long").distinct().groupBy("h").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") > 1)).toArrow()
    if not len(exact):
        return none
    h = exact["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    share = exact["n"].to_numpy()[order] / total
    return h[order], np.maximum(LEAST_IDF, np.log(1 / share) / math.log(1 / COMMON))


def _by_leader(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """rows(a, b, ...) joined with leaders(a, ...), one row for each; a leader's rows are dealt to SALT keys.

    Never broadcast: Spark's estimate of the leaders' side leaves out its SALT copies.
    """
    salted = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")).join(salted.hint("merge"), ["a", "salt"]).drop("salt")


def _block(n: str):
    """The block of text b among so many."""
    return F.pmod(F.xxhash64("b"), F.col(n)).cast("int")


def _verified(pairs: DataFrame, texts: DataFrame, heavy) -> DataFrame:
    """pairs(a, b), of distinct rows, with the weighted Jaccard of their texts. A leader's pairs are dealt to DEALT blocks, and its text goes once to each that has some."""
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(DEALT)).cast("int").alias("i"), F.lit(1).alias("side"), "b")
    heads = dealt.select("a", "i").distinct().select("a", "i", F.lit(0).alias("side"), F.col("a").alias("b"))
    rows = dealt.unionByName(heads).join(texts.select(F.col("key").alias("b"), "text"), "b").select("a", "i", "side", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides, of, got, here = part.column(2).to_pylist(), part.column(4), [], []
                for k, side in enumerate(sides):
                    own = weighted((of[k].as_py() or "").encode(), *heavy.value)
                    if side:
                        got.append(similarity(leader, own))
                        here.append(k)
                    else:
                        leader = own
                kept = part.take(pa.array(here, pa.int32()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3), pa.array(got, pa.float64())], names=["a", "b", "sim"])

    return rows.repartition("a", "i").sortWithinPartitions("a", "i", "side", "b").mapInArrow(run, "a binary, b binary, sim double")


def _block_links(queries: list[tuple], texts: list[tuple], threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """A link (query, text) for each query and class of texts that it is similar to. Rows are (key, class, shingles, weights)."""
    lists: dict[int, list[int]] = {}
    for k, (_, _, found, _) in enumerate(texts):
        for h in found.tolist():
            lists.setdefault(h, []).append(k)
    sizes = np.array([t[3].sum() for t in texts])
    flat = [dict(zip(t[2].tolist(), t[3].tolist(), strict=True)) for t in texts] if any((t[3] != t[3][:1]).any() for t in texts) else None
    level = None if flat else np.array([t[3][0] if len(t[3]) else 0.0 for t in texts])
    for key, own, found, weights in queries:
        inter = np.zeros(len(texts))
        for h, w in zip(found.tolist(), weights.tolist(), strict=True):
            at = lists.get(h)
            if at:
                inter[at] += np.minimum(w, level[at]) if flat is None else np.minimum(w, [flat[k][h] for k in at])
        total = weights.sum() + sizes - inter
        told = set()
        for k in np.flatnonzero(inter >= threshold * total - 1e-9):
            other, c = texts[k][:2]
            if c != own and c not in told:
                told.add(c)
                yield key, other


def _rest(lone: DataFrame, members: DataFrame, texts: DataFrame, heavy, threshold: float) -> DataFrame:
    """Links (a, b) between the texts outside their leader's class and all texts of that leader.

    lone and members: (a, b, c), a leader, a text and its class. Texts are dealt to blocks by digest; a task
    joins a block of queries with a block of texts, so that a hot leader is spread over many.
    """
    of = lambda df, side: df.select("a", F.lit(side).alias("side"))
    share = lambda side: F.ceil(F.count_if(F.col("side") == side) / BLOCK).cast("int")
    counts = reliable_checkpoint(of(lone, 0).unionByName(of(members, 1)).groupBy("a").agg(share(0).alias("nq"), share(1).alias("nt")))
    q = _by_leader(lone, counts).select("a", _block("nq").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("j"), F.lit(0).alias("side"), "b", "c")
    t = _by_leader(members, counts).select("a", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("i"), _block("nt").alias("j"), F.lit(1).alias("side"), "b", "c")
    rows = q.unionByName(t).join(texts.select(F.col("key").alias("b"), "text"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, links = None, ([], []), []

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.binary()) for j in range(2)], names=["a", "b"])
            links.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = [part.column(j).to_pylist() for j in range(7)]
                for a, i, j, side, b, c, text in zip(*cols, strict=True):
                    if (a, i, j) != now:
                        links.extend(_block_links(*sides, threshold))
                        now, sides = (a, i, j), ([], [])
                    sides[side].append((b, c, *weighted((text or "").encode(), *heavy.value)))
            if links:
                yield batch_of()
        links.extend(_block_links(*sides, threshold))
        yield batch_of()
        release()

    dealt = rows.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "side", "b").select("a", "i", "j", "side", "b", "c", "text")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(key, label) of every end of an edge: the smallest key of its connected component.

    Smallest labels pass along edges, then each label takes its own label's label, so that long
    chains halve. Every round is written as a table in the shared folder, and the one before it removed: a checkpoint would hand what the
    planner knows of its columns on to the next round, and that doubles with every round.
    """
    spark = edges.sparkSession
    both, at = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels, old = written(both.groupBy(F.col("x").alias("key")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:  # labels only fall, and every round lowers one, until they are settled
        near = both.join(labels, both.y == labels.key).groupBy("x").agg(F.min("label").alias("near"))
        took = labels.join(near, labels.key == near.x, "left").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("key").alias("of"), F.col("label").alias("up"))
        new, path = written(took.join(up, took.label == up.of, "left").select("key", "old", F.least("label", "up").alias("label")))
        removed(spark, old)
        labels, old = new.select("key", "label"), path
        if new.where("old <> label").isEmpty():
            removed(spark, at)
            return labels


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, class_id (the smallest id of its class), fp (digest of the text), label (the class's own digest: unlike classes may share an id)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = texts.count()
    heavy = spark.sparkContext.broadcast(common_shingles(texts, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, idf = heavy.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = [band_keys(*weighted(t.encode(), h, idf)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "bands"])

    kind = dict(texts.dtypes)["id"]
    marked = texts.select("id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("fp"), "text")
    signed = reliable_checkpoint(marked.mapInArrow(run, f"id {kind}, fp binary, bands array<long>"))
    settled(spark)
    nodes = signed.groupBy("fp").agg(F.min("id").alias("least"), F.min("bands").alias("bands"))

    slots = nodes.select(F.posexplode("bands").alias("band", "h"), F.col("fp").alias("b"))
    # what is known of each bucket is kept before it is joined: Spark then sees two shuffles, and splits those of a hot bucket
    full = reliable_checkpoint(slots.groupBy("band", "h").agg(F.count("*").alias("m")).where("m > 1"))
    big = reliable_checkpoint(slots.join(full, ["band", "h"]))
    reach = big.groupBy("b").agg(F.sum("m").alias("reach"))
    ranked = reliable_checkpoint(big.join(reach, "b").select("band", "h", "b", "reach"))
    leads = reliable_checkpoint(ranked.groupBy("band", "h").agg(F.max(F.struct("reach", "b")).alias("x")).select("band", "h", F.col("x.b").alias("a")))
    members = reliable_checkpoint(ranked.join(leads, ["band", "h"]).where("a <> b").select("band", "h", "a", "b", "reach"))
    pairs = reliable_checkpoint(members.select("a", "b").distinct())
    leaders = reliable_checkpoint(pairs.select("a").distinct())
    settled(spark)

    involved = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(nodes.select("fp", "least"), "fp").select(F.col("fp").alias("key"), "least")
    source = marked.join(involved, (marked.fp == involved.key) & marked.id.eqNullSafe(involved.least))
    kept = reliable_checkpoint(source.select("key", "text").dropDuplicates(["key"]))
    first = reliable_checkpoint(_verified(pairs, kept, heavy))
    links = first.where(F.col("sim") >= threshold).select("a", "b")
    settled(spark)
    classes = components(links)
    settled(spark)

    def classed(rows: DataFrame) -> DataFrame:
        """rows(a, b, ...) with the class c of b."""
        return rows.join(classes.select(F.col("key").alias("b"), F.col("label").alias("c")), "b", "left").withColumn("c", F.coalesce("c", "b"))

    def apart(columns: list[str]) -> DataFrame:
        """The members that aren't in their leader's class."""
        own = leaders.join(classes.select(F.col("key").alias("a"), F.col("label").alias("ca")), "a", "left").withColumn("ca", F.coalesce("ca", "a"))
        return classed(_by_leader((members if len(columns) > 2 else pairs).select(*columns), own)).where("ca <> c").drop("ca")

    lone = reliable_checkpoint(apart(["band", "h", "a", "b", "reach"]))
    second = reliable_checkpoint(lone.groupBy("band", "h").agg(F.max(F.struct("reach", "b")).alias("x")).select("band", "h", F.col("x.b").alias("l")))
    again = lone.join(second, ["band", "h"]).where("b <> l").select(F.col("l").alias("a"), "b").distinct()
    more = reliable_checkpoint(_verified(again, kept, heavy)).where(F.col("sim") >= threshold).select("a", "b")
    settled(spark)
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = components(links)

    left = reliable_checkpoint(apart(["a", "b"]))
    settled(spark)
    if left.isEmpty():
        return _named(signed, nodes, classes, id_col)
    everyone = classed(_by_leader(pairs, left.select("a").distinct()))
    last = reliable_checkpoint(_rest(left.select("a", "b", "c"), reliable_checkpoint(everyone).select("a", "b", "c"), kept, heavy, threshold))
    settled(spark)
    if not last.isEmpty():
        classes = components(links.unionByName(last))

    return _named(signed, nodes, classes, id_col)


def _named(signed: DataFrame, nodes: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``near_duplicate_classes`` from signed(id, fp), nodes(fp, least) and classes(key, label)."""
    named = nodes.select("fp", "least").join(classes, F.col("fp") == F.col("key"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    names = named.groupBy("label").agg(F.min("least").alias("class_id"))
    return signed.select("id", "fp").join(named.join(names, "label").select("fp", "class_id", "label"), "fp").select(F.col("id").alias(id_col), "class_id", "fp", "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of one document for each class: a row that has the class's smallest id.

    Of a class's rows with that id the one of the smallest text digest stays, of repeated ones that of the smallest hash of all columns. Classes
    are told apart by their label, not by that id.
    """
    classes = near_duplicate_classes(docs, id_col, text_col)
    keep = classes.where(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("fp").alias("of"), F.first("class_id").alias("least")).drop("label")
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    text, key = (names[docs.columns.index(c)] for c in (text_col, id_col))
    rows = own.withColumn("fp", F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))))
    kept = rows.join(keep, (F.col("fp") == F.col("of")) & F.col(key).eqNullSafe(F.col("least")))
    hashed = [n for n, kind in own.dtypes if "map<" not in kind]
    one = kept.groupBy("of", "least").agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias("row")).select("row.*")
    return one.toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the class of every document."""
    from .common import table

    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
