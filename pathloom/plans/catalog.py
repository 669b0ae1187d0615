"""Registered queries of the path index over the driver's tables, and the same as DuckDB SQL.

Indexes are built once for a session and folder and lie in the checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from ..functions import alphabet as A
from ..functions import nodeid as N
from ..functions import ranges as G
from ..functions import report
from ..operators import index as I
from ..operators import kmercount as K
from ..operators import paths as P
from ..operators import search as S
from ..operators import suffixtree as T
from ..operators import verify as V
from ..operators.ranking import dense_ids, kept, shared_folder
from ..sources import fixtures as X
from ..sources import kmers as R

ORDER = 4
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_built: dict[tuple, object] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Times and sizes of the tables in a folder: a changed folder is another one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What ``make`` gives, once for a session, folder (as it is now) and name."""
    key = (spark.sparkContext.applicationId, id(spark.sparkContext), sf_dir, _stamp(spark, sf_dir), name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def _scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _flat(df: DataFrame) -> DataFrame:
    """``df`` with all whole numbers as longs."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (ByteType, ShortType, IntegerType)) else F.col(f.name) for f in df.schema])


def _query(name: str, columns: str, source: str):
    """Registers a query and its SQL: columns as ``name:b`` (long) or ``name`` over a FROM clause that may use the common tables."""

    def add(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: _flat(f(spark, sf_dir))
        cols = ", ".join(f"CAST({c[:-2]} AS BIGINT) AS {c[:-2]}" if c.endswith(":b") else c for c in columns.split())
        _SQL[name] = f"WITH {COMMON}\nSELECT {cols} FROM {source}"
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    return _once(spark, sf_dir, f"rows{files}", lambda: kept(X.event_rows(spark, sf_dir, files)))


def kmers(spark: SparkSession, sf_dir: str, k: int, files: int = 1) -> DataFrame:
    return X.event_kmers(rows(spark, sf_dir, files), k)


def event_index(spark: SparkSession, sf_dir: str) -> I.PathIndex:
    """The index of all users' event sequences: two events a k-mer, doubled once."""
    return _once(spark, sf_dir, "index", lambda: I.build_index(kmers(spark, sf_dir, 2), steps=1, occurrences=True))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, pattern: all patterns of 1 to ORDER events that occur, and all of them backwards."""

    def make() -> DataFrame:
        own = event_index(spark, sf_dir).occurrences.select(F.explode(A.prefixes("label")).alias("pattern")).where(~F.col("pattern").contains("0")).distinct()
        return kept(own.union(own.select(F.reverse("pattern"))).distinct().select(F.col("pattern").alias("pid"), "pattern"))

    return _once(spark, sf_dir, "patterns", make)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "found", lambda: kept(S.find(event_index(spark, sf_dir), patterns(spark, sf_dir))))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where("sp <= ep")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Tables that the SQL of all queries shares.
COMMON = """
ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CASE event_type WHEN 'click' THEN '1' WHEN 'error' THEN '2' WHEN 'purchase' THEN '3' WHEN 'signup' THEN '4' WHEN 'view' THEN '5' END AS comp FROM events),
sq AS (SELECT user_id, string_agg(comp, '' ORDER BY pos) || '0000000000000000' AS s, count(*) AS n FROM ev GROUP BY user_id),
occ AS (SELECT user_id, pos, n, s, comp, ((user_id + 1) << 11) | pos AS node, substr(s, CAST(pos AS BIGINT) + 1, 16) AS tail,
  CASE WHEN pos = 0 THEN '6' ELSE substr(s, CAST(pos AS BIGINT), 1) END AS pc FROM ev JOIN sq USING (user_id)),
last AS (SELECT CAST(bit_or(1 << CAST(comp AS INT)) AS BIGINT) AS preds FROM occ WHERE pos = n - 1),
tails AS (SELECT tail, node, CAST(1 << CAST(pc AS INT) AS BIGINT) AS preds, user_id FROM occ UNION ALL SELECT '0000000000000000', 0, preds, NULL FROM last),
kp AS (SELECT substr(tail, 1, 4) AS label, node, preds FROM tails),
sets AS (SELECT label, string_agg(DISTINCT CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) AS value, bit_or(preds) AS preds FROM kp GROUP BY label),
px AS (SELECT label, value, substr(label, 1, CAST(i AS BIGINT)) AS prefix, i FROM sets, range(1, 5) t(i)),
uni AS (SELECT prefix FROM px GROUP BY prefix HAVING count(DISTINCT value) = 1),
keyed AS (SELECT label, min_by(prefix, i) AS key FROM px JOIN uni USING (prefix) GROUP BY label),
nodes AS (SELECT row_number() OVER (ORDER BY key) - 1 AS path_id, key, preds FROM (SELECT key, bit_or(preds) AS preds FROM sets JOIN keyed USING (label) GROUP BY key)),
node_values AS (SELECT DISTINCT path_id, node FROM kp JOIN keyed USING (label) JOIN nodes USING (key)),
digits AS (SELECT d FROM range(0, 7) t(d)),
edges AS (SELECT u.path_id AS src, v.path_id AS dst, d AS comp FROM nodes v, digits, range(1, 6) t(i), nodes u
  WHERE (v.preds >> CAST(d AS BIGINT)) & 1 = 1 AND i <= length(v.key) + 1 AND u.key = substr(CAST(d AS VARCHAR) || v.key, 1, CAST(i AS BIGINT))),
pats AS (SELECT DISTINCT p AS pattern FROM (SELECT substr(label, 1, CAST(i AS BIGINT)) AS p FROM sets, range(1, 5) t(i) UNION ALL SELECT reverse(substr(label, 1, CAST(i AS BIGINT))) FROM sets, range(1, 5) t(i)) WHERE NOT contains(p, '0')),
lr AS (SELECT substr(label, 1, CAST(i AS BIGINT)) AS pattern, min(path_id) AS sp, max(path_id) AS ep FROM keyed JOIN nodes USING (key), range(1, 5) t(i) GROUP BY 1),
found AS (SELECT pattern, coalesce(sp, 1) AS sp, coalesce(ep, 0) AS ep FROM pats LEFT JOIN lr USING (pattern)),
size AS (SELECT count(*) AS size FROM nodes),
lcp AS (SELECT path_id, CASE WHEN p IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(1, 5), lambda i: i <= length(p) AND i <= length(key) AND substr(p, 1, CAST(i AS BIGINT)) = substr(key, 1, CAST(i AS BIGINT)))), 0) END AS lcp
  FROM (SELECT path_id, key, lag(key) OVER (ORDER BY path_id) AS p FROM nodes)),
distinct_kmers AS (SELECT DISTINCT substr(tail, 1, CAST(i AS BIGINT)) AS kmer, i AS k, with_n FROM tails, range(1, 5) t(i), (VALUES (0), (1)) w(with_n)
  WHERE regexp_full_match(substr(tail, 1, CAST(i AS BIGINT)), CASE with_n WHEN 1 THEN '[1-5]+' ELSE '[1-4]+' END)),
halves AS (SELECT DISTINCT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half, k.kmer FROM
  (SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half, row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '2024-01-16' ORDER BY ts, event_id) AS pos, ts FROM events) e
  JOIN (SELECT user_id, half, pos, substr(s, CAST(pos AS BIGINT), 4) AS kmer FROM (SELECT user_id, half, pos, string_agg(c, '' ORDER BY pos) OVER (PARTITION BY user_id, half ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM
    (SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half, row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '2024-01-16' ORDER BY ts, event_id) AS pos,
     CASE event_type WHEN 'click' THEN '1' WHEN 'error' THEN '2' WHEN 'purchase' THEN '3' WHEN 'signup' THEN '4' WHEN 'view' THEN '5' END AS c FROM events))) k
  ON e.user_id = k.user_id AND e.half = k.half AND e.pos = k.pos WHERE length(k.kmer) = 4 AND regexp_full_match(k.kmer, '[1-5]+'))"""

_SUCC = "1 << CAST(substr(tail, {k} + 1, 1) AS INT)"
_KMERS = "(SELECT substr(tail, 1, {k}) AS label, preds, CASE WHEN tail LIKE '0%' THEN 1 ELSE 1 << CAST(substr(tail, {k} + 1, 1) AS INT) END AS succs, node AS from_node, CASE WHEN substr(tail, {k}, 1) = '0' THEN NULL WHEN substr(tail, {k} + 1, 1) = '0' THEN 0 ELSE node + {k} END AS to_node FROM tails)"


# ------------------------------------------------------------- sources and scalars


@_query("kmer_scan_explode", "label preds:b succs:b from_node:b to_node:b", _KMERS.format(k=3))
def _(spark, d):
    return R.from_lines(R.to_lines(kmers(spark, d, 3))).drop("file")


@_query("kmer_binary_pack", "label preds:b succs:b key:b", "(SELECT label, preds, succs, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 4), lambda i: CAST(substr(label, CAST(i AS BIGINT), 1) AS HUGEINT))), lambda a, b: a * 8 + b) * 65536 + preds * 256 + succs AS key FROM " + _KMERS.format(k=3) + ")")
def _(spark, d):
    key = kmers(spark, d, 3).select(A.pack("label", "preds", "succs").alias("key"))
    return key.select(A.unpack("key", 3).alias("label"), A.key_preds("key").alias("preds"), A.key_succs("key").alias("succs"), "key")


@_query("node_encode_decode", "token id:b off:b rc:b node:b", "(SELECT (user_id + 1) || ':' || CASE WHEN pos % 2 = 1 THEN '-' ELSE '' END || pos AS token, user_id + 1 AS id, pos AS off, pos % 2 AS rc, ((user_id + 1) << 11) | ((pos % 2) << 10) | pos AS node FROM ev)")
def _(spark, d):
    node = N.encode(F.col("user_id") + 1, "pos", F.col("pos") % 2 == 1)
    shown = rows(spark, d).select(N.show(node).alias("token"), node.alias("n"))
    return shown.select("token", N.ident("n").alias("id"), N.offset("n").alias("off"), N.reverse("n").cast("int").alias("rc"), N.parse("token").alias("node"))


@_query("node_mapping", "node:b mapped:b", "(SELECT node, (coalesce(c_custkey + 1000000, user_id + 1) << 11) | pos AS mapped FROM occ LEFT JOIN customer ON c_custkey = user_id + 1)")
def _(spark, d):
    mapping = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1000000).alias("mapped"))
    return N.mapped(rows(spark, d).select("node", F.col("node").alias("mapped")), mapping, "mapped")


@_query("sink_mark", "label from_node:b final:b", "(SELECT label, from_node, CASE WHEN to_node IS NULL THEN 1 ELSE 0 END AS final FROM " + _KMERS.format(k=3) + ")")
def _(spark, d):
    return R.mark_sinks(kmers(spark, d, 3)).select("label", "from_node", F.col("to_node").isNull().cast("int").alias("final"))


@_query("pattern_filter", "pattern n_chars:b", "(SELECT pattern, length(pattern) AS n_chars FROM (SELECT DISTINCT translate(substr(tail, 1, 4), '0123456', '$ACGTN#') AS pattern FROM tails) WHERE NOT regexp_full_match(pattern, 'N*'))")
def _(spark, d):
    labels = event_index(spark, d).occurrences.select(A.decode("label").alias("pattern")).distinct()
    return R.useful_patterns(labels).select("pattern", F.length("pattern").alias("n_chars"))


@_query("kmer_stats", "file:b kmers:b min_k:b max_k:b", "(SELECT coalesce(user_id % 3, f) AS file, count(*) AS kmers, 3 AS min_k, 3 AS max_k FROM (SELECT user_id, 0 AS f FROM occ UNION ALL SELECT NULL, f FROM range(0, 3) t(f)) GROUP BY 1)")
def _(spark, d):
    return R.stats(kmers(spark, d, 3, 3))


# ------------------------------------------------------------- keys and paths


@_query("distinct_keys", "label preds:b succs:b", "(SELECT label, bit_or(preds) AS preds, bit_or(succs) AS succs FROM " + _KMERS.format(k=3) + " GROUP BY label)")
def _(spark, d):
    return P.distinct_keys(kmers(spark, d, 3))


@_query("distinct_starts", "node:b", "(SELECT DISTINCT node FROM tails)")
def _(spark, d):
    return P.distinct_starts(kmers(spark, d, 3))


@_query("label_rank", "label rnk:b", "(SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS rnk FROM (SELECT DISTINCT label FROM " + _KMERS.format(k=3) + "))")
def _(spark, d):
    return P.ranked_labels(kmers(spark, d, 3)).select("label", "rnk")


@_query("kmer_lcp", "rnk:b lcp:b", "(SELECT rnk, CASE WHEN p IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(1, 4), lambda i: substr(p, 1, CAST(i AS BIGINT)) = substr(label, 1, CAST(i AS BIGINT)))), 0) END AS lcp FROM (SELECT row_number() OVER (ORDER BY label) - 1 AS rnk, label, lag(label) OVER (ORDER BY label) AS p FROM (SELECT DISTINCT label FROM " + _KMERS.format(k=3) + ")))")
def _(spark, d):
    return I.lcp_of(P.ranked_labels(kmers(spark, d, 3)).select(F.col("rnk").alias("path_id"), F.col("label").alias("key"))).select(F.col("path_id").alias("rnk"), "lcp")


@_query("char_counts_c_array", "comp:b n:b c:b", "(SELECT comp, n, coalesce(sum(n) OVER (ORDER BY comp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM (SELECT CAST(comp AS INT) AS comp, count(*) AS n FROM ev GROUP BY 1))")
def _(spark, d):
    return A.char_counts(rows(spark, d), "comp")


@_query("dbg_find", "pattern sp:b ep:b", "(SELECT pattern, CASE WHEN length(pattern) > 3 OR sp IS NULL THEN 1 ELSE sp END AS sp, CASE WHEN length(pattern) > 3 OR ep IS NULL THEN 0 ELSE ep END AS ep FROM pats LEFT JOIN (SELECT substr(label, 1, CAST(i AS BIGINT)) AS pattern, min(rnk) AS sp, max(rnk) AS ep FROM (SELECT label, row_number() OVER (ORDER BY label) - 1 AS rnk FROM (SELECT DISTINCT label FROM " + _KMERS.format(k=3) + ")), range(1, 4) t(i) GROUP BY 1) USING (pattern))")
def _(spark, d):
    return S.find_in_labels(kept(P.ranked_labels(kmers(spark, d, 3))), patterns(spark, d), 3).drop("pid")


@_query("initial_paths", "label from_node:b to_node:b preds:b", _KMERS.format(k=2))
def _(spark, d):
    return P.initial_paths(kmers(spark, d, 2)).drop("file")


@_query("extend_paths", "label from_node:b to_node:b", "(SELECT CASE WHEN substr(tail, 2, 1) = '0' THEN substr(tail, 1, 2) ELSE substr(tail, 1, 4) END AS label, node AS from_node, CASE WHEN substr(tail, 4, 1) = '0' THEN NULL WHEN substr(tail, 5, 1) = '0' THEN 0 ELSE node + 4 END AS to_node FROM tails)")
def _(spark, d):
    return P.extend(P.initial_paths(kmers(spark, d, 2))).select("label", "from_node", "to_node")


@_query("extend_fanout", "label from_node:b to_node:b fanout:b", "(SELECT label, from_node, to_node, 1 AS fanout FROM " + _KMERS.format(k=2) + " WHERE to_node IS NOT NULL)")
def _(spark, d):
    return P.extension_fanout(P.initial_paths(kmers(spark, d, 2))).drop("file")


_PRUNE = """(WITH k AS (SELECT * FROM """ + _KMERS.format(k=6) + """), one AS (SELECT label FROM k GROUP BY label HAVING count(DISTINCT from_node) = 1),
p AS (SELECT label, from_node, substr(label, 1, CAST(i AS BIGINT)) AS prefix, i FROM k, range(1, 7) t(i)), u AS (SELECT prefix FROM p GROUP BY prefix HAVING count(DISTINCT from_node) = 1),
kk AS (SELECT label, min_by(prefix, i) AS key FROM p JOIN u USING (prefix) GROUP BY label)
SELECT kk.key AS label, from_node, NULL AS to_node, bit_or(preds) AS preds, 'unique' AS kind FROM k JOIN one USING (label) JOIN kk USING (label) GROUP BY kk.key, from_node
UNION ALL SELECT label, from_node, to_node, preds, CASE WHEN to_node IS NULL THEN 'nondeterministic' ELSE 'unsorted' END FROM k WHERE label NOT IN (SELECT label FROM one))"""


@_query("prune_paths", "label from_node:b to_node:b preds:b", _PRUNE)
def _(spark, d):
    return P.prune(P.initial_paths(kmers(spark, d, 6)))[0].drop("file")


@_query("prune_stats", "kind paths:b", "(SELECT kind, count(*) AS paths FROM " + _PRUNE + " GROUP BY kind)")
def _(spark, d):
    return P.prune(P.initial_paths(kmers(spark, d, 6)))[1]


@_query("doubling_equals_direct", "label node:b", "(SELECT substr(tail, 1, 8) AS label, node FROM tails)")
def _(spark, d):
    return P.double(P.initial_paths(kmers(spark, d, 2)), 2, pruned=False).select(F.rpad("label", 8, "0").alias("label"), F.col("from_node").alias("node"))


@_query("multi_file_merge", "file:b label from_node:b preds:b", """(WITH k AS (SELECT substr(tail, 1, 4) AS label, node, preds, user_id % 3 AS file, substr(tail, 4, 1) = '0' AS fin FROM tails WHERE user_id IS NOT NULL
  UNION ALL SELECT '0000', 0, CAST(bit_or(1 << CAST(comp AS INT)) AS BIGINT), user_id % 3, true FROM occ WHERE pos = n - 1 GROUP BY user_id % 3),
one AS (SELECT label, count(DISTINCT node) AS a, count(DISTINCT file) AS b FROM k GROUP BY label), p AS (SELECT label, node, file, substr(label, 1, CAST(i AS BIGINT)) AS prefix, i FROM k, range(1, 5) t(i)),
u AS (SELECT prefix FROM p GROUP BY prefix HAVING count(DISTINCT node) = 1 AND count(DISTINCT file) = 1), kk AS (SELECT label, min_by(prefix, i) AS key FROM p JOIN u USING (prefix) GROUP BY label)
SELECT file, kk.key AS label, node AS from_node, bit_or(preds) AS preds FROM k JOIN one USING (label) JOIN kk USING (label) WHERE a = 1 AND b = 1 GROUP BY file, kk.key, node
UNION ALL SELECT file, label, node, preds FROM k JOIN one USING (label) WHERE NOT (a = 1 AND b = 1))""")
def _(spark, d):
    return P.prune(P.initial_paths(kmers(spark, d, 4, 3)))[0].drop("to_node")


# ------------------------------------------------------------- the index


@_query("merged_nodes", "path_id:b key preds:b", "nodes")
def _(spark, d):
    return event_index(spark, d).nodes


@_query("node_values", "path_id:b node:b", "node_values")
def _(spark, d):
    return event_index(spark, d).node_values


@_query("edges", "src:b dst:b comp:b", "edges")
def _(spark, d):
    return event_index(spark, d).edges


@_query("indegree", "path_id:b n:b", "(SELECT path_id, bit_count(preds) AS n FROM nodes)")
def _(spark, d):
    return event_index(spark, d).nodes.select("path_id", F.bit_count("preds").alias("n"))


@_query("outdegree", "path_id:b n:b", "(SELECT src AS path_id, count(*) AS n FROM edges GROUP BY src)")
def _(spark, d):
    return event_index(spark, d).edges.groupBy(F.col("src").alias("path_id")).agg(F.count("*").alias("n"))


@_query("comp_first_node", "comp:b sp:b ep:b", "(SELECT CAST(substr(key, 1, 1) AS INT) AS comp, min(path_id) AS sp, max(path_id) AS ep FROM nodes GROUP BY 1)")
def _(spark, d):
    return S.char_ranges(event_index(spark, d))


@_query("samples", "path_id:b node:b", """(WITH o AS (SELECT path_id, list_sort(list(node)) AS own FROM node_values GROUP BY path_id), e AS (SELECT dst AS path_id, any_value(own) AS prev FROM edges JOIN o ON src = o.path_id GROUP BY dst HAVING count(*) = 1)
SELECT path_id, unnest(own) AS node FROM nodes JOIN o USING (path_id) LEFT JOIN e USING (path_id)
WHERE bit_count(preds) > 1 OR preds & 1 = 1 OR len(list_filter(own, lambda x: x % 1024 = 0)) > 0 OR prev IS NULL OR list_transform(prev, lambda x: x + 1) <> own)""")
def _(spark, d):
    return event_index(spark, d).samples


@_query("index_stats", "path_nodes:b edges:b max_query:b nodes_with_values:b", "(SELECT (SELECT count(*) FROM nodes) AS path_nodes, (SELECT count(*) FROM edges) AS edges, 4 AS max_query, (SELECT count(DISTINCT path_id) FROM node_values) AS nodes_with_values)")
def _(spark, d):
    index = event_index(spark, d)
    head = I.statistics(index).select("path_nodes", "edges", "max_query", F.lit(None).cast("long").alias("path_id"))
    own = index.node_values.select(*[F.lit(None).cast("long").alias(c) for c in ("path_nodes", "edges", "max_query")], "path_id")
    return head.unionByName(own).agg(F.max("path_nodes").alias("path_nodes"), F.max("edges").alias("edges"), F.max("max_query").alias("max_query"), F.countDistinct("path_id").alias("nodes_with_values"))


@_query("lcp_array", "path_id:b lcp:b", "lcp")
def _(spark, d):
    return event_index(spark, d).lcp


# ------------------------------------------------------------- search


@_query("find_short", "pattern sp:b ep:b", "found")
def _(spark, d):
    labels = _once(spark, d, "labels", lambda: kept(S.label_nodes(event_index(spark, d))))
    return S.find_by_labels(event_index(spark, d), patterns(spark, d), labels).drop("pid")


@_query("find_by_edges", "pattern sp:b ep:b", "found")
def _(spark, d):
    return S.find_by_edges(event_index(spark, d), patterns(spark, d)).drop("pid")


_LONG = "l1 AS (SELECT pattern, min(path_id) AS sp, max(path_id) AS ep FROM (SELECT DISTINCT p AS pattern FROM (SELECT substr(tail, 1, 6) AS p FROM tails UNION ALL SELECT reverse(substr(tail, 1, 6)) FROM tails) WHERE NOT contains(p, '0')) JOIN nodes ON substr(key, 1, 1) = substr(pattern, 6, 1) GROUP BY pattern)"
for _i in range(2, 7):
    _LONG += f", l{_i} AS (SELECT pattern, min(src) AS sp, max(src) AS ep FROM l{_i - 1} JOIN edges ON CAST(comp AS VARCHAR) = substr(pattern, {7 - _i}, 1) AND dst BETWEEN sp AND ep GROUP BY pattern)"


@_query("find_long", "pattern sp:b ep:b", f"(WITH {_LONG} SELECT l1.pattern, coalesce(l6.sp, 1) AS sp, coalesce(l6.ep, 0) AS ep FROM l1 LEFT JOIN l6 ON l1.pattern = l6.pattern)")
def _(spark, d):
    own = kmers(spark, d, 6).select("label").where(~F.col("label").contains("0"))
    every = own.union(own.select(F.reverse("label"))).distinct().select(F.col("label").alias("pid"), F.col("label").alias("pattern"))
    return S.find_by_kernel(event_index(spark, d), every).drop("pid")


@_query("find_count_locate", "pattern sp:b ep:b n:b first_node:b last_node:b", "(SELECT pattern, sp, ep, count(DISTINCT node) AS n, min(node) AS first_node, max(node) AS last_node FROM found LEFT JOIN node_values ON path_id BETWEEN sp AND ep GROUP BY pattern, sp, ep)")
def _(spark, d):
    index, ranges = event_index(spark, d), found(spark, d)
    at = S.locate(index, ranges).groupBy("pid").agg(F.min("node").alias("first_node"), F.max("node").alias("last_node"))
    return ranges.join(S.count(index, ranges), "pid").join(at, "pid", "left").select("pattern", "sp", "ep", "n", "first_node", "last_node")


@_query("count_occ", "pattern n:b", "(SELECT pattern, count(DISTINCT node) AS n FROM found LEFT JOIN node_values ON path_id BETWEEN sp AND ep GROUP BY pattern)")
def _(spark, d):
    return S.count(event_index(spark, d), found(spark, d)).select(F.col("pid").alias("pattern"), "n")


@_query("count_occ_distinct", "pattern n:b", "(SELECT pattern, count(DISTINCT node) AS n FROM found LEFT JOIN node_values ON path_id BETWEEN sp AND ep GROUP BY pattern)")
def _(spark, d):
    return S.count_distinct(event_index(spark, d), found(spark, d)).select(F.col("pid").alias("pattern"), "n")


@_query("locate_all", "pattern node:b", "(SELECT DISTINCT pattern, node FROM found JOIN node_values ON path_id BETWEEN sp AND ep)")
def _(spark, d):
    return S.locate(event_index(spark, d), found(spark, d)).select(F.col("pid").alias("pattern"), "node")


@_query("locate_node", "pattern node:b", "(SELECT DISTINCT pattern, node FROM found JOIN node_values ON path_id = sp WHERE sp <= ep)")
def _(spark, d):
    first = hits(spark, d).select("pid", "sp", F.col("sp").alias("ep"))
    return S.locate(event_index(spark, d), first).select(F.col("pid").alias("pattern"), "node")


@_query("locate_limit", "pattern n:b strays:b", "(SELECT pattern, least(count(DISTINCT node), 5) AS n, 0 AS strays FROM found JOIN node_values ON path_id BETWEEN sp AND ep GROUP BY pattern)")
def _(spark, d):
    index, ranges = event_index(spark, d), found(spark, d)
    some = kept(S.locate_some(index, ranges, 5))
    every = S.locate(index, ranges).join(F.broadcast(some), ["pid", "node"], "left_semi").withColumn("real", F.lit(1))
    return some.join(every, ["pid", "node"], "left").groupBy(F.col("pid").alias("pattern")).agg(F.countDistinct("node").alias("n"), F.count_if(F.col("real").isNull()).alias("strays"))


@_query("lf_step", "pattern sp:b ep:b", "(SELECT pattern, min(src) AS sp, max(src) AS ep FROM found JOIN edges ON dst BETWEEN sp AND ep WHERE comp = 1 GROUP BY pattern)")
def _(spark, d):
    return S.step_back(event_index(spark, d), hits(spark, d), F.lit(1)).select(F.col("pid").alias("pattern"), "sp", "ep")


def _lf(most: int) -> str:
    return f"(SELECT f.pattern, d AS comp, coalesce(min(src), 1) AS sp, coalesce(max(src), 0) AS ep FROM found f CROSS JOIN range(1, {most + 1}) t(d) LEFT JOIN edges ON dst BETWEEN f.sp AND f.ep AND comp = d WHERE f.sp <= f.ep GROUP BY f.pattern, d)"


@_query("lf_fast", "pattern comp:b sp:b ep:b", _lf(4))
def _(spark, d):
    return S.lf_fast(event_index(spark, d), hits(spark, d)).withColumnRenamed("pid", "pattern")


@_query("lf_all", "pattern comp:b sp:b ep:b", _lf(5))
def _(spark, d):
    return S.lf_all(event_index(spark, d), hits(spark, d)).withColumnRenamed("pid", "pattern")


@_query("lf_node", "path_id:b src:b", "(SELECT dst AS path_id, min_by(src, CASE WHEN comp = 0 THEN 7 ELSE comp END) AS src FROM edges GROUP BY dst)")
def _(spark, d):
    return S.lf_node(event_index(spark, d))


# ------------------------------------------------------------- suffix tree

_PARENT = """(WITH f AS (SELECT pattern, sp, ep, l.lcp AS ll, coalesce(r.lcp, 0) AS rl FROM found JOIN lcp l ON l.path_id = sp LEFT JOIN lcp r ON r.path_id = ep + 1 WHERE sp <= ep)
SELECT pattern, CASE WHEN sp = 0 AND ep = size - 1 THEN 0 WHEN ll = greatest(ll, rl) THEN coalesce((SELECT max(path_id) FROM lcp WHERE path_id < sp AND lcp < ll), 0) ELSE sp END AS psp,
CASE WHEN sp = 0 AND ep = size - 1 THEN size - 1 WHEN rl = greatest(ll, rl) THEN coalesce((SELECT min(path_id) FROM lcp WHERE path_id > ep + 1 AND lcp < rl), size) - 1 ELSE ep END AS pep,
CASE WHEN sp = 0 AND ep = size - 1 THEN 0 ELSE greatest(ll, rl) END AS depth FROM f, size)"""


@_query("st_parent", "pattern psp:b pep:b depth:b", _PARENT)
def _(spark, d):
    return T.parent(event_index(spark, d), hits(spark, d)).select(F.col("pid").alias("pattern"), F.col("sp").alias("psp"), F.col("ep").alias("pep"), "depth")


@_query("st_depth", "pattern depth:b", "(SELECT pattern, min(lcp) AS depth FROM found LEFT JOIN lcp ON path_id > sp AND path_id <= ep WHERE sp <= ep GROUP BY pattern)")
def _(spark, d):
    return T.depth(event_index(spark, d), hits(spark, d)).select(F.col("pid").alias("pattern"), "depth")


def _near(name: str, pick: str, side: str, less: str) -> str:
    value = f"(SELECT {pick}(b.path_id) FROM lcp b WHERE b.path_id {side} a.path_id AND b.lcp {less} a.lcp)"
    return f"coalesce({value}, size) AS {name}"


@_query("psv_nsv", "path_id:b lcp:b psv:b psev:b nsv:b nsev:b", f"(SELECT a.path_id, a.lcp, {_near('psv', 'max', '<', '<')}, {_near('psev', 'max', '<', '<=')}, {_near('nsv', 'min', '>', '<')}, {_near('nsev', 'min', '>', '<=')} FROM lcp a, size)")
def _(spark, d):
    return T.neighbours(event_index(spark, d)).select("path_id", "lcp", "psv", "psev", "nsv", "nsev")


@_query("rmq", "pattern pos:b lcp:b", "(SELECT pattern, min_by(path_id, lcp * 100000000 + path_id) AS pos, min(lcp) AS lcp FROM found JOIN lcp ON path_id BETWEEN sp AND ep GROUP BY pattern)")
def _(spark, d):
    return T.rmq(event_index(spark, d), hits(spark, d), branching=4).withColumnRenamed("pid", "pattern")


@_query("rmt_levels", "level:b pos:b lcp:b", "(WITH RECURSIVE r AS (SELECT 0 AS level, path_id AS pos, lcp FROM lcp UNION ALL SELECT level + 1, pos // 8, min(lcp) FROM r GROUP BY level, pos // 8 HAVING (SELECT max(pos) FROM r) > 0) SELECT * FROM r)")
def _(spark, d):
    return T.minimum_tree(event_index(spark, d), 8).select("level", "pos", "lcp")


# ------------------------------------------------------------- k-mers


@_query("count_kmers", "k:b n:b", "(SELECT k, count(*) AS n FROM distinct_kmers WHERE with_n = 0 GROUP BY k)")
def _(spark, d):
    return _counts(spark, d, False)


@_query("count_kmers_n", "k:b n:b", "(SELECT k, count(*) AS n FROM distinct_kmers WHERE with_n = 1 GROUP BY k)")
def _(spark, d):
    return _counts(spark, d, True)


def _counts(spark: SparkSession, d: str, with_n: bool) -> DataFrame:
    index, out = event_index(spark, d), None
    for k in range(1, ORDER + 1):
        one = K.kmers_of(index, k, with_n).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_FORCED = "g1 AS (SELECT CAST(d AS VARCHAR) AS kmer, min(path_id) AS sp, max(path_id) AS ep FROM nodes, range(1, 5) t(d) WHERE substr(key, 1, 1) = CAST(d AS VARCHAR) GROUP BY d)"
for _i in range(2, 7):
    _FORCED += f", g{_i} AS (SELECT CAST(comp AS VARCHAR) || kmer AS kmer, min(src) AS sp, max(src) AS ep FROM g{_i - 1} JOIN edges ON dst BETWEEN sp AND ep AND comp BETWEEN 1 AND 4 GROUP BY CAST(comp AS VARCHAR) || kmer)"


@_query("count_kmers_forced", "k:b n:b", f"(WITH {_FORCED} SELECT 6 AS k, count(*) AS n FROM g6)")
def _(spark, d):
    return K.expand_kmers(event_index(spark, d), 6).agg(F.count("*").alias("n")).select(F.lit(6).alias("k"), "n")


def _half(spark: SparkSession, d: str, late: bool) -> DataFrame:
    """Distinct k-mers of the events before, or from, the middle of January."""

    def make() -> DataFrame:
        events = spark.read.parquet(f"{d}/events.parquet")
        digits = F.create_map(*[F.lit(x) for kv in X.EVENT_DIGITS.items() for x in kv])
        cut = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        own = events.where(cut if late else ~cut).select("user_id", "ts", "event_id", digits[F.col("event_type")].alias("comp"))
        label = F.concat(*[F.lead("comp", i).over(w) if i else F.col("comp") for i in range(ORDER)])
        return kept(own.select(label.alias("kmer")).where("kmer IS NOT NULL").distinct())

    return _once(spark, d, f"half{late}", make)


@_query("compare_kmers", "shared:b left_only:b right_only:b", "(SELECT count(*) FILTER (a = 1 AND b = 1) AS shared, count(*) FILTER (b = 0) AS left_only, count(*) FILTER (a = 0) AS right_only FROM (SELECT kmer, max(CASE half WHEN 0 THEN 1 ELSE 0 END) AS a, max(half) AS b FROM halves GROUP BY kmer))")
def _(spark, d):
    return K.compare_kmers(_half(spark, d, False), _half(spark, d, True))


@_query("kmers_left_only", "kmer", "(SELECT kmer FROM halves WHERE half = 0 EXCEPT SELECT kmer FROM halves WHERE half = 1)")
def _(spark, d):
    return _half(spark, d, False).join(_half(spark, d, True), "kmer", "left_anti")


@_query("kmers_shared", "kmer", "(SELECT kmer FROM halves WHERE half = 0 INTERSECT SELECT kmer FROM halves WHERE half = 1)")
def _(spark, d):
    return _half(spark, d, False).intersect(_half(spark, d, True))


@_query("verify_failures", "failures:b labels:b", "(SELECT 0 AS failures, count(*) AS labels FROM (SELECT DISTINCT CASE WHEN contains(label, '0') THEN substr(label, 1, CAST(strpos(label, '0') AS BIGINT)) ELSE label END AS l FROM kp))")
def _(spark, d):
    index = event_index(spark, d)
    bad = V.failures(index, index.occurrences, most=None).select("what", F.lit(None).cast("string").alias("l"))
    labels = index.occurrences.select(F.lit(None).cast("string").alias("what"), F.regexp_extract("label", "^([^0]*0?)", 1).alias("l"))
    return bad.unionByName(labels).agg(F.count("what").alias("failures"), F.countDistinct("l").alias("labels"))


# ------------------------------------------------------------- a branching graph with cycles

_PARTS = """
g_c AS (SELECT a, b, count(*) AS n FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL GROUP BY a, b),
g_e AS (SELECT (a + 1) << 11 AS src, (b + 1) << 11 AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM g_c) WHERE r <= 2),
g_n AS (SELECT (p_partkey + 1) << 11 AS node, CAST(1 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 4 AS VARCHAR) AS comp FROM part)"""


def parts(spark: SparkSession, d: str) -> X.Graph:
    def make() -> X.Graph:
        g = X.parts_graph(spark, d)
        return X.Graph(kept(g.nodes), kept(g.edges))

    return _once(spark, d, "parts", make)


@_query("graph_edges", "src:b dst:b", f"(WITH {_PARTS} SELECT src, dst FROM g_e)")
def _(spark, d):
    return parts(spark, d).edges.select("src", "dst")


_PARTS_PATHS = _PARTS + """,
p4 AS (SELECT DISTINCT e1.src AS node, n1.comp || n2.comp || n3.comp || n4.comp AS label FROM g_e e1 JOIN g_e e2 ON e1.dst = e2.src JOIN g_e e3 ON e2.dst = e3.src JOIN g_e e4 ON e3.dst = e4.src
  JOIN g_n n1 ON n1.node = e1.src JOIN g_n n2 ON n2.node = e2.src JOIN g_n n3 ON n3.node = e3.src JOIN g_n n4 ON n4.node = e4.src)"""


@_query("graph_doubling", "label node:b", f"(WITH {_PARTS_PATHS} SELECT label, node FROM p4)")
def _(spark, d):
    paths = P.double(P.initial_paths(X.graph_kmers(parts(spark, d), 2)), 1, pruned=False)
    return paths.select("label", F.col("from_node").alias("node")).distinct()


@_query("graph_merged_nodes", "path_id:b key n_values:b", f"""(WITH {_PARTS_PATHS}, s4 AS (SELECT label, string_agg(DISTINCT CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) AS value FROM p4 GROUP BY label),
x4 AS (SELECT label, value, substr(label, 1, CAST(i AS BIGINT)) AS prefix, i FROM s4, range(1, 5) t(i)), u4 AS (SELECT prefix FROM x4 GROUP BY prefix HAVING count(DISTINCT value) = 1),
k4 AS (SELECT label, min_by(prefix, i) AS key FROM x4 JOIN u4 USING (prefix) GROUP BY label)
SELECT row_number() OVER (ORDER BY key) - 1 AS path_id, key, n_values FROM (SELECT key, count(DISTINCT node) AS n_values FROM p4 JOIN k4 USING (label) GROUP BY key))""")
def _(spark, d):
    nodes, values = P.merge(P.double(P.initial_paths(X.graph_kmers(parts(spark, d), 2)), 1))
    return nodes.join(values.groupBy("path_id").agg(F.count("*").alias("n_values")), "path_id").select("path_id", "key", "n_values")


# ------------------------------------------------------------- ranges and the baseline


@_query("range_functions", "pattern n:b n_bits:b inside:b", "(SELECT pattern, CASE WHEN sp > ep THEN 0 ELSE ep + 1 - sp END AS n, CASE WHEN sp = 0 THEN 1 ELSE CAST(floor(log2(sp)) AS BIGINT) + 1 END AS n_bits, greatest(least(100, ep), sp) AS inside FROM found)")
def _(spark, d):
    sp, ep = F.col("sp"), F.col("ep")
    return found(spark, d).select("pattern", G.length(sp, ep).alias("n"), G.bit_length(sp).alias("n_bits"), G.bound(F.lit(100), sp, ep).alias("inside"))


@_query("text_search", "pattern n:b", "(SELECT pattern, coalesce(n, 0) AS n FROM pats LEFT JOIN (SELECT substr(tail, 1, CAST(i AS BIGINT)) AS pattern, count(*) AS n FROM occ, range(1, 5) t(i) GROUP BY 1) USING (pattern))")
def _(spark, d):
    from ..operators import textsearch

    texts = rows(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "comp"))), lambda x: x["comp"]), "").alias("text"))
    return textsearch.count(texts, patterns(spark, d), 1).select(F.col("pid").alias("pattern"), "n")


# ------------------------------------------------------------- files


_FILES = """(SELECT CAST(user_id % 3 AS BIGINT) AS file, substr(tail, 1, 3) AS label, preds, CASE WHEN tail LIKE '0%' THEN 1 ELSE 1 << CAST(substr(tail, 4, 1) AS INT) END AS succs, node AS from_node,
  CASE WHEN substr(tail, 3, 1) = '0' THEN NULL WHEN substr(tail, 4, 1) = '0' THEN 0 ELSE node + 3 END AS to_node FROM tails WHERE user_id IS NOT NULL
  UNION ALL SELECT user_id % 3, '000', CAST(bit_or(1 << CAST(comp AS INT)) AS BIGINT), 1, 0, NULL FROM occ WHERE pos = n - 1 GROUP BY user_id % 3)"""


@_query("binary_round_trip", "file:b label preds:b succs:b from_node:b to_node:b", _FILES)
def _(spark, d):
    rows, bases = kmers(spark, d, 3, 3), [_scratch(spark, f"part{k}") for k in range(3)]
    for k, base in enumerate(bases):
        R.export_binary(rows.where(F.col("file") == k), base)
    return R.read_binary(spark, R.paths_of(bases, False))


@_query("text_to_binary", "label preds:b succs:b from_node:b to_node:b", _KMERS.format(k=3))
def _(spark, d):
    path = _scratch(spark, "lines") + R.TEXT
    R.to_lines(kmers(spark, d, 3)).select("value").write.text(path)
    return R.read_binary(spark, R.convert(spark, [path])).drop("file")


def _length(what: str, of: str) -> str:
    return f"SELECT '{what}' AS what, min(length(label)) AS least, max(length(label)) AS most, CASE WHEN min(length(label)) = max(length(label)) THEN max(length(label)) END AS k FROM ({of})"


@_query("k_check", "what least:b most:b k:b", "(" + _length("one length", f"SELECT label FROM {_KMERS.format(k=3)}") + " UNION ALL " + _length("two lengths", f"SELECT label FROM {_KMERS.format(k=3)} UNION ALL SELECT label FROM {_KMERS.format(k=2)}") + ")")
def _(spark, d):
    one, two = kmers(spark, d, 3), kmers(spark, d, 2)
    return R.common_length(one).withColumn("what", F.lit("one length")).unionByName(R.common_length(one.unionByName(two)).withColumn("what", F.lit("two lengths")))


@_query("mapping_round_trip", "id:b mapped:b", "(SELECT i AS id, CASE WHEN i % 2 = 0 AND c_custkey IS NOT NULL THEN c_custkey + 1000000 ELSE i END AS mapped FROM (SELECT min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer WHERE c_custkey % 2 = 0) r, range(0, 10000000) t(i) LEFT JOIN customer ON c_custkey = i WHERE i BETWEEN lo AND hi)")
def _(spark, d):
    own = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1000000).alias("mapped"))
    return R.read_mapping(spark, R.write_mapping(own, _scratch(spark, "ids") + ".mapping"))


@_query("mapping_insert", "id:b mapped:b", "(SELECT c_custkey AS id, c_custkey + 1000000 AS mapped FROM customer UNION ALL SELECT 5000000 + row_number() OVER (ORDER BY s) - 1, s FROM (SELECT DISTINCT s_suppkey AS s FROM supplier))")
def _(spark, d):
    own = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1000000).alias("mapped"))
    return N.append_mapping(own, spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id")), 5000000)


@_query("pattern_scan", "patterns:b characters:b", "(SELECT count(*) AS patterns, sum(length(p)) AS characters FROM (SELECT translate(substr(tail, 1, 4), '0123456', '$ACGTN#') AS p FROM tails) WHERE NOT regexp_full_match(p, 'N*'))")
def _(spark, d):
    path, lines = _scratch(spark, "patterns"), event_index(spark, d).occurrences.select(A.decode("label").alias("value"))
    lines.unionByName(spark.createDataFrame([("",), ("NNNN",)], "value string")).write.text(path)
    return R.pattern_totals(R.read_patterns(spark, path))


@_query("index_save_load", "path_id:b key preds:b lcp:b starts:b", "(SELECT path_id, key, preds, lcp, starts FROM nodes JOIN lcp USING (path_id) JOIN (SELECT path_id, count(*) AS starts FROM node_values GROUP BY path_id) USING (path_id))")
def _(spark, d):
    path = _scratch(spark, "index")
    event_index(spark, d).save(path)
    index = I.PathIndex.load(spark, path)
    return index.nodes.join(index.lcp, "path_id").join(index.node_values.groupBy("path_id").agg(F.count("*").alias("starts")), "path_id").select("path_id", "key", "preds", "lcp", "starts")


_HEADERS = [("pathloom-index", v, f) for v in range(5) for f in (0, 1)] + [("other", 1, 0)]


@_query("header_states", "tag version:b flags:b state", f"(SELECT *, CASE WHEN tag <> 'pathloom-index' THEN 'no index' WHEN flags <> 0 THEN 'unknown flags' WHEN version < {I.FIRST} THEN 'too old' WHEN version > {I.VERSION} THEN 'too new' ELSE 'readable' END AS state FROM (VALUES {', '.join(map(str, _HEADERS))}) t(tag, version, flags))")
def _(spark, d):
    meta, out = event_index(spark, d).meta, None
    for tag, version, flags in _HEADERS:
        path = _scratch(spark, "header")
        meta.withColumn("tag", F.lit(tag)).withColumn("version", F.lit(version)).withColumn("flags", F.lit(flags)).write.parquet(f"{path}/meta")
        one = I.describe(spark, path).select("tag", "version", "flags", "state")
        out = one if out is None else out.unionByName(one)
    return out


@_query("kmers_right_only", "kmer", "(SELECT kmer FROM halves WHERE half = 1 EXCEPT SELECT kmer FROM halves WHERE half = 0)")
def _(spark, d):
    return _half(spark, d, True).join(_half(spark, d, False), "kmer", "left_anti")


@_query("symmetric_difference", "side kmer", "(SELECT CASE half WHEN 0 THEN 'left' ELSE 'right' END AS side, translate(kmer, '0123456', '$ACGTN#') AS kmer FROM halves WHERE kmer IN (SELECT kmer FROM halves GROUP BY kmer HAVING count(DISTINCT half) = 1))")
def _(spark, d):
    path = _scratch(spark, "difference")
    R.symmetric_difference(_half(spark, d, False), _half(spark, d, True)).write.parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------- further scalars and look-ups


@_query("key_replace", "key:b", "(SELECT (dense_rank() OVER (ORDER BY label) - 1) * 65536 + preds * 256 + succs AS key FROM " + _KMERS.format(k=3) + ")")
def _(spark, d):
    own = kmers(spark, d, 3)
    ranks = P.ranked_labels(own).select("label", "rnk")
    return own.join(ranks, "label").select(A.replace_label(A.pack("label", "preds", "succs"), "rnk").alias("key"))


@_query("find_char", "path_id:b comp:b", "(SELECT path_id, CAST(substr(key, 1, 1) AS INT) AS comp FROM nodes)")
def _(spark, d):
    nodes = event_index(spark, d).nodes
    counts = A.char_counts(nodes.select(F.substr("key", F.lit(1), F.lit(1)).alias("comp")), "comp")
    return nodes.select("path_id", A.find_char(counts, "path_id").alias("comp"))


@_query("lf_by_rank", "pos:b comp:b lf:b", "(SELECT pos, comp, count(*) OVER (ORDER BY comp RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY comp) + row_number() OVER (PARTITION BY comp ORDER BY pos) - 1 AS lf FROM (SELECT row_number() OVER (ORDER BY tail, node) - 1 AS pos, CAST(pc AS INT) AS comp FROM occ))")
def _(spark, d):
    own = kmers(spark, d, 16).where("from_node <> 0").select("label", "from_node", F.floor(F.log2(F.col("preds").cast("double"))).cast("int").alias("comp"))
    ranked = kept(dense_ids(own, ["label", "from_node"], "pos").select("pos", "comp"))
    return S.lf_mapping(ranked, ranked.count())


@_query("lcp_increment", "path_id:b whole:b part:b", "(SELECT path_id, (lcp + 1) // 2 AS whole, (lcp + 1) % 2 AS part FROM lcp)")
def _(spark, d):
    whole, part = A.increment_lcp(F.floor(F.col("lcp") / 2), F.col("lcp") % 2, 2)
    return event_index(spark, d).lcp.select("path_id", whole.cast("long").alias("whole"), part.alias("part"))


def _shared(a: str, b: str) -> str:
    return f"coalesce(list_max(list_filter(range(1, 5), lambda i: i <= length({a}) AND i <= length({b}) AND substr({a}, 1, CAST(i AS BIGINT)) = substr({b}, 1, CAST(i AS BIGINT)))), 0)"


@_query("range_lcps", "path_id:b least:b most:b", f"(SELECT path_id, {_shared('key', 'z')} AS least, {_shared('x', 'y')} AS most FROM (SELECT path_id, key, lead(key, 1) OVER w AS x, lead(key, 2) OVER w AS y, lead(key, 3) OVER w AS z FROM nodes WINDOW w AS (ORDER BY path_id)) WHERE z IS NOT NULL)")
def _(spark, d):
    nodes = event_index(spark, d).nodes.select("path_id", "key")
    met = nodes
    for k, c in enumerate("xyz", 1):
        met = met.join(nodes.select((F.col("path_id") - k).alias("path_id"), F.col("key").alias(c)), "path_id")
    least, most = A.range_lcps("key", "x", "y", "z")
    return met.select("path_id", least.alias("least"), most.alias("most"))


@_query("unit_conversions", "event_id:b mb gb bits us", "(SELECT event_id, value / 1048576.0::DOUBLE AS mb, value / 1073741824.0::DOUBLE AS gb, 8.0::DOUBLE * value / (user_id + 1) AS bits, value * 1000000.0::DOUBLE AS us FROM events)")
def _(spark, d):
    value = F.col("value")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", G.in_megabytes(value).alias("mb"), G.in_gigabytes(value).alias("gb"), G.bits_per_character(value, F.col("user_id") + 1).alias("bits"), G.in_microseconds(value).alias("us"))


@_query("version", "version major:b minor:b patch:b", "(SELECT 'pathloom version ' || a || '.' || b || '.' || c AS version, a AS major, b AS minor, c AS patch FROM (VALUES (1, 1, 0)) t(a, b, c))")
def _(spark, d):
    return report.about(spark)


@_query("verbosity_levels", "event_id:b name", "(SELECT event_id, list_extract(['silent', 'basic', 'extended', 'full'], least(event_id % 7, 3) + 1) AS name FROM events)")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", report.level_name(F.col("event_id") % 7).alias("name"))


@_query("k_guard", "k:b forced:b n:b", f"(WITH {_FORCED} SELECT 0 AS k, 0 AS forced, 1 AS n UNION ALL SELECT 3, 0, (SELECT count(*) FROM distinct_kmers WHERE with_n = 0 AND k = 3) UNION ALL SELECT 6, 0, 0 UNION ALL SELECT 6, 1, (SELECT count(*) FROM g6))")
def _(spark, d):
    cases = [(0, False), (3, False), (6, False), (6, True)]
    return spark.createDataFrame([(k, int(f), K.count_kmers(event_index(spark, d), k, force=f)) for k, f in cases], "k long, forced long, n long")


@_query("compare_guard", "k:b shared:b left_only:b right_only:b", "(SELECT 0 AS k, 1 AS shared, 0 AS left_only, 0 AS right_only UNION ALL SELECT 3, (SELECT count(*) FROM distinct_kmers WHERE with_n = 0 AND k = 3), 0, 0 UNION ALL SELECT 9, 0, 0, 0 UNION ALL SELECT 65, 0, 0, 0)")
def _(spark, d):
    index, out = event_index(spark, d), None
    for k, force in ((0, False), (3, False), (9, False), (65, True)):
        one = K.compare_indexes(index, index, k, force=force).select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@_query("batch_report", "patterns:b found:b nodes:b occurrences:b located:b depth", f"""(WITH p AS {_PARENT}, n AS (SELECT pattern, count(DISTINCT node) AS n FROM found JOIN node_values ON path_id BETWEEN sp AND ep GROUP BY pattern)
SELECT (SELECT count(*) FROM found) AS patterns, (SELECT count(*) FROM found WHERE sp <= ep) AS found, (SELECT sum(ep - sp + 1) FROM found WHERE sp <= ep) AS nodes, (SELECT sum(n) FROM n) AS occurrences, (SELECT sum(n) FROM n) AS located, (SELECT avg(depth) FROM p) AS depth)""")
def _(spark, d):
    return S.batch_report(event_index(spark, d), patterns(spark, d))


@_query("runs", "path_id:b run:b", "(SELECT path_id, sum(CASE WHEN n = p THEN 0 ELSE 1 END) OVER (ORDER BY path_id) AS run FROM (SELECT path_id, bit_count(preds) AS n, lag(bit_count(preds)) OVER (ORDER BY path_id) AS p FROM nodes))")
def _(spark, d):
    rows = event_index(spark, d).nodes.select(F.col("path_id").alias("id"), F.bit_count("preds").alias("n"))
    return P.numbered_runs(rows, "n").select(F.col("id").alias("path_id"), "run")


@_query("seeded_shuffle", "node:b place:b", f"(SELECT node, row_number() OVER (ORDER BY ((node % {G._PRIME}) * {G._FACTOR} + {7 * G._SEED_FACTOR % G._PRIME}) % {G._PRIME}, node) - 1 AS place FROM occ)")
def _(spark, d):
    return G.shuffled(rows(spark, d).select("node"), 7, "node", "place")


@_query("sizes", "what n:b", "(WITH k AS (SELECT * FROM " + _KMERS.format(k=2) + ") SELECT 'kmers' AS what, count(*) AS n FROM k UNION ALL SELECT 'labels', count(DISTINCT label) FROM k UNION ALL SELECT 'starts', count(DISTINCT from_node) FROM k UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'values', count(*) FROM lcp)")
def _(spark, d):
    return K.sizes(event_index(spark, d), kmers(spark, d, 2)).where("what <> 'samples'")


@_query("prune_ranges", "ranges:b shared:b", "(SELECT count(*) AS ranges, count(*) FILTER (n > 1) AS shared FROM (SELECT label, count(*) AS n FROM " + _PRUNE + " GROUP BY label))")
def _(spark, d):
    return P.ranges(P.prune(P.initial_paths(kmers(spark, d, 6)))[0])


@_query("st_root", "sp:b ep:b left_lcp:b right_lcp:b depth:b", "(SELECT 0 AS sp, count(*) - 1 AS ep, min(lcp) AS left_lcp, 0 AS right_lcp, 0 AS depth FROM lcp)")
def _(spark, d):
    return T.root(event_index(spark, d))


@_query("psv_batch", "path_id:b psv:b psev:b nsv:b nsev:b", f"(SELECT a.path_id, {_near('psv', 'max', '<', '<')}, {_near('psev', 'max', '<', '<=')}, {_near('nsv', 'min', '>', '<')}, {_near('nsev', 'min', '>', '<=')} FROM lcp a, size WHERE a.path_id IN (SELECT sp FROM found WHERE sp <= ep))")
def _(spark, d):
    at = hits(spark, d).select(F.col("sp").alias("path_id"))
    return T.neighbours(event_index(spark, d), at).select("path_id", "psv", "psev", "nsv", "nsev")


@_query("rmt_arithmetic", "pos:b parent:b first_child:b last_child:b first_sibling:b last_sibling:b is_first", "(SELECT path_id AS pos, path_id // 8 AS parent, path_id * 8 AS first_child, least((path_id + 1) * 8, size * 8 - 3) - 1 AS last_child, path_id - path_id % 8 AS first_sibling, least(path_id - path_id % 8 + 8, size) - 1 AS last_sibling, path_id % 8 = 0 AS is_first FROM lcp, size)")
def _(spark, d):
    index, pos = event_index(spark, d), F.col("path_id")
    size = F.lit(index.size)
    return index.lcp.select(
        pos.alias("pos"), T.tree_parent(pos, 8).alias("parent"), T.tree_first_child(pos, 8).alias("first_child"), T.tree_last_child(pos, size * 8 - 3, 8).alias("last_child"), T.tree_first_sibling(pos, 8).alias("first_sibling"),
        T.tree_last_sibling(pos, size, 8).alias("last_sibling"), T.tree_is_first(pos, 8).alias("is_first"),
    )


_SAMPLED = _SQL["samples"][_SQL["samples"].rindex("(WITH o AS") :]


@_query("sample_ranges", "path_id:b first:b last:b", f"(SELECT path_id, min(place) AS first, max(place) AS last FROM (SELECT path_id, row_number() OVER (ORDER BY path_id, node) - 1 AS place FROM {_SAMPLED}) GROUP BY path_id)")
def _(spark, d):
    return S.sample_ranges(event_index(spark, d))


@_query("sampled", "path_id:b is_sampled", f"(SELECT path_id, path_id IN (SELECT path_id FROM {_SAMPLED}) AS is_sampled FROM nodes)")
def _(spark, d):
    index = event_index(spark, d)
    return S.sampled(index, index.nodes.select("path_id"))


@_query("locate_by_samples", "pattern node:b", "(SELECT DISTINCT pattern, node FROM found JOIN node_values ON path_id BETWEEN sp AND ep)")
def _(spark, d):
    return S.locate_by_samples(event_index(spark, d), found(spark, d)).select(F.col("pid").alias("pattern"), "node")


@_query("bit_vectors", "comp:b kind word:b bits:b", "(SELECT comp, CASE WHEN comp BETWEEN 1 AND 4 THEN 'plain' ELSE 'sparse' END AS kind, dst // 32 AS word, bit_or(CAST(1 AS BIGINT) << CAST(dst % 32 AS INT)) AS bits FROM edges GROUP BY comp, dst // 32)")
def _(spark, d):
    return S.bit_vectors(event_index(spark, d))


_DBG = "k3 AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS rnk, preds FROM (SELECT label, bit_or(preds) AS preds FROM " + _KMERS.format(k=3) + " GROUP BY label))"


def graph_of_kmers(spark: SparkSession, d: str) -> S.DeBruijnGraph:
    return _once(spark, d, "dbg", lambda: S.de_bruijn_graph(kept(P.ranked_labels(kmers(spark, d, 3))), 3))


@_query("dbg_edges", "src:b dst:b comp:b", f"(WITH {_DBG} SELECT u.rnk AS src, v.rnk AS dst, d AS comp FROM k3 v, digits, k3 u WHERE (v.preds >> CAST(d AS BIGINT)) & 1 = 1 AND u.label = CAST(d AS VARCHAR) || substr(v.label, 1, 2))")
def _(spark, d):
    return graph_of_kmers(spark, d).edges


@_query("dbg_char_range", "comp:b sp:b ep:b", f"(WITH {_DBG} SELECT CAST(substr(label, 1, 1) AS INT) AS comp, min(rnk) AS sp, max(rnk) AS ep FROM k3 GROUP BY 1)")
def _(spark, d):
    return graph_of_kmers(spark, d).char_range()


@_query("dbg_lf", "pattern comp:b sp:b ep:b", f"""(WITH {_DBG}, r AS (SELECT substr(label, 1, CAST(i AS BIGINT)) AS pattern, min(rnk) AS sp, max(rnk) AS ep FROM k3, range(1, 4) t(i) GROUP BY 1),
e AS (SELECT u.rnk AS src, v.rnk AS dst, d AS comp FROM k3 v, digits, k3 u WHERE (v.preds >> CAST(d AS BIGINT)) & 1 = 1 AND u.label = CAST(d AS VARCHAR) || substr(v.label, 1, 2))
SELECT r.pattern, d AS comp, coalesce(min(src), 1) AS sp, coalesce(max(src), 0) AS ep FROM r JOIN pats USING (pattern) CROSS JOIN range(1, 6) t(d) LEFT JOIN e ON dst BETWEEN r.sp AND r.ep AND comp = d GROUP BY r.pattern, d)""")
def _(spark, d):
    g = graph_of_kmers(spark, d)
    at = g.find(patterns(spark, d)).where("sp <= ep").select("pid", "sp", "ep")
    return g.lf(at, [1, 2, 3, 4, 5]).withColumnRenamed("pid", "pattern")


_GUARDED = "k2 AS (SELECT DISTINCT e1.src AS f, n1.comp || n2.comp AS label, e2.dst AS t FROM g_e e1 JOIN g_e e2 ON e1.dst = e2.src JOIN g_n n1 ON n1.node = e1.src JOIN g_n n2 ON n2.node = e2.src)"


@_query("size_guard", "paths:b label_bytes:b", f"(WITH {_PARTS}, {_GUARDED} SELECT count(*) AS paths, 4 * count(*) AS label_bytes FROM k2 a JOIN k2 b ON a.t = b.f)")
def _(spark, d):
    return spark.createDataFrame([P.extended_size(P.initial_paths(X.graph_kmers(parts(spark, d), 2)))], "paths long, label_bytes long")


# ------------------------------------------------------------- the whole index of the branching graph, and one of order 16

#: From labels with values to nodes, edges, ranges and LCP, for labels of four digits.
_CHAIN = COMMON[COMMON.index("sets AS") : COMMON.index("distinct_kmers AS")].rstrip().rstrip(",")
_GRAPH = _PARTS_PATHS + """,
gp AS (SELECT dst AS node, bit_or(1 << CAST(comp AS INT)) AS preds FROM g_e JOIN g_n ON node = src GROUP BY dst),
kp AS (SELECT label, p4.node, CAST(coalesce(preds, 64) AS BIGINT) AS preds FROM p4 LEFT JOIN gp ON p4.node = gp.node), """ + _CHAIN
#: The same for labels of sixteen digits.
_ORDER16 = "kp AS (SELECT substr(tail, 1, 16) AS label, node, preds FROM tails), " + _CHAIN.replace("range(1, 5)", "range(1, 17)").replace("range(1, 6)", "range(1, 18)")


def graph_index(spark: SparkSession, d: str) -> I.PathIndex:
    """The index of the branching graph of parts: two parts a k-mer, doubled once."""
    return _once(spark, d, "graph index", lambda: I.build_index(X.graph_kmers(parts(spark, d), 2), steps=1, occurrences=True))


def long_index(spark: SparkSession, d: str) -> I.PathIndex:
    """The index of all users' event sequences of order 16: four events a k-mer, doubled twice."""
    return _once(spark, d, "long index", lambda: I.build_index(kmers(spark, d, 4), steps=2, occurrences=True))


def _whole(prefix: str, chain: str, index: Callable[[SparkSession, str], I.PathIndex], lengths: str) -> None:
    """Queries of nodes, values, edges, LCP, find, count, locate and parent of an index."""
    own = f"(WITH {chain}"

    def batch(spark: SparkSession, d: str) -> DataFrame:
        """The prefixes of some lengths of all labels, forwards and backwards."""

        def make() -> DataFrame:
            cut = F.explode(F.array(*[F.substr("label", F.lit(1), F.lit(int(n))) for n in lengths.split(",")]))
            there = index(spark, d).occurrences.select(cut.alias("pattern")).where(~F.col("pattern").contains("0")).distinct()
            return kept(there.union(there.select(F.reverse("pattern"))).distinct().select(F.col("pattern").alias("pid"), "pattern"))

        return _once(spark, d, f"{prefix} batch", make)

    def ranges(spark: SparkSession, d: str) -> DataFrame:
        return _once(spark, d, f"{prefix} found", lambda: kept(S.find_by_labels(index(spark, d), batch(spark, d))))

    pats = f"""qs AS (SELECT DISTINCT substr(label, 1, n) AS p FROM sets, unnest([{lengths}]::BIGINT[]) t(n)), qp AS (SELECT p AS pattern FROM qs WHERE NOT contains(p, '0') UNION SELECT reverse(p) FROM qs WHERE NOT contains(p, '0')),
qf AS (SELECT pattern, coalesce(sp, 1) AS sp, coalesce(ep, 0) AS ep FROM qp LEFT JOIN lr USING (pattern))"""
    parent = _PARENT.replace("FROM found", "FROM qf").replace("(WITH f AS", f"(WITH {chain}, {pats}, f AS")

    _query(f"{prefix}_nodes", "path_id:b key preds:b", f"{own} SELECT * FROM nodes)")(lambda spark, d: index(spark, d).nodes)
    _query(f"{prefix}_values", "path_id:b node:b", f"{own} SELECT * FROM node_values)")(lambda spark, d: index(spark, d).node_values)
    _query(f"{prefix}_index_edges", "src:b dst:b comp:b", f"{own} SELECT * FROM edges)")(lambda spark, d: index(spark, d).edges)
    _query(f"{prefix}_lcp", "path_id:b lcp:b", f"{own} SELECT * FROM lcp)")(lambda spark, d: index(spark, d).lcp)
    _query(f"{prefix}_find", "pattern sp:b ep:b", f"{own}, {pats} SELECT * FROM qf)")(lambda spark, d: S.find(index(spark, d), batch(spark, d)).drop("pid"))
    _query(f"{prefix}_find_labels", "pattern sp:b ep:b", f"{own}, {pats} SELECT * FROM qf)")(lambda spark, d: ranges(spark, d).drop("pid"))
    _query(f"{prefix}_count", "pattern n:b", f"{own}, {pats} SELECT pattern, count(DISTINCT node) AS n FROM qf LEFT JOIN node_values ON path_id BETWEEN sp AND ep GROUP BY pattern)")(lambda spark, d: S.count(index(spark, d), ranges(spark, d)).withColumnRenamed("pid", "pattern"))
    _query(f"{prefix}_locate", "pattern node:b", f"{own}, {pats} SELECT DISTINCT pattern, node FROM qf JOIN node_values ON path_id BETWEEN sp AND ep)")(lambda spark, d: S.locate(index(spark, d), ranges(spark, d)).withColumnRenamed("pid", "pattern"))
    _query(f"{prefix}_parent", "pattern psp:b pep:b depth:b", parent)(lambda spark, d: T.parent(index(spark, d), ranges(spark, d).where("sp <= ep")).select(F.col("pid").alias("pattern"), F.col("sp").alias("psp"), F.col("ep").alias("pep"), "depth"))


_whole("graph", _GRAPH, graph_index, "1,2,3,4")
_whole("order16", _ORDER16, long_index, "2,5,8,12,16")
