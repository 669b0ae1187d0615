"""URL filters: host and path rules, then a logistic regression of hashed character n-grams of host and path.

All on DataFrame functions: splitting, rules, hashing, training and scoring. The regression is trained by gradient steps over the whole small
labelled table below at once, with momentum. Its weights are sums of the rows' n-grams, so each step moves one number for each row, by the
table of the rows' inner products; the n-grams meet by a join, and their weights are summed by a groupBy at the end. The table is small, so all that is one task without a shuffle.
The weights (BUCKETS numbers and a bias) are the one thing that reaches the driver.

A null URL, or one without ``://``, has an empty host and path; no rule fits it and the model judges the empty text
(its bias). Repeated rows are judged each; very long URLs are judged whole, in linear time; of rules of one length the first wins. An empty table gives an
empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (action, host, path prefix): a rule fits its host and all subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Sizes of n-grams, their buckets, the base and the modulus of their hash (a prime), steps, their length, shrinkage, the bias's feature, verdict threshold.
SIZES, BUCKETS, BASE, MODULUS, STEPS, STEP, SHRINK, BIAS, THRESHOLD = (3, 4, 5), 4096, 1000003, 2147483647, 60, 0.08, 0.002, 0.3, 0.5

#: The labelled table is made of common words: words of sites to block, and ordinary ones.
BAD = (
    "casino poker roulette jackpot slots bingo betting bets lottery win pills pharma viagra meds diet replica payday loans cash rich adult xxx sex porn cams dating escort spam ads adserver tracker track click popup farm free cheap bonus crack warez torrent"
).split()
PLAIN = (
    "city library garden weather report university press national museum daily news history notes cooking school recipe river walk mountain open data research lab science journal public radio train time health water board theatre "
    "music nation archive math leather north station house motion study edition table stable art reading room learning engine market travel address bird sea mail winter summer forest stone author book paper light green bridge "
    "family child teacher doctor farmhouse kitchen village island ocean planet energy street office project team player sport game film camera photo design color number letter language word story"
).split()
SUBDOMAINS, DOMAINS, FOLDERS, ENDS = ("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net"), ("en", "de", "fr", "es"), ("", "/", ".html")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and action, both null if none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, own, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        name, action = F.when(fits, own + prefix).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for each row: as the variable of a transform over one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(text: Column) -> Column:
    """The buckets of all n-grams of ``^text$``, as an array: a polynomial hash of their characters modulo a prime."""

    def grams(codes: Column, n: int) -> Column:
        def bucket(i: Column) -> Column:
            h = F.lit(0).cast("long")
            for k in range(n):
                h = (h * BASE + F.element_at(codes, i + k)) % MODULUS
            return (h % BUCKETS).cast("int")

        return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(codes) - (n - 1), F.lit(1))), bucket)).otherwise(F.array().cast("array<int>"))

    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    return F.when(F.length(text) > 0, _bound(codes, lambda c: F.concat(*[grams(c, n) for n in SIZES]))).otherwise(F.array().cast("array<int>"))


def labelled_rows() -> list[tuple[str, int]]:
    """(host and path, label) of the labelled table: each bad word alone, with an ordinary and with another bad one, each ordinary word alone or with another one."""
    names = []
    for k, w in enumerate(BAD):
        names += [(w, 1), (f"{w}-{PLAIN[7 * k % len(PLAIN)]}", 1), (f"{BAD[(5 * k + 3) % len(BAD)]}{'-' * (k % 2)}{w}", 1)]
    for k, w in enumerate(PLAIN):
        names += [(w, 0), (f"{w}{'-' * (k % 2)}{PLAIN[(11 * k + 5) % len(PLAIN)]}", 0)]
    at = lambda k, m: (k * 2654435761 >> 9) % m  # noqa: E731  spreads hosts and paths over both labels
    return [(f"{SUBDOMAINS[at(k, 4)]}{name}.{DOMAINS[at(k + 500, 3)]}/{FOLDERS[at(k + 1000, 4)]}/{at(k + 1500, 9000)}{ENDS[at(k + 2000, 3)]}", y) for k, (name, y) in enumerate(names)]


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: n, text, y."""
    values = ", ".join(f"({k}, '{t}', {y}D)" for k, (t, y) in enumerate(labelled_rows()))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(n, text, y)")


def train(spark: SparkSession, rows: DataFrame | None = None) -> list[float]:
    """Weights of the buckets, then the bias. ``rows``: a small table of n (0, 1, ...), text and y; its square is held in one task. Without rows, all are 0.

    A row's features are its n-grams' counts, by the root of the sum of their squares, and BIAS.
    """
    rows = (labelled(spark) if rows is None else rows).coalesce(1)
    counts = rows.select("n", F.explode(ngrams(F.col("text"))).alias("at")).groupBy("n", "at").agg(F.count("*").alias("c"))
    size = counts.groupBy("n").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    features = counts.join(F.broadcast(size), "n").select("n", "at", (F.col("c") / F.col("size")).alias("x"))
    a, b = features.select(F.col("n").alias("i"), "at", F.col("x").alias("xi")), features.select(F.col("n").alias("j"), "at", F.col("x").alias("xj"))
    met = a.join(b, "at").groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("k"))
    lines = met.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("row"))
    labels = rows.select("n", "y")
    whole = labels.join(lines, labels.n == lines.i, "left").agg(F.array_sort(F.collect_list(F.struct("n", "y", "row"))).alias("t"))

    def step(state: Column, table: Column, t: Column) -> Column:
        ahead = F.zip_with(state["now"], state["last"], lambda x, y: x + t / (t + 3) * (x - y))

        def moved(at: Column) -> Column:
            margin = lambda r: F.aggregate(F.zip_with(r["k"], at, lambda k, a: k * a), F.lit(0.0), lambda s, v: s + v)
            now = F.zip_with(table, at, lambda r, x: x * (1 - STEP * SHRINK) + STEP * (r["y"] - 1 / (1 + F.exp(-margin(r)))))
            return F.struct(now.alias("now"), state["now"].alias("last"))

        return _bound(ahead, moved)

    # a row's inner products with all rows, the bias's feature among theirs
    line = lambda row: F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda j: F.coalesce(F.element_at(row, j), F.lit(0.0)) + BIAS * BIAS)
    products = F.transform("t", lambda r: F.struct(r["y"].alias("y"), _bound(F.map_from_entries(r["row"]), line).alias("k")))
    zero = F.struct(F.array_repeat(F.lit(0.0), F.size("t")).alias("now"), F.array_repeat(F.lit(0.0), F.size("t")).alias("last"))
    trained = _bound(products, lambda table: F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), zero, lambda state, t: step(state, table, t)))
    dual = whole.where(F.size("t") > 0).select(trained["now"].alias("alpha"))
    alphas = dual.select(F.posexplode("alpha").alias("n", "alpha"))
    summed = features.join(F.broadcast(alphas), "n").groupBy("at").agg(F.sum(F.col("alpha") * F.col("x")).alias("w"))
    got = {r["at"]: r["w"] for r in summed.union(alphas.agg(F.lit(BUCKETS).alias("at"), (F.sum("alpha") * BIAS * BIAS).alias("w"))).collect()}
    return [got.get(k) or 0.0 for k in range(BUCKETS + 1)]


def probability(text: Column, weights: list[float]) -> Column:
    """The model's probability that a URL's host and path are to be blocked: the mean weight of its n-grams by the root of the sum of their counts' squares."""
    w = F.split(F.lit(",".join(map(repr, weights[:BUCKETS]))), ",").cast("array<double>")

    def margin(at: Column) -> Column:
        ordered = F.array_sort(at)
        runs = lambda o: F.aggregate(o, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda s, i: F.struct(i.alias("last"), F.when(i == s["last"], s["run"] + 1).otherwise(1.0).alias("run"), (s["sum"] + F.when(i == s["last"], 2 * s["run"] + 1).otherwise(1.0)).alias("sum")))["sum"]
        total = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1))
        return F.when(F.size(at) > 0, total / F.sqrt(runs(ordered))).otherwise(0.0)

    return 1 / (1 + F.exp(-(_bound(ngrams(text), margin) + weights[BUCKETS])))


def judge(pages: DataFrame, weights: list[float], id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row: the rule's action, else the model's."""
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    model = F.when(probability(F.concat("host", "path"), weights) >= THRESHOLD, "block").otherwise("allow")
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    return ruled.select("page_id", "host", "path", "rule", F.when(F.col("action").isNotNull(), F.col("action")).otherwise(model).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"), train(spark))


# ------------------------------------------------------------- the same in plain Python and SQL, for comparison


def plain_ngrams(text: str) -> list[int]:
    """As ``ngrams``."""
    out, s = [], f"^{text}$"
    for n in SIZES if text else ():
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * BASE + ord(c)) % MODULUS
            out.append(h % BUCKETS)
    return out


def plain_train(rows: list[tuple[str, int]] | None = None) -> list[float]:
    """As ``train``, by steps on the weights themselves."""
    import numpy as np

    rows = labelled_rows() if rows is None else rows
    x = np.array([np.bincount(plain_ngrams(t), minlength=BUCKETS) for t, _ in rows], float).reshape(len(rows), BUCKETS)
    x = np.hstack([x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300), np.full((len(rows), 1), BIAS)])
    y, w, last = np.array([float(v) for _, v in rows]), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(STEPS):
        ahead, last = w + t / (t + 3) * (w - last), w
        w = ahead * (1 - STEP * SHRINK) + STEP * (x.T @ (y - 1 / (1 + np.exp(-(x @ ahead)))))
    return [*w[:BUCKETS].tolist(), float(w[BUCKETS]) * BIAS]


def plain_probability(text: str, w: list[float]) -> float:
    """As ``probability``."""
    at = plain_ngrams(text)
    size = math.sqrt(sum(at.count(i) ** 2 for i in set(at)))
    return 1 / (1 + math.exp(-(w[BUCKETS] + (sum(w[i] for i in at) / size if at else 0))))


def oracle_sql() -> str:
    """The query as DuckDB SQL."""
    w = plain_train()
    url = "coalesce(url, '')"
    host = rf"translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')"
    path = rf"regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    best = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(a, h, p)}'" for a, h, p in best) + " END"
    weights = "[" + ", ".join(map(repr, w[:BUCKETS])) + "]::DOUBLE[]"
    hashed = lambda n: "0::BIGINT" if not n else f"(({hashed(n - 1)}) * {BASE} + unicode(substr(m, i + {n - 1}, 1))) % {MODULUS}"
    grams = " UNION ALL ".join(f"SELECT m, ({hashed(n)}) % {BUCKETS} AS g FROM texts, range(1, length(m) - {n - 2}) t(i)" for n in SIZES)
    return f"""
WITH split AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
ruled AS (SELECT *, {case(lambda a, h, p: h + p)} AS rule, {case(lambda a, h, p: a)} AS action, '^' || host || path || '$' AS m FROM split),
texts AS (SELECT DISTINCT m, m AS s FROM ruled WHERE length(m) > 2),
grams AS ({grams.replace("range(1", "range(1::BIGINT").replace("substr(m, i", "substr(m, CAST(i AS BIGINT)")}),
counts AS (SELECT m, g, count(*) AS c FROM grams GROUP BY m, g),
scored AS (SELECT m, sum(c * ({weights})[g + 1]) / sqrt(sum(c * c)) AS z FROM counts GROUP BY m)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN 1 / (1 + exp(-({w[BUCKETS]!r} + coalesce(z, 0)))) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN scored USING (m)"""
