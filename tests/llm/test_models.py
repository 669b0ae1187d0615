"""Toxicity, quality and URL classifiers."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pathloom.llm import quality, toxicity, url_filter
from pathloom.llm.common import word_hashes
from pathloom.llm.linear import HashedLinear, fit_sample, labelled_sample

GOOD, BAD = "the rain falls on green hills and slow rivers carry it far away".split(), "you idiot moron clown".split()


def corpus(n, seed=0):
    rng = random.Random(seed)
    for k in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randint(3, 60))]
        if k % 3 == 0:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randint(0, len(words)), rng.choice(BAD[1:]))
        yield k, " ".join(words), int(k % 3 == 0)


def test_linear_model_separates_held_out_rows():
    rows = list(corpus(600))
    m = HashedLinear().fit([t for _, t, _ in rows[:400]], [y for *_, y in rows[:400]])
    right = [(m.score(t) >= 0.5) == y for _, t, y in rows[400:]]
    assert np.mean(right) > 0.95
    assert 0 <= m.score("") <= 1 and m.score("") == m.score("")
    one = HashedLinear().fit(["a", "b"], [1, 1])
    none = HashedLinear().fit([], [])
    assert 0 < one.score("x") < 1 and none.score("x") == 0.5


def plain_features(model, text):
    """Shares of the hashed features, n-gram by n-gram."""
    t = text.lower() if model.lower else text
    c, out = [ord(x) for x in f"\n{t}\n"], collections.Counter()
    for n in model.sizes:
        for i in range(len(c) - n + 1):
            h = c[i]
            for x in c[i + 1 : i + n]:
                h = (h * 0x01000193 + x * 0x9E3779B1) % 2**32
            out[h * 0x9E3779B1 % 2**32 >> 32 - model.bits] += 1
    if model.words:
        w = [int(x) for x in word_hashes(t.encode())]
        out.update(x >> 64 - model.bits for x in w)
        out.update((a * 0x9E3779B97F4A7C15 + b) % 2**64 >> 64 - model.bits for a, b in zip(w, w[1:], strict=False))
    total = sum(out.values()) + model.smooth
    return {k: v / total for k, v in out.items()} if out else {}


@pytest.mark.parametrize("words", [False, True])
def test_fit_equals_plain_python(words):
    rows = [(t, y) for _, t, y in corpus(60, 5)]
    m = HashedLinear(sizes=(2, 3), bits=14, words=words, lower=not words, log_ratio=not words, smooth=0 if words else 50, passes=2).fit([t for t, _ in rows], [y for _, y in rows])
    xs = [plain_features(m, t) for t, _ in rows]
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    held = lambda k, y: sum(k in x for x, (_, z) in zip(xs, rows, strict=True) if z == y)
    r = {k: math.log((held(k, 1) + 0.5) / (n1 + 1)) - math.log((held(k, 0) + 0.5) / (n0 + 1)) if m.log_ratio else 1.0 for x in xs for k in x}
    w, sums, b, own = collections.defaultdict(float), collections.defaultdict(lambda: 1e-6), 0.0, 1e-6
    for _ in range(2):
        for x, (t, y) in zip(xs, rows, strict=True):
            z = b + sum(w[k] * r[k] * v * 100 for k, v in x.items())
            g = (1 / (1 + math.exp(-z)) - y) * len(rows) * (0.5 / n1 if y else 0.5 / n0)
            total = sum(plain_counts(m, t).values()) + m.smooth
            for k, v in x.items():
                sums[k] += (g * r[k] * 100 / total) ** 2 * v * total
            for k, v in x.items():
                w[k] -= 0.1 * g * r[k] * 100 * v / math.sqrt(sums[k])
            own += g * g
            b -= 0.1 * g / math.sqrt(own)
    for t, _ in [*rows, ("", 0), ("new words é", 0)]:
        z = b + sum(w[k] * r.get(k, 0) * v * 100 for k, v in plain_features(m, t).items())
        assert abs(m.score(t) - 1 / (1 + math.exp(-z))) < 1e-3


def plain_counts(model, text):
    x = plain_features(model, text)
    least = min(x.values(), default=1)
    n = len(model.indexes(text))
    return {k: round(v * (n + model.smooth)) for k, v in x.items()} if least else {}


def test_rare_features_have_weights():
    rng = random.Random(4)
    word = lambda chars: "".join(rng.choice(chars) for _ in range(5))
    sides = [[word(c) for _ in range(700)] for c in ("abcdefghi", "nopqrstuv")]
    rows = [(y, " ".join(rng.choices(sides[y], k=60)) + (" zkxwjm" if k < 6 else "")) for y in (0, 1) for k in range(200) if y or k >= 6]
    m = HashedLinear().fit([t for _, t in rows], [y for y, _ in rows])
    assert (m.weights[m.indexes("zkxwjm")] > 0).any()


def test_training_ignores_the_held_out_fold(spark):
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in corpus(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 1000, 0, 5).collect()
    want = {k for k in range(200) if zlib.crc32(str(k).encode()) % 5}
    assert {r.id for r in rows} == want and len(rows) == len(want) and all(r.y == int(r.id % 3 == 0) for r in rows)
    assert labelled_sample(docs, labels, "toxic", 10).count() == 20


def test_fitting_in_a_task_equals_fitting_here(spark):
    rows = [(y, k, k, t) for k, t, y in corpus(120)]
    df = spark.createDataFrame(rows, "y int, rank long, id long, text string").repartition(5)
    far = fit_sample(HashedLinear(), df, calibrate=0.25)
    near = HashedLinear().fit([r[3] for r in rows], [r[0] for r in rows], calibrate=0.25)
    assert np.array_equal(far.weights, near.weights) and (far.bias, far.scale) == (near.bias, near.scale)
    empty = fit_sample(HashedLinear(), df.where("false"))
    assert empty.score("x") == 0.5


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9


def test_filters_keep_columns_and_rows(spark):
    rows = [(k, t, "s", k) for k, t, _ in corpus(100)] + [(None, None, None, None), (1, "", None, 2), (1, "", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, kept long")
    labels = spark.createDataFrame([(k, y) for k, _, y in corpus(100)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.drop_toxic(docs, model)
    assert out.schema == docs.schema
    scores = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    assert out.count() == sum(r.predicted == 0 for r in toxicity.score(docs, model).collect()) and scores
    assert toxicity.drop_toxic(docs.where("false"), model).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    times = collections.Counter(windows)
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 8))
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("seed", range(4))
def test_base_counts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.choice([0, 3, 30, 120])
        t = "".join(rng.choice(["a", "b", "é", "#", "|", "\u00a0", "漢"]) + rng.choice(["", " ", " ", "\n", "\t\n", "\x0b", "  "]) for _ in range(n))
        assert quality.base_counts(t) == brute_counts(t), t
    t = "one two three four five six seven eight nine " * 4 + "\n\nend\nend \nend"
    assert quality.base_counts(t) == brute_counts(t)


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    assert max(map(len, docs.values())) > 20_000
    for i, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(docs[i])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[i].kept for i, y in labels.items() if i in got and y == 1 and not got[i].base_failed]
    bad = [got[i].kept for i, y in labels.items() if i in got and y == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_quality_of_odd_rows(spark):
    good = "a plain sentence of many words that says one thing after another without saying any of them twice or more often than that"
    rows = [(1, good, 1, "s"), (1, good, 1, "s"), (None, None, None, None), (2, "", 2, None), (3, " \n ", 3, "k"), (4, "same words here " * 20_000, 4, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long, probability string").repartition(3)
    model = HashedLinear(bits=10).fit([], [])
    out = quality.judge(docs, model).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in out} == {(1, 23, False, True), (None, 0, True, False), (2, 0, True, False), (3, 0, True, False), (4, 60_000, True, False)}
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [rows[0]] * 2
    empty = docs.where("false")
    assert quality.judge(empty, model).count() == 0 and quality.keep_good(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none).score("x") == 0.5


def test_calibration_is_monotone():
    rows = list(corpus(400, 3))
    m = HashedLinear().fit([t for _, t, _ in rows], [y for *_, y in rows], calibrate=0.25)
    assert m.scale[0] > 0


URLS = [
    (1, "http://a.example.com/en/1"), (2, "https://WWW.Example.COM/en/x?y#z"), (3, "http://example.com/en/"), (4, "http://x.www.example.com/en/9"), (5, "http://spam.net/es/a"), (6, "http://net/fr/"),
    (7, None), (8, ""), (9, "no scheme"), (10, "http://example.com"), (11, "http://notcom/"), (12, "ftp://é.Ünet/fr/"), (13, "http://a.net?x=/fr/"), (14, "http://casino-bets.org/win"), (14, "http://casino-bets.org/win"),
    (15, "x://y://z/fr/"), (None, "http://cheap-pills.example.org/en/1"), (16, "http://garden.example.org/en/1"), (17, "http://example.com\n.net/es/b"),
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p) for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_url_rules_and_model(spark):
    rows = spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, host string")
    got = url_filter.judge(rows, url_filter.train(spark)).collect()
    w = url_filter.plain_train()
    assert len(got) == len(URLS)
    act = {h + p: a for a, h, p in url_filter.RULES}
    want = []
    for i, u in URLS:
        host, path, rule = brute_url(u)
        p = url_filter.plain_probability(host + path, w)
        want.append((i, host, path, rule, act[rule] if rule else "block" if p >= 0.5 else "allow"))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by = {r.page_id: r.verdict for r in got}
    assert by[14] == "block" and by[None] == "block" and by[16] == "allow"
    assert url_filter.judge(rows.where("false"), w).count() == 0


def test_url_weights_equal_plain_python(spark):
    assert np.allclose(url_filter.train(spark), url_filter.plain_train(), atol=1e-9)
    assert url_filter.train(spark, url_filter.labelled(spark).where("false")) == [0.0] * (url_filter.BUCKETS + 1)


def test_url_model_on_held_out_rows():
    rows, right = url_filter.labelled_rows(), []
    for fold in range(5):
        w = url_filter.plain_train([r for k, r in enumerate(rows) if k % 5 != fold])
        right += [(url_filter.plain_probability(t, w) >= 0.5) == y for k, (t, y) in enumerate(rows) if k % 5 == fold]
    assert np.mean(right) > 0.78  # a word's other row may be all that training sees of it


def test_url_table_holds_no_host_of_the_pages(spark):
    hosts = {brute_url(r.url)[0] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()}
    own = {re.sub(r"^(www|m|blog)\.", "", h).split(".")[0] for h in hosts if h}
    names = {re.sub(r"^(www|m|blog)\.", "", t.split("/")[0]).split(".")[0] for t, _ in url_filter.labelled_rows()}
    assert own and not own & names


def test_very_long_url(spark):
    long = "http://a.org/" + "x" * 200_000
    rows = spark.createDataFrame([(1, long), (1, long)], "page_id long, url string")
    (a, b) = url_filter.judge(rows, url_filter.plain_train()).collect()
    assert a == b and len(a.path) == 200_001


def test_url_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.sql(url_filter.oracle_sql()).fetchall(), key=str)
    assert sorted(map(tuple, url_filter.query(spark, sf).collect()), key=str) == want


def test_url_plan_is_native(spark):
    plan = url_filter.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
