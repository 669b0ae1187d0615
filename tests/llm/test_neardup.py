"""Near-duplicate classes against brute force, with a large group of edited copies."""

import math
import random

import numpy as np
import pytest
from pathloom.llm import neardup as N

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe".split() for b in "ra se ti vo zu".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, edits):
    words = t.split()
    for _ in range(edits):
        k = rng.randrange(len(words))
        if rng.random() < 0.5:
            words[k] = rng.choice(WORDS)
        else:
            del words[k]
    return " ".join(words)


def plain_idf(texts):
    """The common shingles and their idf, by plain counting: documents with one smallest shingle count once."""
    held = {}
    for t in texts:
        own = set(N.shingles((t or "").encode()).tolist())
        for h in own:
            held.setdefault(h, [0, set()])
            held[h][0] += 1
            held[h][1].add(min(own))
    least = N.COMMON * len(texts)
    common = sorted((h, len(s)) for h, (n, s) in held.items() if len(s) >= least and len(s) > 1)
    idf = [max(N.LEAST_IDF, min(1, math.log(len(texts) / n) / math.log(1 / N.COMMON))) for _, n in common]
    return np.array([h for h, _ in common], np.uint64), np.array(idf)


def brute(rows, threshold=0.8):
    """Smallest id of each row's connected component under weighted Jaccard, and all pairs of that similarity."""
    heavy = plain_idf([t for _, t in rows])
    vectors = [N.weighted((t or "").encode(), *heavy) for _, t in rows]
    parent, pairs = list(range(len(rows))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            alike = (rows[i][1] or "") == (rows[j][1] or "") if not len(vectors[i][0]) or not len(vectors[j][0]) else N.similarity(vectors[i], vectors[j]) >= threshold
            if alike:
                parent[find(i)] = find(j)
                pairs.append((rows[i][0], rows[j][0]))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 60), i)
    return {(i, t or ""): least[find(k)] for k, (i, t) in enumerate(rows)}, pairs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base, other, chain = text(rng, 150), text(rng, 90), [text(rng, 200)]
    out = [edited(rng, base, rng.randint(0, 7)) for _ in range(150)] + [base] * 40 + [edited(rng, other, rng.randint(0, 2)) for _ in range(8)]
    for _ in range(5):
        chain.append(edited(rng, chain[-1], 3))
    out += chain + [text(rng, rng.randint(1, 120)) for _ in range(150)] + ["", "", " \n ", None, "a b", "a b", "A b", text(rng, 20000)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_classes_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, band int").repartition(5)
    got = {(r.doc_id): r.class_id for r in N.near_duplicate_classes(df).collect()}
    classes, pairs = brute(rows)
    want = {i: c for (i, _), c in classes.items()}
    assert got.keys() == want.keys() and (plain_idf([t for _, t in rows])[1] < 0.95).any()
    wrong = [i for i in want if got[i] != want[i]]
    # banding finds a pair at the threshold with probability 0.998
    assert len(wrong) <= 2, wrong
    recall = np.mean([got[a] == got[b] for a, b in pairs])
    assert recall >= 0.99, recall
    together = {c: [i for i in got if got[i] == c] for c in set(got.values())}
    assert all(want[i] == want[c] for c, members in together.items() for i in members)  # no class of unlike texts


def test_one_of_each_keeps_columns(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, of string, `least` int").repartition(5)
    out = N.one_of_each(df)
    assert out.columns == df.columns
    ids = {r.doc_id for r in out.collect()}
    classes = {r.doc_id: r.class_id for r in N.near_duplicate_classes(df).collect()}
    assert ids == set(classes.values()) and out.count() == len(ids)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, t), (None, t), (7, t), (3, "other words than those of the first text here"), (3, "other words than those of the first text here")], "doc_id long, text string")
    got = N.near_duplicate_classes(df)
    assert got.count() == 5 and {r.class_id for r in got.collect()} == {7, 3}
    assert N.one_of_each(df).count() == 2
    assert N.near_duplicate_classes(df.where("false")).count() == 0 and N.one_of_each(df.where("false")).count() == 0


def test_block_links_equal_similarity():
    rng = random.Random(2)
    base = text(rng, 80)
    e, f = np.empty(0, np.uint64), np.empty(0)
    sides = [[(b"%d-%d" % (s, k), b"c%d" % (k % 7 + 10 * s), *N.weighted(edited(rng, base, rng.randint(0, 6)).encode(), e, f)) for k in range(40)] for s in range(2)]
    got = {}
    for a, b in N._block_links(*sides, 0.8):
        got.setdefault(a, set()).add(next(t[1] for t in sides[1] if t[0] == b))
    want = {}
    for q in sides[0]:
        for t in sides[1]:
            if q[1] != t[1] and N.similarity(q[2:], t[2:]) >= 0.8:
                want.setdefault(q[0], set()).add(t[1])
    assert got == want and want


def test_common_shingles_are_counted_exactly(spark):
    rng = random.Random(8)
    passage = text(rng, 8)
    docs = [f"{text(rng, 30)} {passage if k % 20 == 0 else ''}" for k in range(400)]
    df = spark.createDataFrame([(t,) for t in docs], "text string").repartition(7)
    heavy, idf = N.common_shingles(df, 400)
    df_of = {}
    for t in docs:
        for h in set(N.shingles(t.encode()).tolist()):
            df_of[h] = df_of.get(h, 0) + 1
    assert heavy.tolist() == sorted(h for h, n in df_of.items() if n >= N.COMMON * 400 and n > 1)
    plain = plain_idf(docs)
    assert (plain[0] == heavy).all() and np.allclose(plain[1], idf) and (idf < 0.7).all()
    copies = [docs[0]] * 100 + docs  # of documents with one smallest shingle one counts
    assert not N.common_shingles(spark.createDataFrame([(t,) for t in copies[:100]], "text string"), 100)[0].size


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = random.Random(5)
    e, f = np.empty(0, np.uint64), np.empty(0)
    agree, true = [], []
    for _ in range(60):
        a = text(rng, 120)
        va, vb = (N.weighted(t.encode(), e, f) for t in (a, edited(rng, a, 3)))
        agree.append(np.mean(N.samples(*va) == N.samples(*vb)))
        true.append(N.similarity(va, vb))
    assert abs(np.mean(agree) - np.mean(true)) < 0.03


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.key: r.label for r in N.components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
    assert N.components(edges.where("false")).count() == 0


def test_unlike_classes_of_one_id_stay_apart(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue black white grey pink")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, a + " theta"), (2, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in N.one_of_each(df).collect()]
    classes = {r.label: r.class_id for r in N.near_duplicate_classes(df).collect()}
    assert len(got) == len(classes) and {t for _, t in got} >= {b, c} and (1, c) in got and (None, b) in got
