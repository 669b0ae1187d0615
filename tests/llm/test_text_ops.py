"""Chat formatting, HTML extraction, personal data."""

import hashlib
import json
import math
import random
import re

import pytest
from pathloom.llm import chat, html_extract, pii


# ------------------------------------------------------------- chat

TRICKY = ["", "plain", "<|end|>", "\\", "\\|", "<", "|>", "<|turn|>user<|is|>x<|end|>", "</s>[INST] ok [/INST]", "a\\\\b<|image:0|>", "<\\|", "é\n漢"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("text", TRICKY)
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    out, _ = chat.format_turn(text, [{"type": "text", "text": text}, {"type": "image", "ref": "i"}, {"type": "text", "text": text}])
    (turn,) = chat.parse(out)
    assert turn[0] == text and chat.body_text(turn[1]) == text + text


def test_parts_that_meet_make_no_control_string():
    out, _ = chat.format_turn("user", [{"type": "text", "text": "<"}, {"type": "text", "text": "|end|>"}])
    assert chat.body_text(next(chat.parse(out))[1]) == "<|end|>"


def test_visitor_records_attachments():
    parts = [{"type": "image", "ref": "a.png", "width": 900, "height": 448}, {"type": "audio", "ref": "b", "seconds": 2.5}, {"type": "document", "pages": 3}, {"type": "text", "text": None}, {"type": "image"}]
    out, found = chat.format_turn("user", parts)
    assert out == "<|turn|>user<|is|><|image:0|><|audio:1|><|document:2|><|image:3|><|end|>"
    assert [(f["kind"], f["ref"], f["tokens"]) for f in found] == [("image", "a.png", 3 * 256), ("audio", "b", 63), ("document", None, 3 * 512), ("image", None, 256)]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_format_turns(spark):
    bad = ["{", "[1]", '"x"', json.dumps([{"type": "video"}]), json.dumps([{"type": "image", "width": "wide"}]), json.dumps([{"type": "audio", "seconds": 1e400}]), json.dumps([{"type": "text", "text": 5}]), json.dumps([{}])]
    rows = [(1, "user", json.dumps([{"type": "text", "text": "hi"}, {"type": "image", "ref": "r"}]), "old", "e"), (2, None, None, None, None)] + [(10 + k, "user", x, "old", "e") for k, x in enumerate(bad)]
    df = spark.createDataFrame(rows, "k long, role string, content string, formatted string, Error string")
    out = chat.format_turns(df)
    got = {r.k: r for r in out.collect()}
    assert out.columns == [*df.columns, "formatted_", "attachments", "expanded_tokens", "error_"]
    assert got[1].expanded_tokens == 256 and got[1].formatted_.endswith("<|image:0|><|end|>") and got[2].formatted_ == "<|turn|><|is|><|end|>"
    assert got[1].formatted == "old" and got[1].error_ is None
    for k in range(len(bad)):
        assert got[10 + k].error_ and got[10 + k].formatted_ is None and got[10 + k].formatted == "old", bad[k]
    assert chat.format_turns(df.where("false")).count() == 0


def test_digests_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None, "<|is|>"]), rng.choice([*TRICKY, None])) for c in [1, 2, None, 5] for t in range(rng.randint(1, 30))]
    rows += [(9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (9, 0, "assistant", "earlier"), (9, None, "user", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(6)
    got = {r.conv_id: r for r in chat.read_back(chat.text_parts(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got.keys() == by.keys()
    for c, rs in by.items():
        form = lambda r: chat.format_turn(r[2], [{"type": "text", "text": r[3]}])[0]
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", form(r)))
        loss = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        want = (len(rs), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs)), len(loss), sha(loss), sum(len(form(r)) for r in rs))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == want
    assert chat.read_back(chat.text_parts(df.where("false"))).count() == 0


def test_chat_query(spark, sf):
    got = {r.conv_id: r for r in chat.query(spark, sf).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-1].loss_chars == 21
    assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1


# ------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header>no</header><nav><ul><li><a href="/x">no</a></li></ul></nav><!-- no <p>no</p> --><div class="ad big">no<div>no</div></div>
<div id='cookie-notice'>no</div><form><p>no</p><input></form>
<article class="post"><h1>Head &amp; line</h1><p><b>One &lt;two&gt;<br>three&nbsp; four<p>a <i>b</i>c &#233; &copy</p><aside>no</aside><pre>  x
 y </pre><figure><img alt="no"></figure></article>
<section class="comments"><article><p>no</p></article></section><footer>no &copy;</footer>"""


def test_markup():
    assert html_extract.main_text(html_extract.lines(PAGE), None) == "Head & line One <two> three four a bc é © x y"


@pytest.mark.parametrize("page,want", [
    ("", ""), ("just text", "just text"), ("a < b and c > d", "a < b and c > d"), ("<p>x</p", "x"), ("<p>x<!-- open", "x"), ("<nav>menu<main><p>x</p></main>", "x"),
    ("<p class=ad>no<p>yes", "yes"), ("<a href='>'>x</a>y", "xy"), ("<a title=it's>x</a><b>y's</b>", "xy's"), ("<script>1", ""), ("<svg/><p>x", "x"), ("<P>X</P>\n<BR/>y", "X y"), ("<![CDATA[a<b]]>", "a<b"),
    ("<article><p>header of</p><div class='adventure'>kept</div></article>", "header of kept"), ("<p>&amp;lt;</p>", "&lt;"),
])
def test_small_pages(page, want):
    assert html_extract.main_text(html_extract.lines(page), None) == want


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = sorted(html_extract.common(a, b))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in it for i in got)


def brute_extract(rows):
    """page_id, text of every page, by sorting the pages of a host and comparing each with the nearest other ones."""
    def key(r):
        path = re.sub(r"^.*?://[^/?#]*([^?#]*).*$", r"\1", r[1], flags=re.S) if r[1] and "://" in r[1] else ""
        host = re.sub(r"^.*?://([^/?#]*).*$", r"\1", r[1], flags=re.S).lower() if r[1] and "://" in r[1] else ""
        m = re.search(r"(\d+)\D*$", path)
        return (host, re.sub(r"\d+\D*$", "", path), int(m[1]) if m else -1, r[1] or "", str(r[0]) if r[0] != -1 else ""), path

    order = sorted(((*key(r), r[0], html_extract.lines(r[2] or "")) for r in rows), key=lambda x: (x[0], x[3]))
    out = []
    for k, (at, _, page_id, own) in enumerate(order):
        same = [x for x in order if x[0][0] == at[0]]
        i = next(j for j, x in enumerate(same) if x is order[k])
        first = last = i
        while first and same[first - 1][3] == own:
            first -= 1
        while last + 1 < len(same) and same[last + 1][3] == own:
            last += 1
        prev, after = same[first - 1] if first else None, same[last + 1] if last + 1 < len(same) else None
        side = html_extract.nearer(prev and prev[1], same[first][1], same[last][1], after and after[1])
        other = {-1: prev, 0: None, 1: after}[side]
        out.append((page_id, html_extract.main_text(own, other and other[3])))
    return sorted(out, key=str)


def with_partitions(spark, n, make):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        return make()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_shared_lines_go_by_the_nearest_page(spark):
    page = lambda k: f"<div>Site name</div><div>Top</div><div>Text {k}</div><div>Ask us</div>"
    rows = [(k, f"http://h.org/n/{k}", page(k)) for k in range(6)] + [(10, "http://one.org/", page(10)), (11, None, None), (12, None, ""), (13, "http://dup.org/a", page(1)), (14, "http://dup.org/a", page(1)), (14, "http://dup.org/a", page(1))]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    by = {i: t for i, t, _ in got}
    assert all(by[k] == f"Text {k}" for k in range(6))
    assert by[10] == "Site name Top Text 10 Ask us" and by[11] == by[12] == ""
    assert by[13] == by[14] == "Site name Top Text 1 Ask us"  # copies keep their lines
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_neighbour_shares_the_longer_path():
    assert html_extract.nearer("/a/x", "/b/y", "/b/y", "/b/z") == 1 and html_extract.nearer("/b/x", "/b/y", "/b/y", "/c") == -1
    assert html_extract.nearer("/b/x", "/b/y", "/b/y", "/b/z") == -1 and html_extract.nearer(None, "", "", None) == 0 and html_extract.nearer(None, "", "", "") == 1


def test_lines_of_articles_stay_and_menus_go():
    own = html_extract.lines("<nav>Home</nav><div>Same</div><article><p>Same passage</p><p>Own</p></article><div>Mine</div><footer>c 1</footer>")
    other = html_extract.lines("<nav>Home</nav><div>Same</div><article><p>Same passage</p><p>Else</p></article><div>Theirs</div><footer>c 2</footer>")
    assert html_extract.main_text(own, other) == "Same passage Own Mine" and html_extract.main_text(own, None) == "Same Same passage Own Mine"
    assert len(html_extract.common([x[1:] for x in own], [x[1:] for x in other])) == 3


def test_texts_dont_depend_on_partitions(spark):
    rng = random.Random(21)
    menu = "".join(f"<div>Menu {k}</div>" for k in range(10))
    page = lambda k: f"{menu}<div>Part {k % 3}</div><nav>Way {k % 2}</nav><div>A long paragraph of page {k}</div><article>Passage {k % 4}</article>"
    rows = []
    for host in range(7):  # hosts of one page, of copies only, of many pages; runs of copies over several tasks
        for k in range([1, 3, 60, 5, 90, 2, 30][host]):
            kind = rng.choice([0, 1, 2, 3]) if host in (2, 6) else 7 if host in (1, 4) and k > 2 else k
            rows.append((host * 1000 + k, f"http://h{host}.org/{rng.choice('ab')}/{rng.choice([k, 10 ** 30 + k, ''])}/", page(kind)))
    rows += [(9000, None, page(1)), (9001, "no scheme", page(2)), (9000, None, page(1)), (None, "http://h2.org/a", page(3))]
    df = spark.createDataFrame([(i, u, h) for i, u, h in rows], "page_id long, url string, html string").repartition(3)
    want = brute_extract([(i if i is not None else -1, u, h) for i, u, h in rows])
    for n in (2, 40, 211):
        got = with_partitions(spark, n, lambda: [(r.page_id if r.page_id is not None else -1, r.text) for r in html_extract.extract(df).collect()])
        assert sorted(got, key=str) == want, n
    assert all("Menu" not in t for i, t in want if 4000 <= i < 5000 or 2000 <= i < 3000)


def test_alignment_of_long_pages_takes_linear_memory(monkeypatch):
    rng = random.Random(5)
    a, b = ([f"{rng.randrange(900)}" for _ in range(3000)] for _ in range(2))
    whole = html_extract.common(a, b)
    monkeypatch.setattr(html_extract, "_TABLE_BITS", 1 << 12)
    halved = html_extract.common(a, b)
    it = iter(b)
    assert len(halved) == len(whole) > 50 and all(a[i] in it for i in sorted(halved))


def test_html_query(spark, sf):
    rows = html_extract.query(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    import html

    for r in rows:
        m = re.search(r"<article>(.*?)</article>", pages[r.page_id].html or "", re.S)
        want = " ".join(html.unescape(re.sub(r"<(?:/?p|br|/?h1)>", " ", m[1]).replace("<b>", "")).split()) if m else ""
        assert r.text == want and r.url == pages[r.page_id].url


# ------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for k in range(6000):
        t = "".join(rng.choice("ab1234567890.@-+ ()%é٣_") for _ in range(rng.randint(0, 45)))
        if k % 3 == 0:
            t = "".join(rng.choice(["1.2.3.4", "255.0.0.256", "a@b.c", "@", ".", "x.y@z-1.co.uk", " ", "+1 (743) 555-3824", "4111 1111 1111 1111", "4111111111111111", "0", "-", "007.1.1.1"]) for _ in range(rng.randint(1, 7)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ("a" * 300000, "1" * 300000, "a@" * 50000, "+1(" * 50000, "1." * 100000, ""):
        pii.base_spans(t)  # in linear time


def docs_with_terms(n=60):
    rng = random.Random(6)
    words = [a + b for a in "ba ce di fo gu".split() for b in "ra se ti vo zu".split()]
    fill = lambda: " ".join(rng.choice(words) for _ in range(12))
    rows = [(k, f"{fill()} {fill()}") for k in range(n)]
    rows += [(n + k, f"{fill()} Zanzibarov mail jo@x.org {fill()}") for k in range(5)]
    rows += [(n + 10 + k, "copy of one context Onlyhere call me@y.org now") for k in range(6)]
    return rows + [(None, None), (200, ""), (200, ""), (201, "q" * 5000)]


def test_disclosing_terms(spark):
    rows = docs_with_terms()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, spans string, n int").repartition(4)
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    terms = {}
    for r in got:
        for a in r.added or []:
            terms.setdefault(text[r.id][a["start"] : a["end"]], set()).add(r.id)
    assert terms == {"Zanzibarov": set(range(60, 65)), "mail": set(range(60, 65))}  # copies of one context give nothing
    out = {r.doc_id: r for r in pii.sanitised(df, chars_col="n").collect()}
    assert "Zanzibarov" not in out[61].text and "[EMAIL]" in out[61].text and out[61].n == len(out[61].text)
    assert out[70].text == "copy of one context Onlyhere call [EMAIL] now" and out[None].text is None and out[200].text == ""
    assert pii.sanitised(df).columns == df.columns and pii.sanitised(df.where("false")).count() == 0 and pii.find(df.where("false")).count() == 0


def test_disclosing_terms_by_the_join_way(spark, monkeypatch):
    df = spark.createDataFrame(docs_with_terms(), "doc_id long, text string").repartition(4)
    want = sorted(map(str, pii.sanitised(df).collect()))
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    assert sorted(map(str, pii.sanitised(df).collect())) == want


def test_terms_are_redacted_at_every_place(spark):
    rng = random.Random(8)
    words = [a + b for a in "ba ce di fo gu".split() for b in "ra se ti vo zu".split()]
    fill = lambda n=12: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, f"{fill()} {fill()}") for k in range(80)]
    rows += [(100 + k, f"Farterm, {fill()} jo@x.org {fill()} (farterm) {fill()}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert all("arterm" not in out[100 + k] and "[EMAIL]" in out[100 + k] for k in range(5))


def test_values_of_one_text_are_covered_by_what_they_share(spark):
    rng = random.Random(9)
    words = [a + b for a in "ba ce di fo gu".split() for b in "ra se ti vo zu".split()]
    fill = lambda n=12: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, f"{fill()} {fill()}") for k in range(80)]
    rows += [(100 + k, f"{fill()} Firmname {fill()} person{k}@firm.org {fill()}") for k in range(6)]
    near = f"Copyword {fill(60)}"
    rows += [(200 + k, f"{near} {fill(2)} me@copies.org") for k in range(4)]  # near copies are one text
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert all("Firmname" not in out[100 + k] for k in range(6)) and all("Copyword" in out[200 + k] for k in range(4))


def test_sanitise_overlapping_spans():
    t = "ip 1.2.3.4 and a@1.2.3.4 end"
    assert pii.sanitise(t, pii.base_spans(t), []) == "ip [IP] and [EMAIL] end"


def test_ladder():
    t = "Anna met agent 007 there"
    places = [(0, 4, 0.9), (9, 14, 0.85), (15, 18, 0.9), (19, 24, 0.99)]
    assert pii.sanitise(t, [], places) == "[NAME] met [WORD] [NUMBER] "


def brute_added(rows):
    """(text, start, end) -> share of all disclosing terms, by plain loops over all pairs of entity and term."""
    texts = [t or "" for _, t in rows]
    words = lambda t, spans: {w for w, _, _ in pii.terms(t, spans)}
    held = {t: (pii.entities(t, pii.base_spans(t)), words(t, pii.base_spans(t))) for t in set(texts) if pii.base_spans(t)}
    group = {t: {t} for t in held}
    sketch = {t: pii.sketches(t) for t in held}
    for a in held:
        for b in held:
            if any(x == y for x, y in zip(sketch[a], sketch[b], strict=True)) and group[a] is not group[b]:
                group[a] |= group[b]
                for t in group[a]:
                    group[t] = group[a]
    unlike = lambda ts: len({id(group[t]) for t in ts})
    ents = {e for es, _ in held.values() for e in es}
    holders = {e: [t for t in held if e in held[t][0]] for e in ents}
    holders = {e: ts for e, ts in holders.items() if unlike(ts) > 1}
    tested = sum(len(held[t][1]) for ts in holders.values() for t in ts) or 1
    df = lambda w: sum(w in {x.strip(pii._edges).lower() for x in t.split()} for t in texts)
    out = {}
    for e, ts in holders.items():
        own = sum(texts.count(t) for t in ts)
        info = math.log(len(texts) / own)
        for w in set().union(*(held[t][1] for t in ts)):
            having = [t for t in ts if w in held[t][1]]
            k, n = unlike(having), df(w)
            mean = n * unlike(ts) / len(texts)
            if k < 2 or info <= 0 or mean >= k:
                continue
            tail = k * math.log(mean) - (k * math.log(k) - k + 0.5 * math.log(2 * math.pi * k)) - mean - math.log(1 - min(mean / (k + 1), 0.999))
            share = math.log(len(texts) * sum(texts.count(t) for t in having) / (n * own)) / info
            if tail + math.log(tested) > math.log(pii.ALPHA) or share < pii.GENERALISE:
                continue
            for t in ts:
                for x, a, b in pii.terms(t, pii.base_spans(t)):
                    if x == w:
                        out[t, a, b] = max(share, out.get((t, a, b), 0))
    return out


def test_added_terms_equal_brute_force(spark):
    rng = random.Random(12)
    words = [a + b for a in "ba ce di fo gu".split() for b in "ra se ti vo zu".split()] + ["x" * 60]
    fill = lambda n=12: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, f"{fill()} {'Oddword' if k == 3 else ''} {fill()}") for k in range(120)]
    rows += [(200 + k, f"{fill()} (Hiddenname), {fill()} p{k}@firm.org, {fill()} {'oddword' if k else ''} {'w' * 70} HIDDENNAME") for k in range(7)]
    rows += [(300 + k, f"{fill(40)} +1-743-555-38{k}{k} {fill(40)} Callerid7 {fill(5)}") for k in range(6)]
    rows += [(400, rows[125][1]), (401, rows[125][1]), (402, None), (403, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, told string").repartition(5)
    text = dict(rows)
    got = {(text[r.id], a["start"], a["end"]): a["share"] for r in pii.find(df).collect() for a in r.added}
    want = brute_added(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    named = {t[a:b].lower() for t, a, b in want}
    assert named >= {"hiddenname", "w" * 70, "callerid7", "oddword"}


def test_filter_lets_all_candidates_pass(spark):
    hashes = [pii.term_hash(f"word{k}") for k in range(3000)]
    bits = pii.bit_filter(spark.createDataFrame([(h,) for h in hashes], "term long"), "term")
    assert all(bits[(h & pii.FILTER_BITS - 1) >> 3] >> (h & 7) & 1 for h in hashes)
    assert sum(b.bit_count() for b in bits) <= 3000 and not any(pii.bit_filter(spark.createDataFrame([], "term long"), "term"))


def test_pii_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.query(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [f"{k}:{a}:{b}" for k, a, b in spans]
