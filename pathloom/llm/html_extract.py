"""HTML extraction by nearest-URL page differencing.

Pages are cut into text lines at block tags, each with what the markup says of it: ``SURE`` (it lies in an article or main element), ``OFF`` (it
lies in a menu, header, footer, sidebar, notice, advert, form or reader comments) or ``FREE``. Scripts, styles and other raw elements have no lines.

Pages are sorted by host and URL path. A page's neighbour is the nearest page of its host with other lines, before or after it: of the two the one that
shares the longer start of its path, the earlier if equal. So copies are passed over, however many. All lines of a page, whatever their marks, are aligned
with all lines of the neighbour by longest common subsequence; shared lines are deleted, but for those of articles, since articles share passages.
Of the lines that the alignment leaves, those that the markup calls OFF are deleted: menus and adverts that differ from page to page.

Lines, not pages, are shuffled, compressed, once. A host of any size is spread over ranges of the order, whose borders come from a sample of the URLs; each range hands
over the first and last two runs of equal pages of its first and last host, and the pages there are settled from those, so that the borders change no text. Who is whose
neighbour there is settled from paths and digests alone (four for each range), the lines meet by joins.

Null and empty pages have empty text. Very long pages are read whole; the alignment's memory is linear in the lines. Pages of a host that are all equal have no
neighbour: they keep what isn't OFF. Ties in the order of URLs go by page id as text, then by digest. Repeated rows stay; a null url is its own host. An empty table gives an
empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: What the markup says of a line.
FREE, SURE, OFF = "0", "1", "2"
#: Elements whose content isn't main text; elements whose text is kept; elements that cut lines (fixed values of the format).
DROPPED = frozenset("nav header footer aside form script style noscript template svg math iframe object select button menu dialog head title textarea canvas audio video".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of class, id and role that mark what isn't main text.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|popup|modal|overlay|menu|navbar|nav|navigation|breadcrumbs?|sidebar|widget|footer|masthead|comments?|replies|disqus|newsletter|subscribe|share|sharing|social|related|login|signup|complementary|contentinfo)(?:$|[\s_-])", re.I)

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_attr = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_white = re.compile(r"\s+")


def lines(page: str) -> list[str]:
    """The text lines of a page, each after its mark."""
    out: list[str] = []
    held: list[str] = []
    drop: list[str] = []  # open elements inside the outermost dropped one, that one first
    at = 0
    open_main: list[str] = []

    def cut() -> None:
        if held:
            text = _white.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((OFF if drop else SURE if open_main else FREE) + text)
            held.clear()

    find = _token.search
    while (m := find(page, at)) is not None:
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if name in BLOCK or name in drop:
                cut()
            if drop:
                if name in drop:
                    while drop.pop() != name:
                        pass
                elif name in ("body", "html"):
                    drop.clear()
            elif name in open_main:
                while open_main.pop() != name:
                    pass
            continue
        attrs = m[3] or ""
        alone = name in VOID or attrs.endswith("/") and name not in BLOCK
        if name in RAW and not alone:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            cut()
        if drop:
            if name == "main" or drop[0] in ("p", "li") and name in BLOCK and (name == drop[0] or drop[0] == "p"):
                cut()
                drop.clear()  # an element that was never closed
            else:
                if not alone and name in (drop[0], "div", "section", "article", "ul", "ol", "table"):
                    drop.append(name)
                continue
        marked = "class" in attrs.lower() or "id" in attrs.lower() or "role" in attrs.lower()
        if not alone and name not in ("html", "body") and (name in DROPPED or marked and any(MARKS.search("".join(g)) for g in _attr.findall(attrs))):
            cut()
            drop.append(name)
            continue
        if name in MAIN:
            open_main.append(name)
    held.append(page[at:])
    cut()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``. Equal ends and lines of one side alone are taken off first."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    out = {*range(lo), *range(ha, len(a))}
    shared = set(a[lo:ha]) & set(b[lo:hb])
    x, y = [i for i in range(lo, ha) if a[i] in shared], [b[j] for j in range(lo, hb) if b[j] in shared]
    _align([a[i] for i in x], y, x, out)
    return out


#: Bits of an alignment's table up to which it is kept whole; larger ones are halved, so that memory is linear.
_TABLE_BITS = 1 << 22


def _table(x: list[str], y: list[str]) -> Iterator[int]:
    """For each start of x a number whose bit j is 0 where the subsequence with y gets longer by y[j] (all places of a row at once, in one number)."""
    where: dict[str, int] = {}
    for j, t in enumerate(y):
        where[t] = where.get(t, 0) | 1 << j
    full = v = (1 << len(y)) - 1
    for t in x:
        u = v & where.get(t, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(x: list[str], y: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of x with every start of y."""
    v = (1 << len(y)) - 1
    for v in _table(x, y):  # noqa: B007
        pass
    out = [0]
    for bit in reversed(f"{v:0{len(y)}b}" if y else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def _align(x: list[str], y: list[str], places: list[int], out: set[int]) -> None:
    """Add the places of a longest common subsequence of x with y."""
    if not x or not y:
        return
    if len(x) > 1 and len(x) * len(y) > _TABLE_BITS:
        half = len(x) // 2
        left, right = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
        k = max(range(len(y) + 1), key=lambda k: left[k] + right[len(y) - k])
        _align(x[:half], y[:k], places[:half], out)
        _align(x[half:], y[k:], places[half:], out)
        return
    rows = list(_table(x, y))
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            out.add(places[i])
            j -= 1


def main_text(own: list[str], other: list[str] | None) -> str:
    """The lines of a page without those that it shares with its neighbour, and of the others without those that are OFF."""
    gone = common([x[1:] for x in own], [x[1:] for x in other]) if other else set()
    return " ".join(x[1:] for k, x in enumerate(own) if x[0] == SURE or x[0] == FREE and k not in gone)


# ------------------------------------------------------------- pages in the order of their paths


def _packed(own: list[str]) -> bytes:
    return zstandard.ZstdCompressor().compress("\n".join(own).encode())


def _unpacked(data: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    return text.split("\n") if text else []


def shared_start(a: str, b: str) -> int:
    """Characters that two paths have in common from the start."""
    return len(os.path.commonprefix((a, b)))


def nearer(path_before: str | None, first: str, last: str, path_after: str | None) -> int:
    """-1 if the page before a run of pages (by the paths of its first and last) is the neighbour, 1 if that after it is, 0 if there is none."""
    if path_before is None or path_after is None:
        return 1 if path_after is not None else -1 if path_before is not None else 0
    return 1 if shared_start(last, path_after) > shared_start(first, path_before) else -1


class _Run:
    """Pages of one host with equal lines, one after another: their lines, the paths of the first and the last, and what waits for a text."""

    def __init__(self, sig: bytes, packed: bytes, path: str):
        self.sig, self.packed, self.first, self.last, self.pages = sig, packed, path, path, []

    def text(self, other: _Run | None) -> str:
        return main_text(_unpacked(self.packed), None if other is None else _unpacked(other.packed))


_EXTRACTED = "sort string, page_id {kind}, url string, text string, host string, part int, idx int, sig binary, first string, last string, packed binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three sorts from pages in order: ``done`` (a page and its text), ``open`` (a page of a run that may go on in another range, or whose
    neighbour may lie there) and ``end`` (a run at a border: the first and last two of the range's first and last host)."""
    part = host = None
    lead = True  # the host is the first of its range
    at = 0  # the current run's place in its host
    head: list[tuple[int, _Run]] = []
    before = now = None
    rows: list[tuple] = []

    def done(run: _Run, text: str) -> None:
        rows.extend(("done", i, u, text, *[None] * 7) for i, u in run.pages)
        run.pages.clear()

    def settle(run: _Run, prev: _Run | None, after: _Run | None) -> None:
        side = nearer(prev and prev.last, run.first, run.last, after and after.first)
        done(run, run.text(None if not side else prev if side < 0 else after))

    def is_open(run: _Run, idx: int) -> None:
        rows.extend(("open", i, u, None, host, part, idx, *[None] * 4) for i, u in run.pages)
        run.pages.clear()

    def close(last: bool) -> None:
        """The host's last run; what stands at a border is handed over."""
        if last or lead and at == 0:
            is_open(now, at)
        else:
            settle(now, before, None)
        if last or lead:
            ends = dict(head) | ({at - 1: before} if before else {}) | {at: now}
            rows.extend(("end", None, None, None, host, part, k, r.sig, r.first, r.last, r.packed) for k, r in sorted(ends.items()))

    b = None
    for b in batches:
        for page_id, url, own_part, own_host, path, sig, packed in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
            if own_part != part or own_host != host:
                if now is not None:
                    close(own_part != part)
                    lead = own_part != part
                part, host, before, at, now = own_part, own_host, None, 0, _Run(sig, packed, path)
                head = [(0, now)]
            elif sig != now.sig:
                new = _Run(sig, packed, path)
                if at == 0 and lead:
                    is_open(now, 0)
                else:
                    settle(now, before, new)
                before, now, at = now, new, at + 1
                if at == 1:
                    head.append((1, now))
            now.last = path
            now.pages.append((page_id, url))
        if rows:
            yield _rows(b, rows)
            rows.clear()
    if now is not None:
        close(True)
        yield _rows(b, rows)


def _rows(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    s, n, d = pa.string(), pa.int32(), pa.binary()
    kinds = [s, b.schema.field(0).type, s, s, s, n, n, d, s, s, d]
    names = ["sort", "page_id", "url", "text", "host", "part", "idx", "sig", "first", "last", "packed"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _neighbours(ends: pa.Table) -> pa.Table:
    """(host, part, idx, npart, nidx) of a host's border runs that are open, and where their neighbours' lines lie (null: nowhere). Paths and digests alone are read.

    Runs of equal pages that meet at a border between tasks are one run.
    """
    rows = sorted(ends.to_pylist(), key=lambda r: (r["part"], r["idx"]))
    runs: list[list[dict]] = []
    for k, r in enumerate(rows):
        if k and rows[k - 1]["part"] != r["part"] and rows[k - 1]["sig"] == r["sig"]:
            runs[-1].append(r)
        else:
            runs.append([r])
    last = {r["part"]: r["idx"] for r in rows}
    out = []
    for k, run in enumerate(runs):
        prev, after = runs[k - 1][-1] if k else None, runs[k + 1][0] if k + 1 < len(runs) else None
        side = nearer(prev and prev["last"], run[0]["first"], run[-1]["last"], after and after["first"])
        other = {-1: prev, 0: None, 1: after}[side]
        out += [(r["host"], r["part"], r["idx"], other and other["part"], other and other["idx"]) for r in run if r["idx"] in (0, last[r["part"]])]
    kinds = [pa.string()] + [pa.int32()] * 4
    return pa.Table.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(5)], names=["host", "part", "idx", "npart", "nidx"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            own, other = b.column(3)[k].as_py(), b.column(4)[k].as_py()
            text = main_text(_unpacked(own), None if other is None else _unpacked(other))
            yield pa.RecordBatch.from_arrays([*(b.column(j).slice(k, 1) for j in range(3)), pa.array([text])], names=["host", "part", "idx", "text"])


#: Sampled URLs for each range, at most, and in all.
_SAMPLED, _SAMPLE = 40, 200_000
_KEYS = ("host", "folder", "item", "at", "id")


def _borders(keys: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut the table into so many ranges of about equal size: quantiles of a sample, drawn by hash, of bounded size."""
    each = max(4, min(_SAMPLED, _SAMPLE // ranges))
    every = max(1, keys.count() // (each * ranges))
    drawn = sorted(map(tuple, keys.where(F.pmod(F.xxhash64(*_KEYS), F.lit(every)) == 0).collect()))
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark, url, kind = pages.sparkSession, F.col(url_col), dict(pages.dtypes)[id_col]
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    digits = F.regexp_extract(F.regexp_extract(path, r"(\d+)\D*$", 1), r"^0*(.*)$", 1)
    item = F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)  # numbers of any length in their order
    blank = lambda c: F.coalesce(c, F.lit(""))
    keys = [blank(host).alias("host"), blank(F.regexp_replace(path, r"\d+\D*$", "")).alias("folder"), blank(item).alias("item"), blank(url).alias("at"), blank(F.col(id_col).cast("string")).alias("id")]
    borders = spark.sparkContext.broadcast(_borders(pages.select(*keys), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", *_KEYS, "path", "part", "sig", "packed"]
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                own = [lines(t or "") for t in p.column(8).to_pylist()]
                parts = [bisect.bisect_right(borders.value, x) for x in zip(*(p.column(j).to_pylist() for j in range(2, 7)), strict=True)]
                sigs = [hashlib.md5("\n".join(x).encode()).digest() for x in own]
                yield pa.RecordBatch.from_arrays([*p.columns[:8], pa.array(parts, pa.int32()), pa.array(sigs, pa.binary()), pa.array([_packed(x) for x in own], pa.binary())], names=names)

    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), *keys, blank(path).alias("path"), F.col(html_col).alias("html"))
    schema = f"page_id {kind}, url string, {', '.join(f'{k} string' for k in _KEYS)}, path string, part int, sig binary, packed binary"
    dealt = rows.mapInArrow(cut, schema).repartitionById(len(borders.value) + 1, "part").sortWithinPartitions("part", *_KEYS, "sig")
    found, _ = written(dealt.select("page_id", "url", "part", "host", "path", "sig", "packed").mapInArrow(_extract, _EXTRACTED.format(kind=kind)))
    ends = found.where("sort = 'end'")
    near = ends.select("host", "part", "idx", "sig", "first", "last").groupBy("host").applyInArrow(_neighbours, "host string, part int, idx int, npart int, nidx int")
    other = ends.select("host", F.col("part").alias("npart"), F.col("idx").alias("nidx"), F.col("packed").alias("other"))
    pairs = near.join(ends.select("host", "part", "idx", "packed"), ["host", "part", "idx"]).join(other, ["host", "npart", "nidx"], "left")
    settled = pairs.select("host", "part", "idx", "packed", "other").mapInArrow(_texts, "host string, part int, idx int, text string")
    late = found.where("sort = 'open'").select("page_id", "url", "host", "part", "idx").join(settled, ["host", "part", "idx"])
    every = found.where("sort = 'done'").select("page_id", "url", "text").union(late.select("page_id", "url", "text"))
    return every.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
