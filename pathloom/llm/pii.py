"""Personal data: patterns, then information-theoretic sanitisation of the words of the texts that hold them.

Base spans come from patterns. Every base value is a protected entity, and so is what values share: an address's domain, an IP's
network, a number's first digits; so terms can disclose values that stand in one text only. A term (any word of a text that holds the
entity, without punctuation around it, in lower case) reveals it as far as the corpus says so: the pointwise mutual information of term and
entity over whole documents, as a share of the entity's own information content. Terms of share ``REMOVE`` or more are removed, of
``GENERALISE`` or more replaced by what kind of word they are (see ``ladder``), at every place of every text that holds the entity, if that
they occur together is significant at ``ALPHA``, corrected for all pairs tested, over unlike texts. Copies count once there (see ``SKETCHES``);
one text alone is no evidence.

Three passes: texts with entities are gathered, with their words as 64-bit hashes; then the document frequencies, over all documents, of
those terms alone that could still disclose (a term occurs at least as often as in the texts gathered, which bounds share and significance
from above); then every text is marked. Candidates reach the second pass as a bit filter of fixed size, which lets some
others pass but stops none of them. A text costs its words times its entities that lie in several unlike texts.

Null and empty texts have no spans. Repeated rows are separate rows; they are one text for the test. Words may have any length; very long
texts are scanned whole, and pattern searches take linear time also without white space. An empty table gives an empty result.
What is added to a text depends on the text and the corpus, so it is found by the text's digest: repeated or null ids do no harm. Of base spans that overlap
the first, then the longer is marked. Extra columns, whatever their names, are ignored by ``find`` and kept by ``sanitised``.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, release, reliable_checkpoint, shingles, slices, table
from .neardup import components

KINDS = ("email", "ip", "card", "phone")
#: Level of the test of a term with an entity, over all pairs tested.
ALPHA = 0.05
#: Texts are alike if the smallest hashes of their three-word shingles are equal under one of so many hash functions.
SKETCHES = 4
#: Shares of an entity's information content that a term discloses.
REMOVE, GENERALISE = 0.95, 0.8
#: Bytes of disclosing terms (pairs, or by text) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 4 << 20
#: Bits of the candidates' filter (a power of two); counts that a task holds before it passes them on.
FILTER_BITS, HELD = 1 << 23, 150_000

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_word = re.compile(r"[^\s]+")
_edges = string.punctuation + "¡¿«»„“”‘’–—…"
_salts = np.random.default_rng(10).integers(1, 2**63, SKETCHES, dtype=np.uint64)
_digits = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses, found from their @: what stands before it reaches as far left as it may."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def _octets(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else "0") <= 255 for p in value.split("."))


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all pattern matches, by kind as in KINDS, then by start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _digits.search(text):
        out += [("ip", *m.span()) for m in _ip.finditer(text) if _octets(m[0])]
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _phone.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def term_hash(word: str) -> int:
    """The signed 64-bit hash by which a term is counted and joined."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every word that touches no span: lower case, without punctuation at its ends."""
    bounds, k = sorted((x, y) for _, x, y in spans), 0
    reach = 0
    for m in _word.finditer(text):
        while k < len(bounds) and bounds[k][0] < m.end():
            reach, k = max(reach, bounds[k][1]), k + 1
        if reach > m.start():
            continue
        word = m[0].strip(_edges)
        if word:
            at = m.start() + m[0].index(word)
            yield word.lower(), at, at + len(word)


def entities(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The entities of a text: kind and value in lower case, and what a value shares with others of its kind (domain, network, first digits)."""
    out = set()
    for kind, a, b in spans:
        value = text[a:b].lower()
        out.add(f"{kind}:{value}")
        if kind == "email":
            out.add(f"email:@{value.rpartition('@')[2]}")
        elif kind == "ip":
            out.add(f"ip:{value.rpartition('.')[0]}.*")
        else:
            out.add(f"{kind}:{''.join(c for c in value if c in string.digits)[: 6 if kind == 'card' else 4]}*")
    return out


def sketches(text: str) -> list[int]:
    """The smallest hash of the text's three-word shingles under each of SKETCHES hash functions."""
    h = np.unique(shingles(text.encode(), 3))
    return [int(mix(h ^ s).min().view(np.int64)) for s in _salts] if len(h) else [0] * SKETCHES


def _digest(text: Column) -> Column:
    """The digest by which texts are told apart; a null text is empty."""
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def held_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each distinct text with entities: fp (digest), n (rows with it), entities, terms (hashes), sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            for _, texts in slices(b):
                rows = []
                for text in texts:
                    if spans := base_spans(text):
                        found = sorted({term_hash(t) for t, _, _ in terms(text, spans)})
                        rows.append((hashlib.md5(text.encode()).digest(), sorted(entities(text, spans)), found, sketches(text)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["fp", "entities", "terms", "sketches"])
        release()

    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "fp binary, entities array<string>, terms array<long>, sketches array<long>")
    return reliable_checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("entities", "terms", "sketches")]))


def holders_of(held: DataFrame) -> DataFrame:
    """(fp, entity, n, first) for each text and entity that lies in two unlike texts or more.

    Texts that share a sketch, or are joined by others that do, are alike; ``first`` is 1 in one text of all alike ones that hold the entity.
    """
    slots = held.select("fp", F.posexplode("sketches").alias("k", "sketch"))
    least = slots.groupBy("k", "sketch").agg(F.min("fp").alias("to"))
    alike = components(slots.join(least, ["k", "sketch"]).where("fp <> to").select("fp", "to").distinct(), "fp", "to")
    each = held.select("fp", F.explode("entities").alias("entity"), "n").join(alike.withColumnRenamed("key", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    sources = reliable_checkpoint(each.groupBy("entity", "label").agg(F.min("fp").alias("least")))
    usable = sources.groupBy("entity").agg(F.count("*").alias("unlike")).where("unlike > 1").select("entity")
    rows = each.join(usable, "entity").join(sources, ["entity", "label"])
    return reliable_checkpoint(rows.select("fp", "entity", "n", (F.col("fp") == F.col("least")).cast("int").alias("first")))


def _judged(rows: DataFrame, total: float, tested: int) -> DataFrame:
    """rows(both, k, holders, unlike, df) whose share is GENERALISE or more and significant, with ``share``.

    share = PMI(term, entity) / IC(entity) with document frequencies: 1 if the term never occurs without the entity. The test is the
    upper tail of a Poisson count of the unlike texts with both (bounded by its first term and a geometric series), times the pairs tested.
    Share falls and the tail rises with df, so a row that fails with a df too small fails with the true one.
    """
    info = F.log(F.lit(total) / F.col("holders"))
    pmi = F.log(F.lit(total) * F.col("both") / (F.col("df") * F.col("holders")))
    k, mean = F.col("k").cast("double"), F.col("df") * F.col("unlike") / F.lit(total)
    tail = k * F.log(mean) - (k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k)) - mean - F.log(1 - F.least(mean / (k + 1), F.lit(0.999)))
    sure = (mean < k) & (tail + math.log(tested) <= math.log(ALPHA))
    return rows.where((info > 0) & sure).withColumn("share", pmi / info).where(F.col("share") >= GENERALISE)


def bit_filter(hashes: DataFrame, column: str) -> bytes:
    """FILTER_BITS bits, set where a hash (its lowest bits) stands: at most FILTER_BITS / 64 rows reach the driver, whatever the table's size."""
    slot = F.col(column).bitwiseAND(FILTER_BITS - 1)
    words = hashes.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def document_frequencies(docs: DataFrame, wanted: bytes, text_col: str = "text") -> DataFrame:
    """(term, df): rows of ``docs`` with each word that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, low, counts = shared.value, FILTER_BITS - 1, Counter()
        hashed = xxhash.xxh64_intdigest

        def counted() -> pa.RecordBatch:
            h = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["term", "df"])
            counts.clear()
            return out

        for b in batches:
            for _, texts in slices(b):
                for text in texts:
                    own = {w.strip(_edges).lower() for w in set(text.split())}
                    own.discard("")
                    counts.update([h for h in map(hashed, own) if bits[(h & low) >> 3] >> (h & 7) & 1])
                if len(counts) > HELD:
                    yield counted()
        yield counted()
        release()

    return docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(docs: DataFrame, held: DataFrame, holders: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, share): how much of an entity's information a term in its texts gives away; only significant shares from GENERALISE on."""
    total = float(max(docs.count(), 1))
    pairs = holders.join(held.select("fp", "terms"), "fp").select("entity", F.explode("terms").alias("term"), "n", "first")
    together = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.sum("first").alias("k")).where("k > 1")
    known = holders.groupBy("entity").agg(F.sum("n").alias("holders"), F.sum("first").alias("unlike"))
    tested = holders.join(held.select("fp", F.size("terms").alias("m")), "fp").agg(F.sum("m")).first()[0] or 1
    least = held.select(F.explode("terms").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("df"))
    hopeful = reliable_checkpoint(_judged(together.join(known, "entity").join(least, "term"), total, tested).drop("df", "share"))
    exact = document_frequencies(docs, bit_filter(hopeful.select("term"), "term"), text_col)
    return _judged(hopeful.join(exact, "term"), total, tested).select("entity", "term", "share")


def _small(rows: DataFrame, row_bytes: Column) -> bool:
    """Whether a table's rows, by their sizes, are within BROADCAST_BYTES."""
    return (rows.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES


def told_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """fp, told (hashes of terms) and shares of the texts that hold disclosing terms."""
    held = held_texts(docs, text_col)
    holders = holders_of(held)
    shares = reliable_checkpoint(disclosing(docs, held, holders, text_col))
    each = holders.join(held.select("fp", "terms"), "fp").select("fp", "entity", F.explode("terms").alias("term"))
    known = each.join(F.broadcast(shares) if _small(shares, F.length("entity") + 48) else shares, ["entity", "term"]).groupBy("fp", "term").agg(F.max("share").alias("share"))
    return reliable_checkpoint(known.groupBy("fp").agg(F.collect_list("term").alias("told"), F.collect_list("share").alias("shares")))


def _with_told(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` (whose texts lie in ``text_col``) with told and shares by the digest of the text, null where there are none; the digest is dropped."""
    told = told_texts(rows, text_col)
    own = rows.withColumn("fp", _digest(F.col(text_col)))
    return own.join(F.broadcast(told) if _small(told, F.size("told") * 16 + 64) else told, "fp", "left").drop("fp")


def added(text: str, spans: list[tuple[str, int, int]], told: list[int] | None, shares: list[float] | None) -> list[tuple[int, int, float]]:
    """(start, end, share) of all places of disclosing terms."""
    if not told:
        return []
    of = dict(zip(told, shares, strict=True))
    return [(x, y, of[h]) for t, x, y in terms(text, spans) if (h := term_hash(t)) in of]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans in text form) and added (array of start, end, share of disclosing terms) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p, base, more = b.slice(at, 256), [], []
                for text, told, shares in zip(*(p.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                    spans = base_spans(text or "")
                    base.append(",".join(f"{k}:{x}:{y}" for k, x, y in spans))
                    more.append([{"start": x, "end": y, "share": s} for x, y, s in added(text or "", spans, told, shares)])
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(base, pa.string()), pa.array(more, place)], names=["id", "base", "added"])

    rows = _with_told(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "text", "told", "shares")
    return rows.mapInArrow(run, f"id {kind}, base string, added array<struct<start:int,end:int,share:double>>")


def ladder(word: str, share: float) -> str:
    """What a disclosing word becomes: nothing from REMOVE on; below, its kind: a number, a name (capital first), or a word."""
    if share >= REMOVE:
        return ""
    return "[NUMBER]" if _digits.search(word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitise(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, float]]) -> str:
    """``text`` with a mark of its kind for each base span, and for each disclosing term what its ``ladder`` gives."""
    marks = [(x, y, f"[{k.upper()}]") for k, x, y in spans] + [(x, y, ladder(text[x:y], s)) for x, y, s in terms]
    out, at = [], 0
    for x, y, m in sorted(marks, key=lambda s: (s[0], -s[1])):
        if x < at:  # inside a span before it: what sticks out of that goes too
            at = max(at, y)
            continue
        out += [text[at:x], m]
        at = y
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs``, all columns, with sanitised texts (null stays null); ``chars_col``, if there, gets their length."""
    columns, at = docs.columns, docs.columns.index(text_col)
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    rows = _with_told(own, f"c{at}").select(*own.columns, "told", "shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p, new = b.slice(k, 256), []
                n = p.num_columns
                for text, told, shares in zip(*(p.column(j).to_pylist() for j in (at, n - 2, n - 1)), strict=True):
                    spans = base_spans(text or "")
                    new.append(None if text is None else sanitise(text, spans, added(text, spans, told, shares)))
                sizes = [None if t is None else len(t) for t in new]
                cols = [pa.array(new, p.column(j).type) if j == at else pa.array(sizes, p.column(j).type) if c == chars_col else p.column(j) for j, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return rows.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts and digests of the base spans, and all spans, of every document."""
    rows = find(table(spark, sf_dir, "documents"))
    marks = lambda kind: F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))
    counts = [F.size(marks(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    terms = F.array_join(F.transform("added", lambda a: F.concat_ws(":", F.lit("term"), a["start"].cast("string"), a["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("added") > 0, terms))
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"))
