"""Packing and byte-pair encoding against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pathloom.llm import bpe, packing
from tokenizers import Tokenizer

ALPHABET = "aAbcdEhinorst  \n\t.,'ZÉß²½Ⅷ٣漢字🙂\u0301\u00a0\u2003\x1c\x85_-0123!!~\u200b<|>ÀÿŸŽžſİı×÷Ⱥ"


def texts(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        if k % 20 == 0:
            t += rng.choice(["<|endoftext|>", " <|startoftext|> x", "İΣΑΣ ΣΑΣ", "é \u0301", "<|ENDOFTEXT|>"]) + t
        if k % 7 == 0:
            t = "".join(rng.choice("thereinationsandlyed") for _ in range(rng.randint(5, 300)))
        if k % 11 == 0:
            t = "".join(rng.choice(["'S", "'re", "it's", "I'LL", "é's", "''", "'", "1s't"]) for _ in range(8))
        yield t


def test_ids_equal_the_library():
    byte, word = bpe.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("word_bpe_49k.json")
    own, lib = bpe.PrefixEncoder(byte), Tokenizer.from_file(byte)
    own2, lib2 = packing.encoder(word), Tokenizer.from_file(word)
    for t in [*texts(1, 3000), "", " ", "a" * 5000, "thou " * 3000, "x" * 300 + "é"]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), t
        assert own2(t).tolist() == lib2.encode(t, add_special_tokens=False).ids, t


def test_long_piece_without_breaks():
    own = bpe.PrefixEncoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    t = "thereisno" * 20000
    assert own.decode(own.encode(t)) == t


def test_bpe_query(spark, sf):
    lib = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe.query(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def check_pieces(rows, docs):
    """Every id in one piece, sequences without gaps; the share of padding."""
    lib = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in docs.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    used = padded = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        used, padded = used + at, padded + (packing.LENGTH if at & (at - 1) else at)
    return (padded - used) / used if used else 0


def test_packing_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_pieces(packing.query(spark, sf).collect(), docs) < 0.05


def test_packing_merges_leftovers_of_tasks(spark):
    docs = {k: "thou art " * (k * 13 % 700) for k in range(300)}
    df = spark.createDataFrame([(k, t or None, "x", 1) for k, t in docs.items()], "doc_id long, text string, seq string, part int").repartition(90)
    assert check_pieces(packing.pack(df).collect(), docs) < 0.03
    assert packing.pack(df.where("false")).count() == 0


@pytest.mark.parametrize("windows", [1, 3, 64])
def test_packer_is_bounded_and_loses_nothing(windows):
    rng = random.Random(windows)
    p, out, sizes = packing.Packer(100, windows), [], [rng.randint(1, 99) for _ in range(500)]
    for k, s in enumerate(sizes):
        if (w := p.add(k, s)) is not None:
            out.append(w)
        assert len(p.room) <= windows
    out += p.rest()
    assert sorted(k for w in out for k in w) == list(range(500)) and all(sum(sizes[k] for k in w) <= 100 for w in out)


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(3)
    sizes = sorted((rng.choice([rng.randint(1, 99), 50, 1]) for _ in range(700)), reverse=True)
    seq, offset = packing._best_fit_decreasing(np.array(sizes), 100)
    fill, order, want = [], [], []
    for s in sizes:
        fits = [w for w in order if fill[w] + s <= 100]
        best = max((fill[w] for w in fits), default=None)
        w = next((w for w in fits if fill[w] == best), None)  # of equal ones the one that waits longest
        if w is None:
            w = len(fill)
            fill.append(0)
        else:
            order.remove(w)
        want.append((w, fill[w]))
        fill[w] += s
        order.append(w)
    assert list(zip(seq.tolist(), offset.tolist(), strict=True)) == want


def test_merging_groups_are_bounded(spark, monkeypatch):
    assert packing.merge_groups([(3, 5), (1, 4), (2, 4), (9, 20), (10, 1)], 10) == {1: 0, 2: 0, 3: 1, 9: 2, 10: 3}
    docs = {k: "a" if k % 3 else None for k in range(3000)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(packing, "MERGE", 700)
    check_pieces(packing.pack(df).collect(), {k: t or "" for k, t in docs.items()})


def test_bpe_of_odd_rows(spark):
    own = bpe.PrefixEncoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    rows = [(1, "same", "x"), (1, "same", "x"), (None, None, None), (2, "", None), (3, "thou " * 60_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "ids"] and sorted((r.doc_id or 0, len(r.ids)) for r in got.collect()) == sorted((i or 0, len(own.encode(t or ""))) for i, t, _ in rows)
    assert bpe.encode(df.where("false")).count() == 0


def test_frequent_words_stay_remembered(monkeypatch):
    """When the worker's memory of words is full, those in use stay; before, all were forgotten and encoded again."""
    monkeypatch.setattr(bpe, "CACHE", 40)
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    own, lib, encoded = bpe.PrefixEncoder(path), Tokenizer.from_file(path), []
    plain = own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda piece: encoded.append(piece) or plain(piece))
    rare = iter(f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz")
    for _ in range(100):
        t = f"on thereisno {next(rare)} {next(rare)}, thereisno {next(rare)}.\nThereis\n\nx thereisno, y"
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    assert encoded.count(" thereisno") == 1 and len(encoded) > 300
    assert len(own.known) + len(own.older) <= 40 and len(own.pieces) <= 10
    for t in texts(5, 2000):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.digest(t)[2] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t
