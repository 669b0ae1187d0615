import hashlib
import struct
import time
import zlib

import numpy as np
import pytest
from pathloom.llm import tiff as T


@pytest.mark.parametrize("data", [b"", b"a", b"aa", b"aaa", b"abcabcabc" * 50, bytes(range(256)) * 30, b"\0" * 5000, np.random.default_rng(1).integers(0, 256, 9000, np.uint8).tobytes(), np.random.default_rng(2).integers(0, 3, 60000, np.uint8).tobytes()])
def test_codecs_round_trip(data):
    assert T.unpackbits(T.packbits(data)) == data
    assert T.unlzw(T.lzw(data)) == data


@pytest.mark.parametrize("compression", [T.NONE, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 48])
def test_pages_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(3)
    payload = rng.integers(97, 110, 64 * 77, np.uint8).tobytes()
    media = T.write(payload, page=64 * 30, strip=64 * 7, compression=compression, predictor=predictor, tile=tile)
    got = list(T.pages(media))
    assert [p.number for p in got] == [0, 1, 2] and b"".join(p.samples.tobytes() for p in got) == payload


def test_big_endian_sixteen_bit_planar_page():
    a = (np.arange(12).reshape(2, 3, 2) * 1000).astype(">u2")
    planes = [a[:, :, k].tobytes() for k in range(2)]
    tags = [(256, 3, [3]), (257, 3, [2]), (258, 3, [16, 16]), (259, 3, [1]), (273, 4, [8, 20]), (277, 3, [2]), (278, 3, [2]), (279, 4, [12, 12]), (284, 3, [2])]
    body, extra, entries = b"".join(planes), b"", b""
    base = 8 + len(body)
    for tag, kind, v in tags:
        value = struct.pack(f">{len(v)}{'HI'[kind == 4]}", *v)
        if len(value) > 4:
            extra, value = extra + value, struct.pack(">I", base + len(extra))
        entries += struct.pack(">HHI", tag, kind, len(v)) + value.ljust(4, b"\0")
    data = b"MM\0*" + struct.pack(">I", base + len(extra)) + body + extra + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0"
    (page,) = T.pages(data)
    assert (page.samples == a).all()


def test_broken_files_and_empty_values(spark):
    rows = [(1, T.write(b"x" * 64)), (2, None), (3, b""), (4, b"II*\0\xff\xff\0\0"), (None, b"nothing here")]
    got = {(r.id, r.page): r for r in T.read_pages(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    assert got[1, 0].pixels == b"x" * 64 and got[2, -1].error is None and got[3, -1].error is None
    assert got[4, -1].error and got[None, -1].error
    assert T.read_pages(spark.createDataFrame([], "id long, media binary"), "id", "media").count() == 0


def plain_unlzw(data):
    """Code by code over a string of bits."""
    bits, at, width, out, table, before = "".join(f"{b:08b}" for b in data), 0, 9, b"", None, None
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, before, width = {k: bytes([k]) for k in range(256)}, None, 9
            continue
        entry = table[code] if code in table else before + before[:1]
        if before is not None:
            table[256 + 2 + len(table) - 256] = before + entry[:1]
        out, before = out + entry, entry
        width = next(w for w in (9, 10, 11, 12) if len(table) + 2 + 1 < 1 << w or w == 12)


def plain_unpackbits(data):
    out, i = b"", 0
    while i < len(data):
        n = data[i]
        out += data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
        i += n + 2 if n < 128 else 2 if n > 128 else 1
    return out


def plain_read(data):
    """The samples of all pages, by another way: sample after sample, with the codecs above."""
    un = {1: bytes, 5: plain_unlzw, 8: zlib.decompress, 32773: plain_unpackbits}
    at, out = struct.unpack_from("<I", data, 4)[0], []
    while at:
        n = struct.unpack_from("<H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count, value = struct.unpack_from("<HHII", data, at + 2 + 12 * k)
            size = {3: 2, 4: 4}[kind]
            tags[tag] = [struct.unpack_from("<H" if kind == 3 else "<I", data, (at + 10 + 12 * k if size * count <= 4 else value) + size * j)[0] for j in range(count)]
        width, height = tags[256][0], tags[257][0]
        w, h = (tags[322][0], tags[323][0]) if 322 in tags else (width, tags[278][0])
        page = [bytearray(width) for _ in range(height)]
        for k, (o, c) in enumerate(zip(tags.get(324, tags.get(273)), tags.get(325, tags.get(279)), strict=True)):
            block, across = un[tags[259][0]](data[o : o + c]), -(-width // w)
            for i in range(len(block) // w):
                now = 0
                for j in range(w):
                    now = (block[i * w + j] + now) % 256 if tags[317][0] == 2 else block[i * w + j]
                    y, x = k // across * h + i, k % across * w + j
                    if y < height and x < width:
                        page[y][x] = now
        out.append(b"".join(page))
        at = struct.unpack_from("<I", data, at + 2 + 12 * n)[0]
    return out


@pytest.mark.parametrize("size", [1, 7, 300, 5000, 40000])
def test_lzw_equals_plain_decoder(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, np.uint8).tobytes(), rng.integers(97, 100, size, np.uint8).tobytes(), b"ab" * size):
        packed = T.lzw(data)
        assert T.unlzw(packed) == data and T.unlzw(packed, 5) == data[:5]
        if size <= 5000:
            assert plain_unlzw(packed) == data


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = T.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    used = set()
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        compression, tile = T.layout(payload)
        media = T.write(payload, compression=compression, tile=tile)
        used.add((compression, tile, len(payload) > 2000))
        if len(payload) < 4000 or r.doc_id % 40 == 0:
            assert b"".join(plain_read(media)) == payload
        hist = [sum(b // 16 == k for b in payload) for k in range(16)]
        mean = sum(payload) / len(payload)
        spread = (sum((b - mean) ** 2 for b in payload) / len(payload)) ** 0.5
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{mean:.4f}:{spread:.4f}:" + ",".join(map(str, hist)))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want
    assert len(used) == 12  # every codec in strips and tiles, for short and long texts


def test_query_rows(spark, tmp_path):
    rows = [(1, "a" * 64, "x"), (1, "a" * 64, "x"), (2, None, None), (2, "", None), (None, "é" * 200_000, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, feature string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(T.query(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_bytes))
    assert [(r.n_bytes, r.payload_bytes) for r in got] == [(64, 64), (64, 64), (0, 64), (0, 64), (400_000, 400_000)] and got[0] == got[1]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert T.query(spark, f"{tmp_path}/none").count() == 0


def changed(media, tag, value, page=0):
    """``media`` with the first value of a tag, and another number of values, replaced in a directory."""
    data, at = bytearray(media), struct.unpack_from("<I", media, 4)[0]
    for _ in range(page):
        at = struct.unpack_from("<I", media, at + 2 + 12 * struct.unpack_from("<H", media, at)[0])[0]
    for k in range(struct.unpack_from("<H", media, at)[0]):
        if struct.unpack_from("<H", media, at + 2 + 12 * k)[0] == tag:
            kind = struct.unpack_from("<H", media, at + 4 + 12 * k)[0]
            struct.pack_into("<I" if kind == 4 else "<H", data, at + 10 + 12 * k, value)
    return bytes(data)


def test_broken_pages_are_rows_and_the_next_pages_follow(spark):
    payload = bytes(range(64)) * 9
    strips = T.write(payload, page=192, strip=64, compression=T.LZW)
    tiles = T.write(payload, page=192, compression=T.PACKBITS, tile=16)
    one = T.write(payload, page=192, compression=T.DEFLATE)
    cases = [
        changed(strips, T.WIDTH, 0), changed(strips, T.HEIGHT, 0), changed(tiles, T.TILE_WIDTH, 0), changed(tiles, T.TILE_HEIGHT, 0), changed(strips, T.WIDTH, 1 << 31), changed(one, T.HEIGHT, 1 << 31),
        changed(tiles, T.TILE_WIDTH, 1 << 30), changed(strips, T.ROWS_PER_STRIP, 0), changed(strips, T.COMPRESSION, 7), changed(strips, T.BITS, 4), changed(one, T.STRIP_OFFSETS, 1 << 30), changed(one, T.STRIP_COUNTS, 3),
        changed(one, T.STRIP_COUNTS, 1 << 31), changed(strips, T.SAMPLES, 0), changed(strips, T.STRIP_OFFSETS, 1 << 31), changed(strips, T.PREDICTOR, 3), changed(one, T.ROWS_PER_STRIP, 1), changed(one, T.COMPRESSION, T.LZW),
    ]
    began = time.time()
    rows = [(k, m) for k, m in enumerate(cases)] + [(99, changed(one, T.STRIP_OFFSETS, 5, page=1)), (98, strips[:60])]
    got = {}
    for r in T.read_pages(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect():
        got.setdefault(r.id, {})[r.page] = r
    for k in range(len(cases)):
        assert got[k][0].error and got[k][0].pixels is None, k
        assert got[k][1].pixels + got[k][2].pixels == payload[192:] and got[k][1].error is None, k
    assert got[99][0].error is None and got[99][1].error and got[99][2].error is None and got[98][-1].error
    assert time.time() - began < 60


def test_overlapping_strips_are_an_error():
    media = bytearray(T.write(bytes(range(64)) * 4, strip=64, compression=T.NONE))
    at = struct.unpack_from("<I", media, 4)[0]
    for k in range(struct.unpack_from("<H", media, at)[0]):
        if struct.unpack_from("<H", media, at + 2 + 12 * k)[0] == T.STRIP_OFFSETS:
            where = struct.unpack_from("<I", media, at + 10 + 12 * k)[0]
            struct.pack_into("<I", media, where + 4, struct.unpack_from("<I", media, where)[0])
    (found,) = T.each_page(bytes(media))
    assert found[0] == 0 and "overlap" in found[1]
