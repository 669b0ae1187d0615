"""Media columns: TIFF. Walks image directories, decodes PackBits, LZW or deflate strips and tiles,
undoes predictors, and gives one row per page. A writer stores bytes as 8-bit samples.

Images are read whole in memory, one at a time, and pages leave one at a time. Supported: both byte orders; 8- and 16-bit unsigned samples;
chunky and planar samples; strips and tiles; compression 1 (none), 5 (LZW), 8 and 32946 (deflate),
32773 (PackBits); predictors 1 and 2 (horizontal differences).

A page that is not supported, or broken (no sides, strips that are missing, overlap or leave the file, more samples than its bytes can hold,
bytes that don't decode), is a row with its number and the column ``error``; the pages behind it follow. A file without a readable
chain of directories gets a row with page -1 and ``error``. A null or empty value has no pages: one row with page -1 and no error.
Nothing is allocated for a page before its size is known to fit its bytes. Repeated rows give repeated pages, in the order of their directories; an empty table gives
none; extra columns, whatever their names, are ignored. Very long payloads are spread over pages.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

#: Tags (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of a value by its type (fixed values of the format).
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Payload stored in a page at most, in an image row, and in a strip; side of a tile.
PAGE_BYTES, ROW_BYTES, STRIP_BYTES, TILE = 1 << 20, 64, 1 << 16, 32
#: Bytes that one stored byte can become at most: LZW's longest entry in its shortest code, PackBits' longest run, deflate's bound.
EXPANSION = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}


# ------------------------------------------------------------- compression

_run = re.compile(rb"(.)\1{2,127}", re.S)


def packbits(data: bytes) -> bytes:
    """Run-length code: a header byte n under 128 and n + 1 literals, or 257 - n and one byte for n copies."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _run.finditer(data):
        literal(m.start())
        at = m.end()
        out += bytes((257 - (at - m.start()), data[m.start()]))
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, most: int | None = None) -> bytes:
    """The inverse of ``packbits``, up to ``most`` bytes; header 128 is skipped."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (most is None or len(out) < most):
        h = data[i]
        if h < 128:
            out += data[i + 1 : i + 2 + h]
            i += h + 2
        else:
            if h > 128:
                out += data[i + 1 : i + 2] * (257 - h)
            i += 2 if h > 128 else 1
    return bytes(out[:most])


#: Codes that follow a clear code with 9, 10 and 11 bits; all later ones have 12.
_WIDE = ((9, 254), (10, 512), (11, 1024))
#: Codes between two clear codes of the writer: then the table is full.
_FULL = 3836


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends. Widths grow one code early."""
    codes, table, new = [256], {}, 258
    full, now, put = 258 + _FULL, -1, codes.append
    for b in data:
        if now < 0:
            now = b
            continue
        key = now << 8 | b
        nxt = table.get(key)
        if nxt is not None:
            now = nxt
            continue
        put(now)
        table[key] = new
        new += 1
        if new == full:
            put(256)
            table, new = {}, 258
        now = b
    if now >= 0:
        put(now)
    put(257)
    own = np.array(codes, np.uint16)
    start = np.flatnonzero(own == 256)
    since = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own)))) - 1  # codes since the last clear code; -1 for itself
    width = 9 + sum((since >= n).astype(np.int64) for n in np.cumsum([n for _, n in _WIDE]))
    width[start[1:]] = 12
    width[0] = 9
    place = np.arange(11, -1, -1)
    bits = (own[:, None] >> place & 1).astype(np.uint8)
    return np.packbits(bits[place[None, :] < width[:, None]]).tobytes()


def unlzw(data: bytes, most: int | None = None) -> bytes:
    """The inverse of ``lzw``, up to ``most`` bytes (and an entry)."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, at, size = [], 0, 0
    while True:  # from one clear code to the next
        table, before, cleared = base.copy(), None, False
        add = table.append
        for width, n in (*_WIDE, (12, len(bits))):
            n = min(n, (len(bits) - at) // width)
            codes = bits[at : at + n * width].reshape(-1, width) @ (1 << np.arange(width - 1, -1, -1))
            ends = np.flatnonzero((codes == 256) | (codes == 257))
            upto = int(ends[0]) if len(ends) else n
            for code in codes[:upto].tolist():
                if before is None:
                    if code > 255:
                        raise ValueError("LZW data begin with no byte")
                    entry = table[code]
                else:
                    if code > len(table):
                        raise ValueError("LZW code beyond its table")
                    entry = table[code] if code < len(table) else before + before[:1]
                    add(before + entry[:1])
                out.append(entry)
                size += len(entry)
                before = entry
                if most is not None and size >= most:
                    return b"".join(out)[:most]
            if upto < n:
                if codes[upto] == 257:
                    return b"".join(out)
                at, cleared = at + (upto + 1) * width, True
                break
            at += n * width
        if not cleared:
            return b"".join(out)


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, most))


_PACK = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1)}
_UNPACK = {NONE: lambda b, most: bytes(b[:most]), PACKBITS: unpackbits, LZW: unlzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}


# ------------------------------------------------------------- reading


@dataclass
class Page:
    """A decoded page: samples as an array of height x width x samples."""

    number: int
    compression: int
    predictor: int
    samples: np.ndarray


BROKEN = (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error)


def each_page(data: bytes) -> Iterator[Page | tuple[int, str]]:
    """The pages of a file, in the order of its directories; (number, error) for one that can't be read. Raises where the chain of directories breaks."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    if struct.unpack_from(e + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF magic number")
    at, seen, number = struct.unpack_from(e + "I", data, 4)[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("image directories form a loop or leave the file")
        seen.add(at)
        tags, at = _directory(data, at, e)
        try:
            yield _page(data, tags, e, number)
        except BROKEN as x:
            yield number, str(x) or type(x).__name__
        number += 1


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories. Raises for one that can't be read."""
    for p in each_page(data):
        if not isinstance(p, Page):
            raise ValueError(f"page {p[0]}: {p[1]}")
        yield p


def _directory(data: bytes, at: int, e: str) -> tuple[dict[int, list[int]], int]:
    n = struct.unpack_from(e + "H", data, at)[0]
    tags = {}
    for k in range(n):
        p = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(e + "HHI", data, p)
        size = TYPE_SIZE.get(kind, 0) * count
        where = p + 8 if size <= 4 else struct.unpack_from(e + "I", data, p + 8)[0]
        if kind in (1, 3, 4):
            inside = where + size <= len(data)  # values that leave the file are missing
            tags[tag] = list(struct.unpack_from(f"{e}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, where)) if inside else []
    return tags, struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, list[int]], e: str, number: int) -> Page:
    one = lambda tag, other: (tags.get(tag) or [other])[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    packed, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (8, 16) or packed not in _UNPACK or predictor not in (1, 2) or planar not in (1, 2) or any(b != bits for b in tags.get(BITS, [])):
        raise ValueError(f"not supported: {bits} bits, compression {packed}, predictor {predictor}")
    kind, deep, tiled = np.dtype(f"{e}u{bits // 8}"), samples if planar == 1 else 1, TILE_OFFSETS in tags
    if tiled:
        w, h, offsets, counts = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
    else:
        w, h, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, [])
    if min(width, height, samples, w, h) < 1:
        raise ValueError(f"no sides: {width} x {height} x {samples}, blocks of {w} x {h}")
    across, down = -(-width // w), -(-height // h)
    if not len(offsets) == len(counts) == across * down * (samples if planar == 2 else 1):
        raise ValueError(f"{len(offsets)} places and {len(counts)} sizes of strips or tiles")
    spans = sorted(zip(offsets, counts, strict=True))
    if any(a + n > b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) or spans[-1][0] + spans[-1][1] > len(data):
        raise ValueError("strips or tiles overlap or leave the file")
    rows_of = lambda y: h if tiled else min(h, height - y)
    size = lambda y: rows_of(y) * w * deep * kind.itemsize
    for k, count in enumerate(counts):
        if size(k % (across * down) // across * h) > count * EXPANSION[packed]:
            raise ValueError("a strip or tile holds less than its samples")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        block = np.frombuffer(_UNPACK[packed](data[offset : offset + count], size(y)), kind, rows_of(y) * w * deep).reshape(rows_of(y), w, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        first = plane if planar == 2 else 0
        out[y : y + h, x : x + w, first : first + deep] = block[: height - y, : width - x]
    return Page(number, packed, predictor, out)


def page_rows(value: bytes | None) -> Iterator[tuple]:
    """(page, width, height, samples, bits, compression, predictor, pixels, error) of every page of a media value."""
    if not value:
        yield (-1, *[None] * 8)
        return
    try:
        for p in each_page(value):
            if isinstance(p, Page):
                h, w, s = p.samples.shape
                yield p.number, w, h, s, p.samples.dtype.itemsize * 8, p.compression, p.predictor, p.samples.tobytes(), None
            else:
                yield (p[0], *[None] * 7, p[1])
    except BROKEN as x:
        yield (-1, *[None] * 7, str(x) or type(x).__name__)


def read_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each page: id, page, width, height, samples, bits, compression, predictor, pixels (row-major bytes), error."""
    kind = dict(df.dtypes)[id_col]
    names = ["id", "page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type] + [pa.int32()] * 7 + [pa.binary(), pa.string()]
            for own, value in zip(batch.column(0), batch.column(1), strict=True):
                for row in page_rows(value.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((own.as_py(), *row), kinds, strict=True)], names=names)

    schema = f"id {kind}, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"
    return df.select(F.col(id_col), F.col(media_col)).mapInArrow(run, schema)


# ------------------------------------------------------------- writing


def layout(payload: bytes) -> tuple[int, int]:
    """Compression and side of tiles (0: strips) of a payload, drawn from its CRC, so that payloads of every size use all of them."""
    n = zlib.crc32(payload)
    return (PACKBITS, LZW, DEFLATE)[n % 3], n // 3 % 2 * TILE


def write(payload: bytes, row: int = ROW_BYTES, page: int = PAGE_BYTES, strip: int = STRIP_BYTES, compression: int = DEFLATE, predictor: int = 2, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit grey pages that holds ``payload``, whose length is a multiple of ``row``.

    Pages have ``page`` bytes at most, strips ``strip``. With ``tile`` (a multiple of 16) pages have square tiles of that side instead.
    """
    if not payload or len(payload) % row:
        raise ValueError("the payload must fill its rows")
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for start in range(0, len(payload), page):
        image = np.frombuffer(payload[start : start + page], np.uint8).reshape(-1, row)
        if tile:
            h, w = -(-image.shape[0] // tile) * tile, -(-row // tile) * tile
            full = np.zeros((h, w), np.uint8)
            full[: image.shape[0], :row] = image
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            rows = max(1, strip // row)
            blocks = [image[y : y + rows] for y in range(0, image.shape[0], rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.uint8(0))
            packed = _PACK[compression](b.tobytes())
            offsets.append(len(out)), counts.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        tags = [(WIDTH, 4, [row]), (HEIGHT, 4, [image.shape[0]]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"<{len(values)}{'HI'[kind == 4]}", *values)
            if len(value) > 4:
                at = len(out)
                out += value
                value = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def feature(samples: np.ndarray) -> str:
    """Mean, spread and a 16-bin histogram of a payload's samples."""
    hist = np.bincount(samples >> 4, minlength=16)
    return f"{samples.mean():.4f}:{samples.std():.4f}:" + ",".join(map(str, hist))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document stored as a TIFF, read back from the stored bytes, with digests and features."""
    docs = table(spark, sf_dir, "documents")
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")

    def run(ids: list, texts: list) -> dict:
        rows = []
        for t in texts:
            raw = t.encode()
            payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
            compression, tile = layout(payload)
            media = write(payload, compression=compression, tile=tile)
            got = list(page_rows(media))
            back = b"".join(r[7] for r in got)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(back, np.uint8)), len(got)))
        return {"doc_id": ids} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return map_text(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long")
