"""Packing: bounded-space online best fit.

Every task keeps at most ``WINDOWS`` open windows of ``LENGTH`` tokens. A document is cut into full
windows and a rest; the rest goes to the open window that it fills best. When it fits none and all windows are in
use, the fullest is emitted. Windows still open at the end of a task are leftovers: their pieces (not their
tokens) are merged by best fit decreasing over groups of tasks. A group is as many tasks, one after another, as have at most ``MERGE`` such pieces together (or one task:
it has ``WINDOWS * LENGTH`` at most), so that a merging task's memory is bounded, and the number of part-filled sequences grows with the groups alone.

Null and empty texts have the end token alone and are packed like others. Very long texts are encoded and cut whole. Repeated rows are packed
each. Windows that a piece fills alike are taken in the order in which they were opened. An empty table gives no pieces. The result depends on how the table is split into
tasks, not on when they run; a lost executor repeats the same pieces. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, reliable_checkpoint, slices, table, tokenizer_path

LENGTH, WINDOWS, END = 4096, 64, 2
#: Leftover pieces that are merged in one task.
MERGE = 1 << 18
VOCABULARY = "word_bpe_49k.json"
#: Chunks of text whose ids a worker remembers.
CACHE = 200_000

_workers: dict[str, Callable[[str], np.ndarray]] = {}

#: Characters whose lower case, composition and class are beyond doubt: printable ASCII and Latin letters up to U+017E.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]*")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u017e"
#: The vocabulary's own splitting pattern over such characters in lower case (fixed value).
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")
#: Longest chunk that is encoded word by word.
_LONG = 200


def word_ranks(path: str) -> tuple[dict[bytes, int], set[str]]:
    """Byte strings of the vocabulary with their ids, byte 255 (no part of UTF-8) for the word end; and the special tokens.

    Ids rise with the rank of merges, and a byte with its word end comes before all merges, so merging the pair with the least id gives the library's ids.
    """
    from .bpe import byte_alphabet

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, end = byte_alphabet(), spec["model"]["end_of_word_suffix"]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {}
    for t, i in spec["model"]["vocab"].items():
        if t not in special:
            body = t.removesuffix(end)
            ranks[bytes(alphabet[c] for c in body) + (b"\xff" if body != t else b"")] = i
    return ranks, special


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids, as the tokenizers library gives without special tokens added.

    The vocabulary's pieces never hold white space, so chunks between it are encoded alone and remembered. Plain chunks
    are lowered, split and merged word by word, others (special tokens, other scripts, very long ones) by the library. Texts with separators
    that the library takes for ordinary characters go to it whole.
    """
    if path not in _workers:
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation(), tok.no_padding()
        ranks, special = word_ranks(path)
        merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        odd = [chr(c) for c in range(0x1C, 0x20)]
        known: dict[str, bytes] = {}

        def chunk_ids(chunk: str) -> bytes:
            if len(chunk) > _LONG or not _PLAIN.fullmatch(chunk) or "<|" in chunk and any(s in chunk for s in special):
                return np.array(tok.encode(chunk, add_special_tokens=False).ids, np.uint32).tobytes()
            ids: list[int] = []
            for w in _WORD.findall(chunk.lower()):
                ids += merge(w.encode() + b"\xff")
            return np.array(ids, np.uint32).tobytes()

        def encode(text: str) -> np.ndarray:
            if any(c in text for c in odd):
                return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
            out = []
            for c in text.split():
                got = known.get(c)
                if got is None:
                    got = chunk_ids(c)
                    if len(c) < 64:
                        if len(known) >= CACHE:
                            known.clear()
                        known[c] = got
                out.append(got)
            return np.frombuffer(b"".join(out), np.uint32)

        _workers[path] = encode
    return _workers[path]


class Packer:
    """At most ``windows`` open windows; ``add`` places a piece of under ``length`` and returns the window that it closed, if any."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.windows = length, windows
        self.room: list[tuple[int, int]] = []  # (room left, window), in order
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, piece, size: int) -> list | None:
        closed = None
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, w = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                closed = self.held.pop(self.room.pop(0)[1])
            room, w = self.length, self.made
            self.made += 1
            self.held[w] = []
        self.held[w].append(piece)
        if room > size:
            bisect.insort(self.room, (room - size, w))
            return closed
        return self.held.pop(w)  # only a window that was open before gets full, so none was closed

    def rest(self) -> list[list]:
        """The open windows, which are closed by this."""
        out = [self.held[w] for _, w in self.room]
        self.room, self.held = [], {}
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, seq long, offset long, open boolean"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with the window that its task put it in; ``open``: the window was left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, part, seq = encoder(path), Packer(), TaskContext.get().partitionId(), 0
        names, rows = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset", "open"), []

        def emit(window: list, left: bool) -> None:
            nonlocal seq
            offset = 0
            for doc, start, size, crc, total in window:
                rows.append((doc, start, size, crc, total, part, seq, offset, left))
                offset += size
            seq += 1

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + [pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names=list(names))
            rows.clear()
            return out

        for batch in batches:
            for ids, texts in slices(batch):
                for doc, text in zip(ids, texts, strict=True):
                    own = np.append(encode(text), np.uint32(END)).astype("<u4")
                    for at in range(0, len(own), LENGTH):
                        cut = own[at : at + LENGTH]
                        piece = (doc, at, len(cut), zlib.crc32(cut.tobytes()), len(own))
                        if len(cut) == LENGTH:
                            emit([piece], False)
                        elif (closed := packer.add(piece, len(cut))) is not None:
                            emit(closed, False)
                if len(rows) > 5000:
                    yield batch_of()
        for window in packer.rest():
            emit(window, True)
        yield batch_of()
        release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


def _best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """A sequence number and an offset for each piece, the pieces being in falling order of size. Windows of equal room are taken first opened first."""
    seq, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    waiting: dict[int, deque[int]] = {}  # windows by their room
    rooms: list[int] = []  # those there are, in order: at most ``length``
    made = 0
    for k, size in enumerate(sizes.tolist()):
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            w = waiting[room].popleft()
            if not waiting[room]:
                del waiting[room], rooms[at]
        else:
            room, w, made = length, made, made + 1
        seq[k], offset[k] = w, length - room
        if room > size:
            left = room - size
            if left not in waiting:
                waiting[left] = deque()
                bisect.insort(rooms, left)
            waiting[left].append(w)
    return seq, offset


def _merge(t: pa.Table) -> pa.Table:
    """Best fit decreasing over the leftover pieces of a group; an open window left at the end is a sequence too."""
    t = t.sort_by([("length", "descending"), ("part", "ascending"), ("seq", "ascending"), ("offset", "ascending")])
    seq, offset = _best_fit_decreasing(t["length"].to_numpy())
    for name, values in (("seq", seq), ("offset", offset)):
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(values))
    return t


def merge_groups(left: list[tuple[int, int]], most: int = MERGE) -> dict[int, int]:
    """A group for each task (part, pieces): tasks one after another, up to ``most`` pieces or one task."""
    out, group, held = {}, -1, most + 1
    for part, n in sorted(left):
        if held + n > most:
            group, held = group + 1, 0
        out[part], held = group, held + n
    return out


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    placed = reliable_checkpoint(pieces(docs, path or tokenizer_path(VOCABULARY), id_col, text_col))
    named = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset"]
    closed = placed.where(~F.col("open")).select(*named, F.lit(0).cast("long").alias("round"))
    # a row for each task, which is what a plan holds anyway
    groups = merge_groups([tuple(r) for r in placed.where("open").groupBy("part").count().collect()])
    grouped = docs.sparkSession.createDataFrame(list(groups.items()), "part long, grp long")
    waiting = placed.where("open").select(*named).join(F.broadcast(grouped), "part").select(*named, "grp")
    merged = reliable_checkpoint(waiting.groupBy("grp").applyInArrow(_merge, waiting.schema))
    merged = merged.select(*[F.col("grp").alias("part") if c == "part" else F.col(c) for c in named], F.lit(1).cast("long").alias("round"))
    every = closed.unionByName(merged)
    sequence = F.shiftleft(F.col("part"), 32).bitwiseOR(F.shiftleft(F.col("seq"), 1)).bitwiseOR(F.col("round"))
    return every.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"))
