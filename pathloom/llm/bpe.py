"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece of text there is exactly one last token that the greedy merges can end
with. The matches of an automaton over the vocabulary give all tokens that end at a position; the
one whose predecessor (the last token of the shorter prefix) could stand before it unmerged is
stored. Back-pointers from the end give the exact ids. Time grows with the length of the piece times its matches, also for pieces
without any break.

Null and empty texts have no ids. Repeated rows are encoded each, alike; very long texts are encoded whole; of tokens that match at a place exactly one fits, so there are no ties. An empty table
gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_text, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: Texts between breaks that a worker remembers, in two generations; of other pieces a quarter as many.
CACHE = 1_000_000

#: Splits text before merging (fixed value of byte-level vocabularies); \s is Unicode white space.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space before other text always begins a piece.
BREAK = regex.compile(r" (?=\S)")
#: White space other than space and line feed.
ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder of one byte-level vocabulary whose ids rise with the rank of their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in special}
        self.token |= {i: t.encode() for t, i in special.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {i: -1 for i in self.token}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            new = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = rank
            self.rank[new], self.parts[new] = rank, (vocab[a], vocab[b])
        self.special = special
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        self.fits: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        taken = set(special.values())
        for i, b in self.token.items():
            if i not in taken and (i not in self.parts or self._stands(*self.parts[i], self.rank[i])):
                self.auto.add_word(b.decode("latin-1"), (len(b), i))
        self.auto.make_automaton()
        self.name = {i: str(i) for i in self.token}
        # by what follows the space of a break: those seen since the older ones were set aside, and the older ones
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}

    def _stands(self, left: int, right: int, under: float) -> bool:
        """No merge of a rank below ``under`` joins the two tokens across their border, at any stage of their making.

        Goes back through the making of both: the later merge of the two border tokens is undone first, and
        whatever pair then meets at the border must not have a merge that would have come before the undone one.
        """
        rank, merged = self.rank, self.merged
        while True:
            if (r := merged.get((left, right))) is not None and r < under:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                under, left = a, self.parts[left][1]
            else:
                # the right token's own merge came at its rank; ties go to the pair further left
                under, right = b + 1, self.parts[right][0]

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` in an encoding."""
        key = left << 32 | right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[key] = self._stands(left, right, float("inf"))
        return got

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece between breaks."""
        raw = piece.encode().decode("latin-1")
        last, size = [0] * len(raw), [0] * len(raw)
        fits, fit, done = self.fits, self.fit, -1
        for end, (length, token) in self.auto.iter(raw):
            if end == done:
                continue
            start = end - length
            if start >= 0:
                before = last[start]
                ok = fits.get(before << 32 | token)
                if not (fit(before, token) if ok is None else ok):
                    continue
            last[end], size[end], done = token, length, end
        out, at = [], len(raw) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _made(self, piece: str) -> tuple[str, bytes]:
        """Ids in text form and bytes of a piece that isn't remembered."""
        ids = self.encode_piece(piece)
        name = self.name
        return ",".join([name[i] for i in ids]), self.decode_bytes(ids)

    def _word(self, rest: str, plain: bool) -> tuple[str, bytes]:
        """The entry of a space and ``rest``, which begins no other break. plain: no special token is in it."""
        got = self.known.get(rest) or self.older.get(rest)
        if got is None:
            pieces = PATTERN.findall(" " + rest) if plain else ()
            got = self._made(pieces[0]) if len(pieces) == 1 else self._joined(pieces) if plain else self._entry(" " + rest)
        self._remember(rest, got)
        return got

    def _remember(self, rest: str, got: tuple[str, bytes]) -> None:
        if len(rest) < 64:
            if len(self.known) >= CACHE // 2:
                self.known, self.older = {}, self.known
            self.known[rest] = got

    def _joined(self, pieces: list[str]) -> tuple[str, bytes]:
        """The entry of pieces after each other."""
        out = []
        for piece in pieces:
            if len(piece) > 1 and piece[0] == " " and not piece[1].isspace():
                rest = piece[1:]
                got = self.known.get(rest) or self.older.get(rest)
                if got is None:
                    got = self._made(piece)
                    self._remember(rest, got)
                out.append(got)
                continue
            got = self.pieces.get(piece)
            if got is None:
                got = self._made(piece)
                if len(piece) < 64:
                    if len(self.pieces) >= CACHE // 4:
                        self.pieces.clear()
                    self.pieces[piece] = got
            out.append(got)
        return ",".join([e[0] for e in out]), b"".join([e[1] for e in out])

    def _entry(self, chunk: str) -> tuple[str, bytes]:
        out = []
        for k, part in enumerate(self.split.split(chunk) if self.split else [chunk]):
            if k % 2:
                i = self.special[part]
                out.append((self.name[i], self.token[i]))
            elif part:
                out.append(self._joined(PATTERN.findall(part)))
        return ",".join([e[0] for e in out]), b"".join([e[1] for e in out])

    def _entries(self, text: str) -> list[tuple[str, bytes]]:
        """Ids in text form and bytes of each chunk between breaks. Chunks behind a break are remembered by what follows its space."""
        if not text:
            return []
        plain = "  " not in text and " \n" not in text and text[-1] != " " and not ODD.search(text)
        first, *rest = text.split(" ") if plain else BREAK.split(text)
        out = list(map(self.known.get, rest))
        if None in out:
            unmarked = not any(s in text for s in self.special)
            for k in [k for k, got in enumerate(out) if got is None]:
                out[k] = self._word(rest[k], unmarked)
        return [self._entry(first), *out] if first else out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [int(i) for ids, _ in self._entries(text) if ids for i in ids.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join([self.token[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of what they decode to."""
        entries = self._entries(text)
        ids = ",".join([e[0] for e in entries])
        back = b"".join([e[1] for e in entries]).decode("utf-8", "replace")
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every text."""
    path = path or tokenizer_path(VOCABULARY)
    return map_text(docs, lambda ids, texts: {id_col: ids, "ids": [encoder(path).encode(t) for t in texts]}, f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>", id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: number and digest of the ids of every document, and digest of what they decode to."""
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY)

    def run(ids: list, texts: list) -> dict:
        got = [encoder(path).digest(t) for t in texts]
        return {"doc_id": ids, "n_tokens": [g[0] for g in got], "ids_sha256": [g[1] for g in got], "decoded_sha256": [g[2] for g in got]}

    return map_text(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
