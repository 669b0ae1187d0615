"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into ordered text: text is escaped, other
parts become placeholders ``<|kind:n|>``, numbered within their turn, and are recorded with their reference and expanded token count. Turns are marked
``<|turn|>role<|is|>...<|end|>``. Escaping is reversible and leaves no ``<|`` inside a text: the escape
character goes before itself and before ``|``.

Null texts and roles count as empty. A content that is no JSON list of parts, or a part of another type, gives a row without a formatted turn
and with ``error``; no row is lost. Turns are ordered by turn (nulls first), then role, then text, so ties and
repeated rows have a defined order; conversations with a null id form one conversation. Very long texts are formatted whole; a long conversation streams:
memory is that of a batch of its turns. An empty table gives an empty result. Input columns keep their names and values: where one has the name of a new column,
the new one gets underscores behind its name until it differs; ``text_parts`` and ``read_back`` ignore extra columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, IS, END, ESCAPE = "<|turn|>", "<|is|>", "<|end|>", "\\"
#: Tokens that a placeholder expands to: of an image a square tile, of audio a second, of a document a page.
IMAGE_TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 448, 256, 25, 512

_placeholder = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_turn = re.compile(r"<\|turn\|>(.*?)<\|is\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """``text`` without bare bars, so that no ``<|`` arises, also where texts meet: a backslash before each backslash and bar."""
    return text.replace("\\", "\\\\").replace("|", "\\|")


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Flattener:
    """Visitor over typed parts: ``visit`` gives their text, ``attachments`` records what isn't text."""

    attachments: list[dict] = field(default_factory=list)

    def visit(self, parts: list[dict]) -> str:
        return "".join(getattr(self, f"visit_{p.get('type')}", self.visit_other)(p) for p in parts)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        across, down = (-(-max(1, part.get(k) or 1) // IMAGE_TILE) for k in ("width", "height"))
        return self._attach("image", part, across * down * TOKENS_PER_TILE)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, -(-int((part.get("seconds") or 0) * 1000) * TOKENS_PER_SECOND // 1000) or 1)

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, max(1, part.get("pages") or 1) * TOKENS_PER_PAGE)

    def visit_other(self, part: dict) -> str:
        raise ValueError(f"no such part: {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        n = len(self.attachments)
        self.attachments.append({"n": n, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{n}|>"


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict]]:
    """The marked text of a turn, and its attachments."""
    v = Flattener()
    return f"{TURN}{escape(role or '')}{IS}{v.visit(parts)}{END}", v.attachments


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, body) of every turn; the body is still escaped and has its placeholders."""
    for m in _turn.finditer(formatted):
        yield unescape(m[1]), m[2]


def body_text(body: str) -> str:
    """A body's text parts without placeholders, unescaped."""
    return unescape(_placeholder.sub("", body))


def parts_of(content: str | None) -> list[dict]:
    """The typed parts of a content; raises ValueError if it is no JSON list of them."""
    parts = json.loads(content) if content else []
    if not isinstance(parts, list) or not all(isinstance(p, dict) for p in parts):
        raise ValueError("the content is no list of parts")
    return parts


NEW_COLUMNS = ("formatted", "attachments", "expanded_tokens", "error")


def new_names(columns: list[str]) -> list[str]:
    """Names of the new columns beside ``columns``."""
    out = []
    for name in NEW_COLUMNS:
        while name.lower() in {c.lower() for c in [*columns, *out]}:
            name += "_"
        out.append(name)
    return out


def format_turns(rows: DataFrame, content_col: str = "content", role_col: str = "role") -> DataFrame:
    """``rows`` with formatted, attachments (JSON list), expanded_tokens and error. content: a JSON list of typed parts; null: no parts."""
    from pyspark.sql.types import LongType, StringType, StructType

    at, names = [rows.columns.index(c) for c in (role_col, content_col)], new_names(rows.columns)
    schema = StructType([*rows.schema.fields])
    for name in names:
        schema = schema.add(name, LongType() if name.startswith("expanded") else StringType())

    def formatted(role: str | None, content: str | None) -> tuple:
        try:
            text, found = format_turn(role, parts_of(content))
            return text, json.dumps(found), sum(a["tokens"] for a in found), None
        except (ValueError, TypeError, AttributeError, OverflowError, RecursionError) as x:  # what a part's values can be wrong in
            return None, None, None, str(x) or type(x).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [formatted(*x) for x in zip(*(b.column(k).to_pylist() for k in at), strict=True)]
            new = [pa.array([m[k] for m in made], pa.int64() if k == 2 else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return rows.mapInArrow(run, schema)


def text_parts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted of rows whose text is one text part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turn(role, [{"type": "text", "text": text}])[0] for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.string())], names=["conv_id", "turn", "role", "formatted"])

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {dict(conversations.dtypes)['conv_id']}, turn {dict(conversations.dtypes)['turn']}, role string, formatted string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each run of rows with one conv_id, from the formatted turns alone."""
    rows, now, state = [], object(), None

    def close() -> None:
        if state:
            rows.append((now, state["n"], state["turns"].hexdigest(), state["loss"], state["lossy"].hexdigest(), state["chars"]))

    def batch_of(kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        rows.clear()
        return out

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for conv, formatted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if state is None or conv != now:
                close()
                now, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss": 0, "lossy": hashlib.sha256(), "chars": 0}
            state["chars"] += len(formatted)
            for role, body in parse(formatted):
                text = body_text(body)
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state["loss"] += len(text)
                    state["lossy"].update(text.encode())
        if len(rows) > 2000:
            yield batch_of(kind)
    close()
    if rows:
        yield batch_of(kind)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256 (under the loss mask lie the assistants' texts), formatted_chars."""
    dealt = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "formatted")
    kind = dict(formatted.dtypes)["conv_id"]
    return dealt.select("conv_id", "formatted").mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: digests of all conversations and of conversation -1, whose texts are control strings of another template."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return read_back(text_parts(rows.unionByName(extra)))
