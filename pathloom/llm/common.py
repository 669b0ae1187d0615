"""Shared helpers: table access, Arrow batch mapping, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie when ``public_tokenizers`` can't be imported.
TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``. A session that names none gets a temporary folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "pathloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, read back, and its path: compressed, unlike a checkpoint."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settled(spark: SparkSession) -> None:
    """Let the driver drop what it holds of finished phases: plans, and references to shuffles and checkpoints, whose files go with them.

    A long chain of jobs in one call leaves more of that than a small driver has room for, before its JVM collects garbage by itself.
    """
    gc.collect()
    spark._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_text(df: DataFrame, fn: Callable[[list, list], dict | list], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``fn(ids, texts) -> {column: values}`` to Arrow batches of two columns. Null texts arrive as ``""``."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch):
                got = fn(ids, texts)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers live on and serve other operators."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[tuple[list, list[str]]]:
    """Short runs of (first column, second column as text without nulls): Python objects of few rows live at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def filter_rows(df: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns as they are, for whose text ``keep`` says true. Null texts count as empty."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                mask = keep([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


# ---------------------------------------------------------------- hashing

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of a text hashed at once, if a space lets it be cut.
_SEGMENT = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, _SEGMENT) - 1, base, np.uint64)]))
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: each output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word (runs of bytes other than ASCII white space), in order.

    A word's hash is a difference of running sums of its bytes times powers of a base, brought to the word's
    start by the inverse power; so equal words have equal hashes anywhere, and the time is linear.
    """
    if len(raw) > _SEGMENT:
        at = max(raw.rfind(c, 0, _SEGMENT) for c in (b" ", b"\n"))
        if at > 0:
            parts = [word_hashes(raw[:at])]
            while at < len(raw):
                end = len(raw) if len(raw) - at <= _SEGMENT else max(raw.rfind(c, at + 1, at + _SEGMENT) for c in (b" ", b"\n"))
                end = end if end > at else min((x for x in (raw.find(c, at + 1) for c in (b" ", b"\n")) if x > 0), default=len(raw))
                parts.append(_hashes(raw[at:end]))
                at = end
            return np.concatenate(parts)
    return _hashes(raw)


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff((~_SPACE[b]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * _power(_BASE, len(b)), out=sums[1:])
    back = _power(pow(_BASE, -1, 2**64), len(b))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` words, by the place of its first word."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)


def shingles(raw: bytes, size: int = 5) -> np.ndarray:
    """Hashes of all word shingles; a shorter text has one shingle of all its words; a text without words has none."""
    words = word_hashes(raw)
    return windows(words, size) if len(words) >= size else windows(words, len(words)) if len(words) else words
