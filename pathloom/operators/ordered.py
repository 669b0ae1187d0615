"""Labels in order with the shortest prefixes that tell their values apart, and the ranks of both, in one range-partitioned sort.

A label's key is one digit longer than what it shares with the nearest labels of other values before and behind it. Within a sorted partition both are
running minima of what neighbours share, begun anew at every run of equal values. Only the first and the last run of a partition need to know of others:
the nearest labels of other values there, which the driver finds from one summary for each partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .ranking import kept, kept_in_order

#: Rows of a sorted partition at most, about, and those below which one is enough: a task holds its partition's digits.
MOST, LEAST = 250_000, 50_000
_FAR = 1 << 30


def parted(df: DataFrame, rows: int) -> int:
    """Range partitions for so many rows."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // MOST), min(few, -(-rows // LEAST)))


def digits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts of single bytes as rows of bytes, padded by zeros, and their lengths."""
    texts = texts.cast(pa.string())
    if len(texts) == 0:
        return np.zeros((0, 1), np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    sizes, data = np.diff(offsets), np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    wide = max(1, int(sizes.max()))
    if (sizes == wide).all():
        return data.reshape(len(sizes), wide), sizes
    out = np.zeros((len(sizes), wide), np.uint8)
    out[np.arange(wide) < sizes[:, None]] = data
    return out, sizes


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places up to the first that differs, row by row."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1]).astype(np.int64)


def _with(rows: np.ndarray, text: str) -> np.ndarray:
    """``shared`` of all rows and one text."""
    one = np.zeros(max(rows.shape[1], len(text)), np.uint8)
    one[: len(text)] = np.frombuffer(text.encode(), np.uint8)
    return np.minimum(shared(rows, one[None, : rows.shape[1]]), len(text))


def _least(c: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Running minimum within runs, which are numbered upwards."""
    return np.minimum.accumulate(c - run * _FAR) + run * _FAR


def _cut(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The first ``sizes`` bytes of rows as texts."""
    data = np.ascontiguousarray(rows[np.arange(rows.shape[1]) < sizes[:, None]])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data))


def _near(notes: list[dict], at: int, step: int) -> str | None:
    """The nearest label of another value than the first (step -1) or last (step 1) row's of a partition, in the partitions beyond it."""
    value, near, other = (notes[at]["first"], "last", "last_other") if step < 0 else (notes[at]["last"], "first", "first_other")
    k = at + step
    while 0 <= k < len(notes):
        if None in value or notes[k][near] != value:
            return notes[k][f"{near}_label"]
        if notes[k][other] is not None:
            return notes[k][other]
        k += step
    return None


def _columns(one: DataFrame) -> list:
    """The value as columns of longs."""
    kind = one.schema["value"].dataType
    fields = [F.col(f"value.{f.name}") for f in kind] if isinstance(kind, StructType) else [F.col("value")]
    kinds = [f.dataType for f in kind] if isinstance(kind, StructType) else [kind]
    null = F.col("value").isNull()
    out = []
    for c, t in zip(fields, kinds, strict=True):
        of = [c.cast("long")] if isinstance(t, IntegralType) else [F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)]
        out += [F.when(~null, F.coalesce(x, F.lit(-1 << 63))) for x in of]
    return out


def ordered(one: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """label, key, path_id, rnk and ``keep`` of one(label, value, ...), a row for each label: key as above, null where the value is, its rank and the label's rank.

    Labels without a value are different from all others.
    """
    values = _columns(one)
    rows = one.select("label", *[v.alias(f"__v{k}") for k, v in enumerate(values)], *keep)
    own, w = [f for f in rows.schema if f.name in keep], len(values)
    placed = rows.repartitionByRange(parted(one, one.count()), "label").sortWithinPartitions("label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        all_rows = pa.Table.from_batches(got).combine_chunks()
        label = all_rows.column(0).combine_chunks()
        m, _ = digits(label)
        n = len(m)
        null = np.asarray(all_rows.column(1).is_null())
        v = np.stack([np.asarray(all_rows.column(1 + k).fill_null(0)) for k in range(w)])
        new = np.ones(n, bool)
        new[1:] = (v[:, 1:] != v[:, :-1]).any(0) | null[1:] | null[:-1]
        c = np.full(n, -1, np.int64)
        c[1:] = shared(m[1:], m[:-1])
        run = np.cumsum(new)
        first, last = run == 1, run == run[-1]
        left = np.where(first, 0, _least(c, run))
        behind = np.append(c[1:], 0)
        right = np.where(last, 0, _least(behind[::-1], run[-1] - run[::-1])[::-1])
        text = lambda at: label[int(at)].as_py()
        value = lambda at: [None] if null[at] else [str(x) for x in v[:, at]]
        head, tail = int(first.sum()), n - int(last.sum())
        note = {"first": value(0), "last": value(n - 1), "first_label": text(0), "last_label": text(n - 1), "first_other": text(head) if head < n else None, "last_other": text(tail - 1) if tail else None}
        out = [label, *(all_rows.column(1 + w + k).combine_chunks() for k in range(len(own))), pa.array(np.maximum(left, right)), pa.array(first), pa.array(last), pa.array(new), pa.array(null), pa.array(c)]
        part = TaskContext.get().partitionId()
        names = ["label", *(f.name for f in own), "__shared", "__first", "__last", "__new", "__null", "__c"]
        table = pa.table([*out, pa.array(np.full(n, part, np.int64)), pa.nulls(n, pa.string())], names=[*names, "__part", "__note"])
        yield from table.to_batches(max_chunksize=20_000)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x.type) for x in out), pa.array([part], pa.int64()), pa.array([json.dumps(note)])], names=[*names, "__part", "__note"])

    schema = StructType([rows.schema["label"], *own])
    for name, kind in (("__shared", "long"), ("__first", "boolean"), ("__last", "boolean"), ("__new", "boolean"), ("__null", "boolean"), ("__c", "long"), ("__part", "long"), ("__note", "string")):
        schema = schema.add(name, kind)
    compared = kept_in_order(placed.mapInArrow(compare, schema))
    told = sorted((r["__part"], json.loads(r["__note"])) for r in compared.where("__note IS NOT NULL").select("__part", "__note").collect())
    notes = [x for _, x in told]
    around = {part: (_near(notes, k, -1), _near(notes, k, 1)) for k, (part, _) in enumerate(told)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, before, part, ends = -1, 0, -1, None, [None, None]
        for b in batches:
            col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            here = col["__note"].is_null()
            if not here.true_count:
                continue
            col = {k: x.filter(here) for k, x in col.items()}
            part = col["__part"][0].as_py()
            left, right = around[part]
            m, sizes = digits(col["label"])
            get = lambda name: np.asarray(col[name])  # noqa: E731, B023
            far, first, last, null = get("__shared").copy(), get("__first"), get("__last"), get("__null")
            if left is not None and first.any():
                far[first] = np.maximum(far[first], _with(m[first], left))
            if right is not None and last.any():
                far[last] = np.maximum(far[last], _with(m[last], right))
            size = np.where(null, 0, np.minimum(far + 1, sizes))
            fresh = get("__new") | (size != np.append(before, size[:-1])) | (get("__c") < size)
            id_ = ids + np.cumsum(fresh)
            keys = _cut(m, size)
            ids, before = int(id_[-1]), int(size[-1])
            ends = [ends[0] if ends[0] is not None else keys[0].as_py(), keys[-1].as_py()]
            n = len(size)
            keys = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), keys)
            yield pa.RecordBatch.from_arrays([col["label"], keys, pa.array(id_), pa.array(at + np.arange(n)), *(col[f.name] for f in own), col["__part"], pa.nulls(n, pa.string())], names=out_names)
            at += n
        if part is not None:
            note = json.dumps({"ids": ids + 1, "rows": at, "ends": ends})
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.nulls(1, t) for t in own_types), pa.array([part], pa.int64()), pa.array([note])], names=out_names)

    from pyspark.sql.pandas.types import to_arrow_type

    own_types = [to_arrow_type(f.dataType) for f in own]
    out_names = ["label", "key", "__id", "__rnk", *(f.name for f in own), "__part", "__note"]
    schema = StructType([rows.schema["label"]]).add("key", "string").add("__id", "long").add("__rnk", "long")
    for f in own:
        schema = schema.add(f)
    numbered = kept(compared.mapInArrow(number, schema.add("__part", "long").add("__note", "string")))
    starts, ids, at, end = [], 0, 0, None
    for part, note in sorted((r["__part"], json.loads(r["__note"])) for r in numbered.where("__note IS NOT NULL").select("__part", "__note").collect()):
        ids -= end is not None and note["ends"][0] == end and end != ""
        starts.append((part, ids, at))
        ids, at, end = ids + note["ids"], at + note["rows"], note["ends"][1]
    offsets = F.broadcast(one.sparkSession.createDataFrame(starts, "__part long, __ids long, __rows long"))
    met = numbered.where("__note IS NULL").join(offsets, "__part")
    return met.select("label", "key", (F.col("__id") + F.col("__ids")).alias("path_id"), (F.col("__rnk") + F.col("__rows")).alias("rnk"), *keep)
