"""Graph positions as longs: id (53 bits), orientation (1 bit), offset (10 bits); and id mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET_BITS, MAX_OFFSET = 10, 1023


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _joined(node: Column, offset: Column, reverse: Column) -> Column:
    return F.shiftleft(node.cast("long"), OFFSET_BITS + 1).bitwiseOR(F.when(reverse, 1 << OFFSET_BITS).otherwise(0).cast("long")).bitwiseOR(offset.cast("long"))


def encode(node: Column | str, offset: Column | str, reverse: Column | bool = False) -> Column:
    """The long of id, offset and orientation; an offset under 0 or over MAX_OFFSET raises: it has no bits to lie in."""
    at = _col(offset).cast("long")
    at = F.when(at.isNull() | at.between(0, MAX_OFFSET), at).otherwise(F.raise_error(F.format_string("offset %s is not from 0 to 1023", at)).cast("long"))
    return _joined(_col(node), at, reverse if isinstance(reverse, Column) else F.lit(bool(reverse)))


def parse(token: Column | str) -> Column:
    """The long of ``id:offset`` or ``id:-offset``; 0 for anything else, also for offsets over 1023."""
    token = _col(token)
    form = r"^(\d+):(-?)(\d+)$"
    offset = F.regexp_extract(token, form, 3)
    good = token.rlike(form) & (F.length(offset) <= 9) & (F.coalesce(F.try_to_number(offset, F.lit("999999999")), F.lit(9999)) <= MAX_OFFSET)
    return F.when(good, _joined(F.regexp_extract(token, form, 1), offset, F.regexp_extract(token, form, 2) == "-")).otherwise(F.lit(0).cast("long"))


def ident(node: Column | str) -> Column:
    return F.shiftrightunsigned(_col(node), OFFSET_BITS + 1)


def reverse(node: Column | str) -> Column:
    return F.shiftrightunsigned(_col(node), OFFSET_BITS).bitwiseAND(1) == 1


def offset(node: Column | str) -> Column:
    return _col(node).bitwiseAND(MAX_OFFSET)


def show(node: Column | str) -> Column:
    """``id:offset`` or ``id:-offset``."""
    return F.concat(ident(node).cast("string"), F.lit(":"), F.when(reverse(node), "-").otherwise(""), offset(node).cast("string"))


def mapped(rows: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the ids in node columns replaced by mapping(id, mapped); ids that aren't there, offsets and orientations stay."""
    for k, c in enumerate(columns):
        to = mapping.select(F.col("id").alias(f"__id{k}"), F.col("mapped").alias(f"__to{k}"))
        joined = rows.join(to, ident(c) == F.col(f"__id{k}"), "left")
        new = F.when(F.col(f"__to{k}").isNull(), F.col(c)).otherwise(_joined(F.col(f"__to{k}"), offset(c), reverse(c)))
        rows = joined.select(*[new.alias(n) if n == c else F.col(n) for n in rows.columns])
    return rows


def append_mapping(mapping: DataFrame, nodes: DataFrame, next_id: int) -> DataFrame:
    """``mapping`` and new ids from ``next_id`` on for the given ids, in their order (range-partitioned, no global window)."""
    from ..operators.ranking import dense_ids

    return mapping.unionByName(dense_ids(nodes.select("id").distinct(), ["id"], "n").select((F.col("n") + next_id).alias("id"), F.col("id").alias("mapped")))
