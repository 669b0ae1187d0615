"""Closed ranges as two columns, unit conversions, hashes and a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length(sp: Column, ep: Column) -> Column:
    """Positions of a range; 0 for an empty one."""
    return F.greatest(ep + 1 - sp, F.lit(0))


def is_empty(sp: Column, ep: Column) -> Column:
    return sp > ep


def bound(value: Column, low: Column, high: Column) -> Column:
    """The nearest value inside a range."""
    return F.greatest(F.least(value, high), low)


def empty() -> tuple[Column, Column]:
    """The canonical empty range."""
    return F.lit(1).cast("long"), F.lit(0).cast("long")


def bit_length(value: Column) -> Column:
    """Bits of a whole number from its highest one on; 1 for 0."""
    return F.length(F.bin(value))


def in_megabytes(size: Column) -> Column:
    return size / 1048576.0


def in_gigabytes(size: Column) -> Column:
    return size / 1073741824.0


def bits_per_character(size: Column, characters: Column) -> Column:
    return 8.0 * size / characters


def in_microseconds(seconds: Column) -> Column:
    return seconds * 1000000.0


def seeded_order(df: DataFrame, seed: int, *columns: str) -> DataFrame:
    """``df`` in an order that depends on the seed and the columns' values alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns)


#: A prime modulus and two factors under it (the shuffle's only constants).
_PRIME, _FACTOR, _SEED_FACTOR = 2147483647, 1103515245, 48271


def shuffled(df: DataFrame, seed: int, column: str, name: str) -> DataFrame:
    """``df`` with the place of each row in an order that depends on the seed and a column of distinct whole numbers alone."""
    from ..operators.ranking import dense_ids

    mixed = df.withColumn("__mixed", F.pmod(F.pmod(column, F.lit(_PRIME)) * F.lit(_FACTOR) + F.lit(seed * _SEED_FACTOR % _PRIME), F.lit(_PRIME)))
    return dense_ids(mixed, ["__mixed", column], name).drop("__mixed")
