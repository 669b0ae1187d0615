"""Labels as strings of compact digits, and column functions over them.

Characters ``$ACGTN#`` are the digits 0 to 6; digit strings sort as the index does, which the
characters in ASCII would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters by digit; sink and source digits; digits of the bases; number of digits (fixed values).
CHARACTERS = "$ACGTN#"
SINK, SOURCE, ANY = "0", "6", "5"
BASES = "1234"
SIGMA = 7


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(text: Column | str) -> Column:
    """Digits of a text: bases in either case, ``$`` and NUL, ``#``; all else is N."""
    return F.translate(F.regexp_replace(F.upper(_col(text)), "[^$\\x00ACGT#]", "N"), "$\0ACGTN#", "00123456")


def decode(digits: Column | str) -> Column:
    """The characters of digits."""
    return F.translate(_col(digits), "0123456", CHARACTERS)


def char_set(chars: Column | str) -> Column:
    """Bit set of a list of single characters, separated by one character each."""
    chars = encode(_col(chars))
    places = F.sequence(F.lit(1), F.greatest(F.length(chars), F.lit(1)), F.lit(2))
    bits = F.aggregate(places, F.lit(0), lambda s, i: s.bitwiseOR(F.pow(F.lit(2), F.substr(chars, i, F.lit(1)).cast("int")).cast("int")))
    return F.when(F.length(chars) > 0, bits).otherwise(F.lit(0))


def pack(digits: Column | str, preds: Column | str, succs: Column | str) -> Column:
    """The 64-bit key of up to 16 digits and two bit sets: three bits a digit from the top, then 8 and 8 bits. May be negative: longs are signed."""
    digits = _col(digits)
    places = F.sequence(F.lit(1), F.length(digits))
    label = F.aggregate(places, F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 3).bitwiseOR(F.substr(digits, i, F.lit(1)).cast("long")))
    return F.shiftleft(label, 16).bitwiseOR(F.shiftleft(_col(preds).cast("long"), 8)).bitwiseOR(_col(succs).cast("long"))


def unpack(key: Column | str, k: int) -> Column:
    """The k digits of a 64-bit key."""
    key = _col(key)
    return F.concat(*[F.shiftrightunsigned(key, 16 + 3 * (k - 1 - i)).bitwiseAND(7).cast("string") for i in range(k)])


def key_preds(key: Column | str) -> Column:
    """The predecessor set of a key."""
    return F.shiftrightunsigned(_col(key), 8).bitwiseAND(255).cast("int")


def key_succs(key: Column | str) -> Column:
    """The successor set of a key."""
    return _col(key).bitwiseAND(255).cast("int")


def replace_label(key: Column | str, rank: Column | str) -> Column:
    """A key with a number, the rank of its label, instead of the label; the sets stay."""
    return F.shiftleft(_col(rank).cast("long"), 16).bitwiseOR(_col(key).bitwiseAND(65535))


def has_bit(bits: Column | str, digit: Column | str | int) -> Column:
    """Whether a bit set holds a digit."""
    digit = F.lit(digit) if isinstance(digit, int) else _col(digit)
    return F.getbit(_col(bits).cast("long"), digit.cast("int")) == 1


def lcp(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix: the place of the first digits that differ, in linear time. Null if a side is null."""
    a, b = _col(a), _col(b)
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False).cast("int")
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.when(first == 0, F.length(a)).otherwise(first - 1))


def range_lcps(first_a: Column | str, last_a: Column | str, first_b: Column | str, last_b: Column | str) -> tuple[Column, Column]:
    """Least and greatest common prefix of labels from two ranges in order, the first before the second."""
    return lcp(first_a, last_b), lcp(last_a, first_b)


def increment_lcp(full: Column | str, part: Column | str, k: int) -> tuple[Column, Column]:
    """One more digit in common, for a length held as whole k-mers and digits of the next one."""
    carry = _col(part) + 1 >= k
    return F.when(carry, _col(full) + 1).otherwise(_col(full)), F.when(carry, 0).otherwise(_col(part) + 1)


def prefixes(label: Column | str, least: int = 1) -> Column:
    """All prefixes of a label, from a least length on."""
    label = _col(label)
    return F.transform(F.sequence(F.lit(least), F.greatest(F.length(label), F.lit(least))), lambda n: F.substr(label, F.lit(1), n))


def char_counts(df: DataFrame, digit: str) -> DataFrame:
    """comp, n and c (rows with a smaller digit) of every digit: at most SIGMA rows, so the one-task window is bounded."""
    counts = df.groupBy(F.col(digit).cast("int").alias("comp")).agg(F.count("*").alias("n"))
    return counts.select("comp", "n", F.coalesce(F.sum("n").over(Window.orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("c"))


def find_char(counts: DataFrame, at: Column | str) -> Column:
    """The digit whose range in the C array of ``char_counts`` (SIGMA rows at most) holds a place; null beyond all."""
    out = F.lit(None).cast("int")
    for row in sorted(counts.collect(), key=lambda r: -r["comp"]):
        out = F.when((_col(at) >= row["c"]) & (_col(at) < row["c"] + row["n"]), row["comp"]).otherwise(out)
    return out
