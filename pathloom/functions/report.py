"""Version and verbosity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = (1, 1, 0)
#: Levels of reports, from silent on.
LEVELS = ("silent", "basic", "extended", "full")


def version(name: str = "pathloom") -> str:
    """The name and version in words."""
    return f"{name} version {'.'.join(map(str, VERSION))}"


def level(number: int) -> int:
    """The nearest level that there is."""
    return max(0, min(len(LEVELS) - 1, number))


def level_name(number: Column | str) -> Column:
    """The name of a level; numbers beyond the last are the last."""
    c = F.col(number) if isinstance(number, str) else number
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.greatest(F.lit(0), F.least(c, F.lit(len(LEVELS) - 1))) + 1).cast("int"))


def about(spark: SparkSession) -> DataFrame:
    """One row: the version's text and parts."""
    return spark.createDataFrame([(version(), *VERSION)], "version string, major int, minor int, patch int")
