"""Global ranks without a one-task window, and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``. A cluster's session must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "pathloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the session's shared checkpoint folder: later reads survive lost executors, and read the columns they need. Its order isn't kept."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_in_order(df: DataFrame) -> DataFrame:
    """As ``kept``, as a checkpoint: partitions and the order of their rows stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _offsets(df: DataFrame, sizes: dict[int, int], start: int = 0) -> DataFrame:
    """part, before: the rows of the partitions before each one. One row for each partition, so it may be broadcast."""
    rows, total = [], start
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "__part long, __before long"))


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with the rank (from ``start``) of each row in the order of columns whose values are unique.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the rows of the
    partitions before. Only one count for each partition goes through the driver.
    """
    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = dict(rows.groupBy("__part").count().collect())
    met = rows.join(_offsets(df, sizes, start), "__part")
    return met.select(*df.columns, (F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before")).alias(name))


def ranked_among(keys: DataFrame, key: str, probes: DataFrame, text: str, name: str) -> DataFrame:
    """``probes`` with the number of keys that aren't greater than their text.

    Keys and probes are sorted together by range partitions, each counts its keys as it goes, and the keys of the partitions before are added:
    no prefix is exploded, no range joined.
    """
    columns = [f.name for f in probes.schema]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in probes.schema]
    rows = keys.select(F.col(key).alias("__text"), F.lit(0).alias("__probe"), *none).unionByName(probes.select(F.col(text).alias("__text"), F.lit(1).alias("__probe"), *columns))
    placed = rows.repartitionByRange("__text", "__probe").sortWithinPartitions("__text", "__probe").select("__probe", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part, b = 0, TaskContext.get().partitionId(), None
        names = [*columns, "__n", "__part", "__total"]
        for b in batches:
            probe = b.column(0).to_numpy()
            n = count + np.cumsum(1 - probe).astype(np.int64)
            count = int(n[-1]) if len(n) else count
            here = pa.array(probe == 1)
            own = [c.filter(here) for c in b.columns[1:]]
            size = int((probe == 1).sum())
            yield pa.RecordBatch.from_arrays([*own, pa.array(n[probe == 1]), pa.array(np.full(size, part, np.int64)), pa.array(np.zeros(size, bool))], names=names)
        if b is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in b.columns[1:]), pa.array([count], pa.int64()), pa.array([part], pa.int64()), pa.array([True])], names=names)

    schema = StructType(list(placed.drop("__probe").schema)).add("__n", LongType()).add("__part", LongType()).add("__total", BooleanType())
    counted = kept(placed.withColumn("__probe", F.col("__probe").cast(IntegerType())).mapInArrow(run, schema))
    sizes = {r["__part"]: r["__n"] for r in counted.where("__total").select("__part", "__n").collect()}
    return counted.where("NOT __total").join(_offsets(probes, sizes), "__part").select(*columns, (F.col("__n") + F.col("__before")).alias(name))
