"""Numbers of rows in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandset.storage import shared_folder


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with number, from 1, in the order given; nulls come first.

    Rows are dealt by range once, rows of one key too, and kept as a checkpoint, so that the sizes of the ranges and the
    numbers within them speak of the same rows. The driver sees a count for each range.
    """
    shared_folder(df.sparkSession)  # checkpoints need one
    key = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.withColumn("__salt", F.rand(1)).repartitionByRange(*key, "__salt").withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*key, "__salt"))
    return ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__part").withColumn("number", F.col("__before") + F.col("__inside")).drop("__salt", "__part", "__inside", "__before")
