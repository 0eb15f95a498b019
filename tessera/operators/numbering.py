"""Gapless ids in sort order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle


def number_rows(df: DataFrame, order: list, name: str = "id", partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """``df`` with ``name`` from 0 up in the order of ``order``, which must tell all rows apart; with ``weight``, the sum of that column over the rows before.

    Rows are range-partitioned and sorted; each keeps its place in its partition, and the sizes of the partitions before it (one number a partition) are added.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = settle(placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    if weight:
        own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("__at", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    sizes = placed.groupBy("__part").agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
