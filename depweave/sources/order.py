"""Numbers in the order of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Rounds


def numbered(rows: DataFrame, by: str, rounds: Rounds, ties: bool = False) -> DataFrame:
    """The rows, written, with n: their number from 0 in the order of ``by``; with ``ties``, rows of equal keys have that of the first.

    Numbers are given within range partitions; each partition's first number comes from the counts of
    those before it, one row per partition.
    """
    rows = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id())
    if ties:  # equal keys lie in one partition and side by side: nothing moves
        rows = rows.withColumn("_first", F.min("_m").over(Window.partitionBy(by)))
    rows = rounds.write(rows, keep=True)
    sizes = rows.groupBy(F.shiftright("_m", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_first" if ties else "_m").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("_part", F.shiftright("_m", 33)).join(F.broadcast(starts), "_part")
    return rows.withColumn("n", F.col("_start") + within).drop("_m", "_first", "_part", "_start")
