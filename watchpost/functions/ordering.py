"""Consecutive positions in a global order without a single-task window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
``row_index`` instead range-partitions the rows on the order keys, numbers
them inside each range partition, and adds the count of all earlier
partitions.  The only un-partitioned step runs over one row per partition.
The range-partitioned, sorted frame is checkpointed to the shared
checkpoint folder first: range bounds come from sampling, so two separate
reads of the same lineage could cut the ranges differently; after the
checkpoint, numbering and offsets read the very same partitions (and a lost
executor does not re-sample them either).

Order keys should identify rows uniquely (as they do for every caller
here: one row per org, per snapshot, per minute); otherwise rows with equal
keys are numbered in an arbitrary but consistent order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART = "__wp_part"
_LOCAL = "__wp_local"
_OFFSET = "__wp_offset"


def _partitions(df: DataFrame, requested: int | None) -> int:
    if requested:
        return requested
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(1, int(conf))


def row_index(df: DataFrame, order: list[Column], name: str = "row_index", start: int = 1,
              partitions: int | None = None) -> DataFrame:
    """Add ``name`` = ``start`` + position of the row in ``order``."""
    n = _partitions(df, partitions)
    pid = F.spark_partition_id()
    sorted_parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    ranged = sorted_parts.withColumn(_PART, pid)
    # The id generator counts rows in partition order (its low 33 bits are the
    # position within the partition): no second shuffle.
    local = ranged.withColumn(
        _LOCAL, F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    )
    # One row per range partition: its size and the rows before it.
    counts = ranged.groupBy(_PART).agg(F.count(F.lit(1)).alias("__wp_n"))
    offsets = counts.select(
        F.col(_PART),
        (F.sum("__wp_n").over(Window.orderBy(_PART)) - F.col("__wp_n")).alias(_OFFSET),
    )
    # At most `n` rows (one per partition): a broadcast of proven size.
    out = local.join(F.broadcast(offsets), _PART, "inner")
    return out.withColumn(
        name, (F.col(_OFFSET) + F.col(_LOCAL) + F.lit(start)).cast("long")
    ).drop(_PART, _LOCAL, _OFFSET)
