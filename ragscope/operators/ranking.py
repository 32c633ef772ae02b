"""Global row positions without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no ``PARTITION BY`` moves every row
into one task. Here the table is range-partitioned on the order, each
partition numbers its own rows, and the per-partition counts (one small row
per partition) become offsets that are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragscope.session import checkpoint_dir


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (which must be a total order,
    so include a unique tie-breaker). Exact and distributed."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ids = ordered.withColumn("_pid", F.spark_partition_id()) \
                 .withColumn("_mid", F.monotonically_increasing_id())
    # Store the numbered rows once: the counts and the final projection must
    # see the same partitioning.
    checkpoint_dir(spark)
    ids = ids.checkpoint(eager=True)
    # Position inside the partition: the id's low 33 bits.
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    counts = ids.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window over this table is tiny.
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = offsets.fillna(0, ["_off"])
    return (ids.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, F.col("_off") + local + 1)
            .drop("_pid", "_mid", "_off"))
