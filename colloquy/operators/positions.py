"""Positional row numbers without putting a whole key into one task.

``row_number()`` over ``partitionBy(key)`` sorts and numbers all rows of a key
in a single task; a key holding a large share of the data becomes one huge
task. Here the data is range-partitioned by (key, order) -- a hot key is
split across many partitions -- and checkpointed, so partition ids are
stable.
Every row takes its ``monotonically_increasing_id`` there, consecutive within a
sorted partition. Rows and the first such id per (partition, key) make a small
table; a running sum of its counts per key (at most #partitions rows per key)
gives offsets. Position = offset + id - first id, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import join_small
from colloquy.session import checkpoint_dir


def positional_index(df: DataFrame, partition_cols: list[str], order_cols: list[str], out: str = "pos",
                     num_partitions: int | None = None, rows_per_partition: int = 1_000_000) -> DataFrame:
    """0-based position of each row within its ``partition_cols`` key, by ``order_cols``.

    Rows with equal order values keep a deterministic order only if the
    order columns are unique within a key (pass a tie-breaker column).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or max(1, -(-df.count() // rows_per_partition))
    keys = list(partition_cols)
    srt = (df.repartitionByRange(n, *keys, *order_cols).sortWithinPartitions(*keys, *order_cols)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_kj", F.to_json(F.struct(*keys)))  # null-safe join key
           .checkpoint(eager=True))
    counts = srt.groupBy("_pid", "_kj").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_first"))
    w = Window.partitionBy("_kj").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_kj", (F.coalesce(F.sum("_c").over(w), F.lit(0)) - F.col("_first")).alias("_off"))
    j = join_small(srt, offsets, on=["_pid", "_kj"])
    return j.withColumn(out, F.col("_off") + F.col("_mid")).drop("_pid", "_off", "_mid", "_kj")
