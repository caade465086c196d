"""Join helpers that broadcast only a side whose size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is salted and shuffled beyond this many rows; below it, it is broadcast
# if its size in bytes, as Spark knows it after materialising it, is within bounds.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20
SALT_BUCKETS = 32


def _size_bytes(df: DataFrame) -> int:
    """Spark's size of a frame: exact for a materialised one, an upper estimate otherwise."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS, salt: int = SALT_BUCKETS,
               small_rows: int | None = None) -> DataFrame:
    """Join ``big`` with a side that is usually small (per-group summaries).

    The small side is materialised and counted first. Up to ``max_rows`` and
    ``BROADCAST_MAX_BYTES`` it is broadcast, so the big side is never shuffled;
    wider rows are left to Spark's own choice. Beyond that it is joined by a shuffle on the
    keys plus a salt: every big row draws one of ``salt`` buckets from a hash of
    the row, and the small side is replicated once per bucket, so one hot key
    is spread over ``salt`` tasks instead of one.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if small_rows is None:
        # materialise the small side while counting it, so the join reuses it
        # instead of recomputing its upstream (usually an aggregate of big data)
        small = small.persist()
        n = small.count()
    else:
        n = small_rows
    if n <= max_rows:
        fits = _size_bytes(small) <= BROADCAST_MAX_BYTES
        return big.join(F.broadcast(small) if fits else small, on=on, how=how)
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salt))
    b = big.withColumn("_salt", bucket)
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return b.join(s, on=[*on, "_salt"], how=how).drop("_salt")
