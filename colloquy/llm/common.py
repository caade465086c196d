"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import session
from colloquy.session import checkpoint_dir

__all__ = ["arrow_map", "batches", "gapless_rank", "new_folder", "pick", "ship_package", "stored", "write_bytes",
           "read_bytes", "shared_file_system"]


#: Rows of a batch that Spark sends to Python, where the session leaves it at Spark's own 10,000:
#: texts are long, and a task should not hold 10,000 of them.
BATCH_ROWS = 1024


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors; keep batches for Python small."""
    session.ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the names the operator uses inside.

    Every operator starts with this, so extra input columns, whatever their
    names, can never clash with the operator's own.
    """
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the shared checkpoints (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files), gives the planner true
    sizes, and makes a table that is used twice be computed once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(it: Iterator[pa.RecordBatch], max_rows: int = 2048, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded rows and bytes (one row at least)."""
    for b in it:
        if not b.num_rows:
            continue
        step = max(1, min(max_rows, int(b.num_rows * max_bytes / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package sent to the executors first."""
    ship_package(df.sparkSession)

    def task(it):
        try:
            yield from fn(it)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def gapless_rank(df: DataFrame, key: str, rank: str, part: str, local: str) -> DataFrame:
    """A rank from 0 without gaps within each ``key``, with no task per key.

    ``part`` names the task that made a row, and ``local`` counts up by one
    from row to row of a key within a part. ``df`` must be a written table, so
    that both are fixed. The counts per (key, part) are summed up in part
    order, and each row adds its own part's start.
    """
    counts = df.groupBy(key, part).agg(F.count(F.lit(1)).alias("_n"), F.min(local).alias("_first"))
    order = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(order), F.lit(0))
    starts = counts.select(F.col(key).alias("_k"), F.col(part).alias("_p"), (before - F.col("_first")).alias("_start"))
    on = df[key].eqNullSafe(starts["_k"]) & (df[part] == starts["_p"])
    return (df.join(starts, on).withColumn(rank, (F.col("_start") + F.col(local)).cast("long"))
            .drop("_k", "_p", "_start"))


# ---------------------------------------------------------------------------
# plain files in the shared folder, written and read inside tasks
# ---------------------------------------------------------------------------

def shared_file_system(uri: str):
    """(pyarrow file system, path) of a folder in shared storage (file, s3, gs, hdfs)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """Write a whole file under a temporary name, then move it into place, so
    that a retried or speculative task leaves one complete file."""
    system, path = shared_file_system(uri)
    folder = path.rsplit("/", 1)[0]
    system.create_dir(folder, recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    system.move(temporary, path)


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """A file, or ``length`` bytes of it from ``start``."""
    system, path = shared_file_system(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def file_size(uri: str) -> int:
    system, path = shared_file_system(uri)
    return system.get_file_info(path).size


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
