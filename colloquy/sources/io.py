"""Readers and writers: CSV, Parquet, tagged multi-sheet reads.

Schemas are always declared, never inferred; text columns may hold newlines
and quotes, so CSV reads are multi-line with '"' escaping.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text comes back as it was: blanks at the ends stay, and an empty text ("")
# is told from a null (a bare \\N).
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             index_col: str | None = None, multi_line: bool = True) -> DataFrame:
    """Read a headed CSV with a declared schema.

    ``multi_line`` allows line feeds inside quoted text, and makes a file one
    task; switch it off for large files without any.

    ``index_col`` names the first column as the row id (a pandas
    ``index_col=0`` file); it is renamed to ``row_id``.
    """
    df = spark.read.options(**CSV_OPTIONS, multiLine=multi_line).schema(schema).csv(path)
    if index_col:
        df = df.withColumnRenamed(index_col, "row_id")
    return df


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_tagged(spark: SparkSession, sheets: Mapping[str, str], fmt: str = "parquet",
                schema: T.StructType | str | None = None, tag_col: str = "tab", multi_line: bool = True) -> DataFrame:
    """Read one file per sheet and stack them with the sheet name as a column.

    ``multi_line`` as in ``read_csv``: switch it off to split large CSV sheets into many tasks.
    """
    parts = []
    for tag, path in sheets.items():
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.options(**CSV_OPTIONS, multiLine=multi_line).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
        parts.append(df.withColumn(tag_col, F.lit(tag)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tag_union(frames: Mapping[str, DataFrame], tag_col: str = "tab") -> DataFrame:
    """Stack already-read frames, tagging each with its name."""
    items = [df.withColumn(tag_col, F.lit(tag)) for tag, df in frames.items()]
    out = items[0]
    for p in items[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              partition_by: list[str] | None = None) -> None:
    """Headed CSV without an index column; one folder per ``partition_by`` value."""
    w = df.write.mode(mode).options(**CSV_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_and_reload(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Persist a result as Parquet and read it back (replaces object pickling)."""
    write_table(df, path)
    return spark.read.parquet(path)


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order (a top-n, so the limit is the feature)."""
    return df.orderBy(*order_by).limit(n)


def row_range(df: DataFrame, row_id: str, lo: int = 0, hi: int = 1000) -> DataFrame:
    """Rows whose id lies in [lo, hi], both ends inclusive (label-based slice)."""
    return df.where(F.col(row_id).between(lo, hi))


def lists_to_rows(df: DataFrame, array_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Parallel arrays (one element per item) -> one row per position."""
    keep = keep or []
    return df.select(*keep, F.inline(F.arrays_zip(*[F.col(c) for c in array_cols])))
