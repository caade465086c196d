"""Streaming annotation: the topic cascade over a file stream.

The cascade is map-only (in-row scoring, no state, no join), so the batch
function applies unchanged to a streaming DataFrame in append mode. The
checkpoint location must be a shared folder; by default it is derived from
the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.scoring import KeywordScorer, cascade
from colloquy.sources.taxonomy import TOPIC_AMAZON, TOPIC_AMAZON_UNCASED, TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3


def annotate(df: DataFrame, text_col: str, scorer: KeywordScorer | None = None) -> DataFrame:
    """Wide annotation (works on batch and streaming frames alike)."""
    return cascade(df, text_col, [TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3],
                   flat=[TOPIC_AMAZON, TOPIC_AMAZON_UNCASED], scorer=scorer)


def annotate_stream(spark: SparkSession, source_dir: str, schema: T.StructType, text_col: str,
                    sink: str = "parquet", out_path: str | None = None, query_name: str | None = None,
                    checkpoint: str | None = None, available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Annotate every new Parquet file arriving in ``source_dir``.

    ``sink="parquet"`` appends to ``out_path``; ``sink="memory"`` registers
    ``query_name`` (tests). ``available_now`` processes what is there and stops.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = annotate(reader.parquet(source_dir), text_col)
    if not checkpoint:  # a fresh folder would process everything again after a restart
        raise ValueError("a stream needs a checkpoint folder that stays the same over restarts")
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if sink == "memory":
        w = w.format("memory").queryName(query_name or "annotated")
    else:
        w = w.format("parquet").option("path", out_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
