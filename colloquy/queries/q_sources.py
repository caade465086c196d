"""Source and sink queries: tagged unions and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.catalog import query, rnd
from colloquy.plans import evaluation
from colloquy.queries.sqlparts import keyword_scores
from colloquy.session import scratch_path
from colloquy.sources import io
from colloquy.sources.tables import table
from colloquy.sources.taxonomy import LANGUAGES


@query("tagged_union", """
SELECT 'documents' AS tab, doc_id AS id, length(text)::INTEGER AS n_chars FROM documents
UNION ALL SELECT 'benchmark', item_id, length(text)::INTEGER FROM benchmark""")
def tagged_union(spark, sf_dir):
    """Two 'sheets' stacked with the sheet name as a column."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    u = io.tag_union({"documents": docs, "benchmark": bench})
    return u.select("tab", "id", F.length("text").alias("n_chars"))


DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
])


@query("csv_roundtrip", """
SELECT doc_id, lang, source, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM documents""")
def csv_roundtrip(spark, sf_dir):
    """Documents written as headed CSV (one folder per language) and read back:
    multi-line texts with quotes survive unchanged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    io.write_csv(docs, path, partition_by=["lang"])
    back = io.read_csv(spark, path, T.StructType([f for f in DOC_SCHEMA.fields if f.name != "lang"]))
    back = back.withColumn("lang", F.regexp_extract(F.input_file_name(), "lang=([^/]+)", 1))
    return back.select("doc_id", "lang", "source", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("score_roundtrip", f"""WITH {keyword_scores("documents", "doc_id", "text", LANGUAGES)}
SELECT d.doc_id, d.lang AS truth, t.label, round(t.score, 6) AS score
FROM k_top t JOIN documents d ON d.doc_id = t.id""")
def score_roundtrip(spark, sf_dir):
    """Language predictions saved as Parquet in the shared folder and reloaded."""
    p = evaluation.language_predictions(table(spark, sf_dir, "documents"))
    back = io.save_and_reload(spark, p, scratch_path(spark, f"scores-{uuid.uuid4().hex}"))
    return back.select("doc_id", "truth", "label", rnd("score").alias("score"))


@query("preview", f"""WITH {keyword_scores("documents", "doc_id", "text", LANGUAGES)}
SELECT d.doc_id, t.label, round(t.score, 6) AS score FROM k_top t JOIN documents d ON d.doc_id = t.id
ORDER BY d.doc_id LIMIT 5""")
def preview(spark, sf_dir):
    """First five predictions in id order (a head() of the result)."""
    p = evaluation.language_predictions(table(spark, sf_dir, "documents"))
    return io.preview(p.select("doc_id", "label", rnd("score").alias("score")), ["doc_id"], 5)
