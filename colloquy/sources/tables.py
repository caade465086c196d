"""The driver tables and the fixtures Spark derives from them.

Each derived table maps a reference input (question/answer rows, predicted
topics, annotator ratings ...) onto columns of the given tables, so every
query's work grows with the data. Derivations are plain column arithmetic
that the DuckDB oracle can repeat exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.taxonomy import LEVEL1, LEVEL2, LEVEL3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Raw label spellings used to exercise the cleaning rules
# (mixed case, null, 'Nan', every label of the replace chain).
RAW_TOPIC_VOCAB = [
    "sports", "POLITICS", "Teacher", "climate conditions", "Newspaper", "art", None, "Nan",
    "Science", "videogames", "music", "facebook", "food", "Photography", "movies", "Social media",
    "Education/academic", "news", "Weather", "books",
]


def _pick(vocab, idx_col):
    arr = F.array(*[F.lit(v).cast("string") for v in vocab])
    return F.element_at(arr, (F.pmod(idx_col, F.lit(len(vocab))) + 1).cast("int"))


def predicted_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw zero-shot predictions: (row_id, topic, topic_score, 3 levels).

    topic = vocabulary entry chosen by user_id, topic_score = value / 500
    capped at 1; the three level scores/labels come from value, event_id and
    user_id, so ties and exact thresholds occur.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    score = F.least(F.col("value") / F.lit(500.0), F.lit(1.0))
    return ev.select(
        F.col("event_id").alias("row_id"),
        _pick(RAW_TOPIC_VOCAB, F.col("user_id")).alias("topic"),
        score.alias("topic_score"),
        _pick(LEVEL1, F.col("user_id")).alias("best_first_level_topic"),
        score.alias("best_first_level_score"),
        _pick(LEVEL2, F.col("event_id")).alias("best_second_level_topic"),
        (F.pmod(F.col("event_id"), F.lit(100)) / F.lit(100.0)).alias("best_second_level_score"),
        _pick(LEVEL3, F.col("user_id") + F.col("event_id")).alias("best_third_level_topic"),
        (F.pmod(F.col("user_id"), F.lit(10)) / F.lit(10.0)).alias("best_third_level_score"),
    )


def tagged_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human tags for the same rows: vocabulary entry chosen by event type and user."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    return ev.select(F.col("event_id").alias("row_id"),
                     _pick(RAW_TOPIC_VOCAB, F.col("user_id") + F.col("event_id")).alias("topic"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer, chatbot): user turn + next assistant turn.

    The chatbot tag is derived from the conversation id (four bots).
    """
    from colloquy.operators.turns import question_answer_pairs

    conv = table(spark, sf_dir, "conversations")
    qa = question_answer_pairs(conv)
    return qa.withColumn("chatbot", F.concat(F.lit("bot"), F.pmod(F.col("conv_id"), F.lit(4)).cast("string")))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (tab, item_id, annotator, value) ratings, three rule-made annotators.

    Items are labelled documents; the sheet (tab) is the document's source.
    q: 1 + 4*quality + 2*toxic; s: 1 + 4*quality + 2*[n_chars > 2000];
    l: 5 for English else 1 + 4*quality, and missing for toxic documents.
    """
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = lab.join(doc, on="doc_id", how="inner")
    long = j.select(
        F.col("source").alias("tab"), F.col("doc_id").alias("item_id"),
        F.inline(F.array(
            F.struct(F.lit("q").alias("annotator"),
                     (1 + 4 * F.col("quality") + 2 * F.col("toxic")).alias("value")),
            F.struct(F.lit("s").alias("annotator"),
                     (1 + 4 * F.col("quality") + 2 * (F.col("n_chars") > 2000).cast("int")).alias("value")),
            F.struct(F.lit("l").alias("annotator"),
                     F.when(F.col("toxic") == 1, F.lit(None).cast("int"))
                     .when(F.col("lang") == "en", F.lit(5))
                     .otherwise(1 + 4 * F.col("quality")).alias("value")),
        )),
    )
    return long.where(F.col("value").isNotNull())
