"""Topic-model operators on assigned topics: term weights, find, representatives.

Topics here are given (a column); the topic "model" is its set of per-topic
term weights (class-based TF-IDF) and per-topic mean vectors.

Class-based TF-IDF: with tf(t, c) the count of term t in all texts of
topic c, A the (integer) mean number of words per topic and f(t) the count
of t over all topics, weight(t, c) = tf(t, c) / sum_t tf(t, c) * ln(1 + A / f(t)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import tokens as tokens_col
from colloquy.functions.vectors import cosine
from colloquy.operators import vectors as V
from colloquy.operators.joins import join_small


def term_counts(docs: DataFrame, topic_col: str, text_col: str, min_len: int = 2) -> DataFrame:
    """(topic, term, tf): token counts per topic (partial aggregation per task)."""
    toks = docs.select(topic_col, F.explode(tokens_col(text_col)).alias("term"))
    toks = toks.where(F.length("term") >= min_len)
    return toks.groupBy(topic_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def class_tfidf(docs: DataFrame, topic_col: str, text_col: str, min_len: int = 2) -> DataFrame:
    """(topic, term, weight) for every term of every topic."""
    tf = term_counts(docs, topic_col, text_col, min_len).persist()
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    totals = tf.groupBy(topic_col).agg(F.sum("tf").alias("total"))
    totals = totals.withColumn("A", totals.agg(F.floor(F.avg("total"))).scalar())
    j = tf.join(f, on="term")
    j = join_small(j, totals, on=[topic_col])
    w = (F.col("tf") / F.col("total")) * F.log(F.lit(1.0) + F.col("A") / F.col("f"))
    return j.select(topic_col, "term", w.alias("weight"))


def top_terms(weights: DataFrame, topic_col: str, n: int = 10) -> DataFrame:
    """The n best terms per topic (ties by term); a top-n report."""
    w = Window.partitionBy(topic_col).orderBy(F.col("weight").desc(), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def topic_vectors(vecs: DataFrame, topic_col: str, vec_col: str, out: str = "topic_vec") -> DataFrame:
    """Mean vector per topic."""
    return V.mean_vectors(vecs, [topic_col], vec_col, out)


def find_topics(topic_vecs: DataFrame, queries: DataFrame, topic_col: str, vec_col: str = "topic_vec",
                query_vec: str = "query_vec", n: int = 10) -> DataFrame:
    """Top-n topics by cosine to one query vector (ties by topic); a table of queries: ``topic_fit.topics_of_texts``.

    ``queries`` has one row, which goes into the plan as a scalar subquery; each task keeps n rows.
    """
    j = topic_vecs.withColumn("_asked", queries.select(query_vec).scalar()).withColumn("similarity", cosine("_asked", vec_col))
    top = j.orderBy(F.col("similarity").desc(), F.col(topic_col)).limit(n)
    w = Window.orderBy(F.col("similarity").desc(), F.col(topic_col))
    return top.withColumn("rank", F.row_number().over(w)).select(topic_col, "similarity", "rank")


def representatives(vecs: DataFrame, topic_vecs: DataFrame, topic_col: str, id_col: str, vec_col: str,
                    n: int = 3, tie_places: int = 9) -> DataFrame:
    """The n items nearest (cosine) to their topic's mean vector, per topic.

    Similarities equal to ``tie_places`` decimals are ties (identical texts
    must tie whatever the summation order) and go to the smaller id.
    """
    j = join_small(vecs, topic_vecs, on=[topic_col])
    j = j.withColumn("similarity", cosine(vec_col, "topic_vec"))
    w = Window.partitionBy(topic_col).orderBy(F.round("similarity", tie_places).desc(), F.col(id_col))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select(topic_col, id_col, vec_col, "similarity", "rank")
