"""Topic queries over ``documents`` with ``lang`` as the assigned topic."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.functions.text import question_template
from colloquy.functions.vectors import cosine
from colloquy.operators import topics as TP
from colloquy.operators import vectors as V
from colloquy.queries.q_vectors import HASH_SQL
from colloquy.queries.sqlparts import TOKENS
from colloquy.sources.tables import table

SUBJECT = "the"  # subject word of the find / match queries


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


@query("topic_terms", f"""WITH t AS (SELECT lang, unnest({TOKENS.format(text='text')}) AS term FROM documents),
tf AS (SELECT lang, term, count(*) AS tf FROM t WHERE length(term) >= 2 GROUP BY lang, term),
f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY term),
tot AS (SELECT lang, sum(tf) AS total FROM tf GROUP BY lang),
a AS (SELECT floor(avg(total)) AS A FROM tot),
w AS (SELECT tf.lang, tf.term, (tf.tf::DOUBLE / tot.total) * ln(1.0 + a.A / f.f) AS weight
      FROM tf JOIN f ON f.term = tf.term JOIN tot ON tot.lang = tf.lang CROSS JOIN a)
SELECT lang, term, round(weight, 6) AS weight,
       (row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term))::INTEGER AS rank
FROM w QUALIFY rank <= 10""")
def topic_terms(spark, sf_dir):
    """Ten best class-based TF-IDF terms per topic."""
    w = TP.class_tfidf(_docs(spark, sf_dir), "lang", "text")
    t = TP.top_terms(w, "lang", 10)
    return t.select("lang", "term", rnd("weight").alias("weight"), F.col("rank").cast("int").alias("rank"))


_TOPIC_VEC = f"""{HASH_SQL},
ndoc AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
tv AS (SELECT d.lang, hv.dim, sum(hv.value) / max(ndoc.n) AS x FROM hv JOIN documents d ON d.doc_id = hv.doc_id
       JOIN ndoc ON ndoc.lang = d.lang GROUP BY d.lang, hv.dim),
tn AS (SELECT lang, sqrt(sum(x * x)) AS nx FROM tv GROUP BY lang),
qb AS (SELECT (('0x' || substr(md5('{SUBJECT}'), 1, 8))::BIGINT % 64)::INTEGER AS dim),
ft AS (SELECT tn.lang, coalesce(max(tv.x) FILTER (WHERE tv.dim = qb.dim), 0.0) / tn.nx AS similarity
       FROM tn JOIN tv ON tv.lang = tn.lang CROSS JOIN qb GROUP BY tn.lang, tn.nx)"""


def _topic_model(spark, sf_dir):
    docs = V.hash_embed(_docs(spark, sf_dir), "text", 64, "vec")
    return docs, TP.topic_vectors(docs, "lang", "vec")


def _query_vec(spark, word, kind="no-fill"):
    q = spark.range(1).select(question_template(kind, word).alias("q"))
    return V.hash_embed(q, "q", 64, "query_vec")


@query("find_topics", f"""WITH {_TOPIC_VEC}
SELECT lang, round(similarity, 6) AS similarity,
       (row_number() OVER (ORDER BY similarity DESC, lang))::INTEGER AS rank FROM ft QUALIFY rank <= 10""")
def find_topics(spark, sf_dir):
    """Topics nearest to a subject word (hashed vectors; topic vector = mean)."""
    _, tv = _topic_model(spark, sf_dir)
    f = TP.find_topics(tv, _query_vec(spark, SUBJECT), "lang", n=10)
    return f.select("lang", rnd("similarity").alias("similarity"), F.col("rank").cast("int").alias("rank"))


_REPS = f"""{_TOPIC_VEC},
ds AS (SELECT hv.doc_id, d.lang, sum(hv.value * tv.x) / max(tn.nx) AS similarity
       FROM hv JOIN documents d ON d.doc_id = hv.doc_id JOIN tv ON tv.lang = d.lang AND tv.dim = hv.dim
       JOIN tn ON tn.lang = d.lang GROUP BY hv.doc_id, d.lang),
reps AS (SELECT lang, doc_id, similarity, (row_number() OVER (PARTITION BY lang ORDER BY round(similarity, 9) DESC, doc_id))::INTEGER AS rank
         FROM ds QUALIFY rank <= 3)"""


@query("representative_items", f"""WITH {_REPS}
SELECT lang, doc_id, round(similarity, 6) AS similarity, rank FROM reps""")
def representative_items(spark, sf_dir):
    """Three documents nearest to their topic's mean vector, per topic."""
    docs, tv = _topic_model(spark, sf_dir)
    r = TP.representatives(docs, tv, "lang", "doc_id", "vec", 3)
    return r.select("lang", "doc_id", rnd("similarity").alias("similarity"), F.col("rank").cast("int").alias("rank"))


@query("topic_has_match", f"""WITH {_REPS},
rs AS (SELECT r.lang, r.doc_id, coalesce(max(hv.value) FILTER (WHERE hv.dim = qb.dim), 0.0) AS cos
       FROM reps r JOIN hv ON hv.doc_id = r.doc_id CROSS JOIN qb GROUP BY r.lang, r.doc_id)
SELECT DISTINCT lang FROM rs WHERE cos >= 0.5""")
def topic_has_match(spark, sf_dir):
    """Topics (among the nearest ten) with a representative document whose cosine
    to the question vector is at least the bar (0.5 with hashed vectors)."""
    docs, tv = _topic_model(spark, sf_dir)
    found = TP.find_topics(tv, _query_vec(spark, SUBJECT), "lang", n=10).select("lang")
    reps = TP.representatives(docs, tv, "lang", "doc_id", "vec", 3)
    asked = reps.withColumn("_asked", _query_vec(spark, SUBJECT).select("query_vec").scalar())
    hits = asked.where(cosine("vec", "_asked") >= 0.5).select("lang")
    return found.join(hits, on="lang", how="left_semi")

