"""Topics fitted over ``documents`` within each source, their terms, representatives, and the topics of all benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.operators import topic_fit as TF
from colloquy.operators import topics as TP
from colloquy.operators import vectors as V
from colloquy.queries.sqlparts import TOKENS, unit_vectors_sql
from colloquy.session import stored
from colloquy.sources.tables import table

K, BAR, MIN_SIZE, DIVERSITY = 4, 0.88, 3, 0.5
CANDIDATES, TERMS = 30, 5


_FIT_SQL = f"""{unit_vectors_sql("f", "documents", "doc_id", "text")},
fp AS (SELECT d.source AS g, d.doc_id AS id, f_v.v FROM documents d JOIN f_v ON f_v.doc_id = d.doc_id),
fs AS (SELECT a.g, a.id, b.id AS other, round(list_dot_product(a.v, b.v), {TF.PLACES}) AS s FROM fp a JOIN fp b ON b.g = a.g AND b.id <> a.id),
nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY s DESC, other) AS r FROM fs QUALIFY r <= {K}),
strong AS MATERIALIZED (SELECT * FROM nn WHERE s >= {BAR}::DOUBLE),
dense AS MATERIALIZED (SELECT g, id FROM strong GROUP BY g, id HAVING count(*) = {K}),
de AS (SELECT s.g, s.id AS u, s.other AS x FROM strong s JOIN dense a ON a.g = s.g AND a.id = s.id
       JOIN dense b ON b.g = s.g AND b.id = s.other),
both_ways AS MATERIALIZED (SELECT * FROM de UNION SELECT g, x, u FROM de),
reach(g, id, r) AS (SELECT g, id, id FROM dense UNION SELECT h.g, h.id, e.x FROM reach h JOIN both_ways e ON e.g = h.g AND e.u = h.r),
region AS (SELECT g, id, min(r) AS c FROM reach GROUP BY g, id),
bord AS (SELECT s.g, s.id, region.c FROM strong s JOIN region ON region.g = s.g AND region.id = s.other
         WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.g = s.g AND d.id = s.id)
         QUALIFY row_number() OVER (PARTITION BY s.g, s.id ORDER BY s.r) = 1),
placed AS (SELECT * FROM region UNION ALL SELECT * FROM bord),
num AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, min(id)) - 1 AS topic FROM placed
        GROUP BY g, c HAVING count(*) >= {MIN_SIZE}),
fit AS MATERIALIZED (SELECT fp.g AS source, fp.id AS doc_id, coalesce(num.topic, -1)::INTEGER AS topic FROM fp
        LEFT JOIN placed ON placed.g = fp.g AND placed.id = fp.id LEFT JOIN num ON num.g = placed.g AND num.c = placed.c)"""


def _fitted(spark, sf_dir):
    """Documents with their vectors and fitted topics (null-free name ``source/topic``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    vecs = stored(V.hash_embed(docs, "text", 64, "vec"), "vectors")
    fit = TF.fit_topics(vecs, ["source"], "doc_id", "vec", K, BAR, MIN_SIZE)
    return vecs, fit


@query("fitted_topics", f"WITH RECURSIVE {_FIT_SQL} SELECT source, doc_id, topic FROM fit")
def fitted_topics(spark, sf_dir):
    """Topic of every document: connected dense regions of its source's neighbour graph, -1 for outliers."""
    return _fitted(spark, sf_dir)[1]


def _named(spark, sf_dir):
    vecs, fit = _fitted(spark, sf_dir)
    name = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("topic").cast("string"))
    kept = fit.where("topic >= 0").select("doc_id", name.alias("name"))
    return stored(vecs.join(kept, "doc_id").select("doc_id", "name", "text", "vec"), "topic-documents")


_NAMED_SQL = f"""{_FIT_SQL},
named AS MATERIALIZED (SELECT d.doc_id, coalesce(fit.source, '') || '/' || fit.topic AS name, d.text, f_v.v FROM fit
    JOIN documents d ON d.doc_id = fit.doc_id JOIN f_v ON f_v.doc_id = d.doc_id WHERE fit.topic >= 0)"""


def _trigrams(df):
    """Terms embedded by their letter trigrams (a term of one or two letters is its own)."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("term") - 2)), lambda i: F.substring("term", i, F.lit(3)))
    return V.hash_embed(df.withColumn("_grams", F.array_join(grams, " ")), "_grams", 64, "_vec").drop("_grams")


@query("fitted_topic_terms", f"""WITH RECURSIVE {_NAMED_SQL},
tt AS (SELECT name, unnest({TOKENS.format(text='text')}) AS term FROM named),
tf AS MATERIALIZED (SELECT name, term, count(*) AS tf FROM tt WHERE length(term) >= 2 GROUP BY name, term),
tot AS (SELECT name, sum(tf) AS total FROM tf GROUP BY name),
ff AS (SELECT term, sum(tf) AS f FROM tf GROUP BY term),
wt AS (SELECT tf.name, tf.term, (tf.tf::DOUBLE / tot.total) * ln(1.0 + (SELECT floor(avg(total)) FROM tot) / ff.f) AS weight
       FROM tf JOIN ff ON ff.term = tf.term JOIN tot ON tot.name = tf.name),
cand AS MATERIALIZED (SELECT name, term, weight / max(weight) OVER (PARTITION BY name) AS rel FROM wt
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY weight DESC, term) <= {CANDIDATES}),
grams AS (SELECT DISTINCT term, array_to_string([substr(term, i, 3) FOR i IN range(1, greatest(1, length(term) - 2) + 1)], ' ') AS text FROM cand),
{unit_vectors_sql("g", "grams", "term", "text")},
sims AS MATERIALIZED (SELECT a.name, a.term AS a, b.term AS b, list_dot_product(x.v, y.v) AS s FROM cand a JOIN cand b ON b.name = a.name
        JOIN g_v x ON x.term = a.term JOIN g_v y ON y.term = b.term),
firsts AS (SELECT name, min({{'neg': -round(rel, {TF.PLACES}), 'term': term}}) AS best FROM cand GROUP BY name),
mmr(name, taken, score) AS (SELECT name, [best.term], -best.neg FROM firsts
    UNION ALL SELECT name, list_append(any_value(taken), min({{'neg': -score, 'term': term}}).term), max(score) FROM (
        SELECT m.name, any_value(m.taken) AS taken, c.term,
               round({1 - DIVERSITY}::DOUBLE * any_value(c.rel) - {DIVERSITY}::DOUBLE * max(s.s), {TF.PLACES}) AS score
        FROM mmr m JOIN cand c ON c.name = m.name AND NOT list_contains(m.taken, c.term)
        JOIN sims s ON s.name = m.name AND s.a = c.term AND list_contains(m.taken, s.b)
        WHERE len(m.taken) < {TERMS} GROUP BY m.name, c.term) x GROUP BY name)
SELECT name, taken[len(taken)] AS term, round(score, 6) AS score, len(taken)::INTEGER AS rank FROM mmr""")
def fitted_topic_terms(spark, sf_dir):
    """Five terms of each fitted topic, by weight and diversity (0.5)."""
    weights = TP.class_tfidf(_named(spark, sf_dir), "name", "text")
    t = TF.diverse_terms(weights, "name", _trigrams, TERMS, DIVERSITY, CANDIDATES)
    return t.select("name", "term", rnd("score").alias("score"), "rank")


_TV_SQL = """tdim AS (SELECT name, unnest(range(64)) AS dim, unnest(v) AS x FROM named),
tv AS (SELECT name, list(x ORDER BY dim) AS v FROM (SELECT name, dim, avg(x) AS x FROM tdim GROUP BY name, dim) m GROUP BY name)"""


@query("fitted_representatives", f"""WITH RECURSIVE {_NAMED_SQL}, {_TV_SQL},
sim AS (SELECT n.name, n.doc_id, list_cosine_similarity(n.v, tv.v) AS s FROM named n JOIN tv ON tv.name = n.name)
SELECT name, doc_id, round(s, 6) AS similarity, (row_number() OVER (PARTITION BY name ORDER BY round(s, 9) DESC, doc_id))::INTEGER AS rank
FROM sim QUALIFY rank <= 3""")
def fitted_representatives(spark, sf_dir):
    """Three documents nearest to the mean vector of each fitted topic."""
    docs = _named(spark, sf_dir)
    r = TP.representatives(docs, TP.topic_vectors(docs, "name", "vec"), "name", "doc_id", "vec", 3)
    return r.select("name", "doc_id", rnd("similarity").alias("similarity"), F.col("rank").cast("int").alias("rank"))


@query("topics_of_benchmark", f"""WITH RECURSIVE {_NAMED_SQL}, {_TV_SQL},
{unit_vectors_sql("q", "benchmark", "item_id", "text")},
sim AS (SELECT q.item_id, tv.name, coalesce(round(CASE WHEN list_dot_product(q.v, q.v) = 0 THEN 0.0
               ELSE list_cosine_similarity(q.v, tv.v) END, {TF.PLACES}), 0.0) AS s FROM q_v q CROSS JOIN tv)
SELECT item_id, name, round(s, 6) AS similarity, (row_number() OVER (PARTITION BY item_id ORDER BY s DESC, name))::INTEGER AS rank
FROM sim QUALIFY rank <= 3""")
def topics_of_benchmark(spark, sf_dir):
    """The three fitted topics nearest to each benchmark text."""
    tv = TP.topic_vectors(_named(spark, sf_dir), "name", "vec")
    texts = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = TF.topics_of_texts(tv, V.hash_embed(texts, "text", 64, "query_vec"), "name", "item_id", n=3)
    return found.select("item_id", "name", rnd("similarity").alias("similarity"), F.col("rank").cast("int").alias("rank"))
