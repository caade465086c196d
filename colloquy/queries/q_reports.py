"""Composed reports and the smaller preparation steps over the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.functions.text import parse_labels
from colloquy.operators import agreement as A
from colloquy.operators import clustering as C
from colloquy.operators import labels as L
from colloquy.operators import metrics
from colloquy.operators import scoring as S
from colloquy.operators import turns
from colloquy.operators import vectors as V
from colloquy.plans import evaluation
from colloquy.queries.q_agreement import RATINGS, _alpha_sql
from colloquy.queries.q_clustering import _ROUND_SQL, _emb, _one_round
from colloquy.queries.q_scoring import _PAIR_SRC
from colloquy.queries.sqlparts import bag_vectors_sql, keyword_scores
from colloquy.session import scratch_path
from colloquy.sources import io
from colloquy.sources.tables import ratings, table
from colloquy.sources.taxonomy import LANGUAGES, LEVEL_RENAME, TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3

LEVELS = {"first": TOPIC_LEVEL1, "second": TOPIC_LEVEL2, "third": TOPIC_LEVEL3}
_RENAME = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEVEL_RENAME.items())


@query("pair_topics_levels", f"""WITH {_PAIR_SRC},
{",".join(keyword_scores("pr", "uid", "sentence", t, prefix=p) for p, t in LEVELS.items())},
b AS (SELECT p.conv_id, p.turn, f.label AS l1, f.score AS s1, s.label AS l2, s.score AS s2, t.label AS l3, t.score AS s3,
             greatest(f.score, s.score, t.score) AS m
      FROM pr p JOIN first_top f ON f.id = p.uid JOIN second_top s ON s.id = p.uid JOIN third_top t ON t.id = p.uid),
c AS (SELECT *, CASE WHEN m < 0.6::DOUBLE THEN 'Other' WHEN s1 = m THEN l1 WHEN s2 = m THEN l2
                     WHEN l3 = 'photography' THEN 'Other' ELSE l3 END AS best FROM b)
SELECT conv_id, turn, l1 AS best_first_level_topic, l2 AS best_second_level_topic, l3 AS best_third_level_topic,
       round(m, 6) AS best_score, CASE best {_RENAME} ELSE best END AS topic FROM c""")
def pair_topics_levels(spark, sf_dir):
    """Adjacent turn pairs scored on three levels; the best level's label, renamed, is the topic."""
    out = turns.joined_turns(table(spark, sf_dir, "conversations"))
    for level, taxonomy in LEVELS.items():
        out = S.top1(out, "sentence", taxonomy, label_col=f"best_{level}_level_topic", score_col=f"best_{level}_level_score")
    best = L.best_of_levels(out, excluded_third="photography")
    score = F.greatest(*[F.col(f"best_{level}_level_score") for level in LEVELS])
    return out.select("conv_id", "turn", *[f"best_{level}_level_topic" for level in LEVELS],
                      rnd(score).alias("best_score"), L.level_rename(best).alias("topic"))


@query("agreement_report", f"""WITH nominal AS ({_alpha_sql("nominal", ["q", "s", "l"])}),
interval_ AS ({_alpha_sql("interval", ["q", "s", "l"])}),
{RATINGS},
w AS (SELECT tab, item_id, max(value) FILTER (WHERE annotator = 'q') AS q, max(value) FILTER (WHERE annotator = 's') AS s,
             max(value) FILTER (WHERE annotator = 'l') AS l FROM r GROUP BY tab, item_id),
o AS (SELECT avg((q = s)::INTEGER) AS a, avg((q = l)::INTEGER) AS b, avg((s = l)::INTEGER) AS c FROM w)
SELECT 'nominal' AS measure, alpha AS value FROM nominal UNION ALL SELECT 'interval', alpha FROM interval_
UNION ALL SELECT 'observed', round((a + b + c) / 3, 6) FROM o""")
def agreement_report(spark, sf_dir):
    """Nominal alpha, interval alpha and mean observed agreement of three annotators."""
    report = A.agreement_report(ratings(spark, sf_dir), ["tab", "item_id"], ["q", "s", "l"], tuple(range(1, 10)))
    return report.select("measure", rnd("value").alias("value"))


@query("metric_bundle", f"""
WITH {keyword_scores("documents", "doc_id", "text", LANGUAGES)},
p AS (SELECT d.lang AS truth, CASE WHEN t.score > 0.5::DOUBLE THEN t.label ELSE 'Other' END AS pred
      FROM k_top t JOIN documents d ON d.doc_id = t.id),
ticks AS (SELECT truth AS label, 1 AS t, 0 AS p, (truth IS NOT DISTINCT FROM pred)::INTEGER AS tp FROM p
          UNION ALL SELECT pred, 0, 1, 0 FROM p),
c AS (SELECT label, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM ticks GROUP BY label),
f AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code, t, p, tp, CASE WHEN p = 0 THEN 0.0 ELSE tp / p END AS precision,
             CASE WHEN t = 0 THEN 0.0 ELSE tp / t END AS recall, 2 * tp / (t + p) AS f1 FROM c)
SELECT label AS "row", code::INTEGER AS code, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       t::BIGINT AS support FROM f
UNION ALL SELECT 'f1_weighted', NULL, NULL, NULL, round(sum(f1 * t) / sum(t), 6), sum(t)::BIGINT FROM f
UNION ALL SELECT 'f1_micro', NULL, NULL, NULL, round(2 * sum(tp) / (sum(t) + sum(p)), 6), sum(t)::BIGINT FROM f
UNION ALL SELECT 'f1_macro', NULL, NULL, NULL, round(avg(f1), 6), sum(t)::BIGINT FROM f""")
def metric_bundle(spark, sf_dir):
    """Per-label metrics with label codes, and the three F1 averages, as one table."""
    p = evaluation.language_predictions(table(spark, sf_dir, "documents"))
    p = p.withColumn("pred", metrics.relabel_by_threshold(F.col("label"), F.col("score"), F.lit(0.5)))
    prf = metrics.per_class_prf(metrics.class_counts(p, "truth", "pred"))
    codes = L.label_codes(prf.select("label"), "label")
    bundle = metrics.metric_bundle(prf, codes)
    return bundle.select("row", "code", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("parsed_labels", """
WITH s AS (SELECT doc_id, string_split(lang || ' , ' || source || ',' || n_chars::VARCHAR, ',') AS parts FROM documents)
SELECT doc_id, unnest(range(len(parts)))::INTEGER AS pos, trim(unnest(parts)) AS label FROM s""")
def parsed_labels(spark, sf_dir):
    """Comma-separated label strings as one row per trimmed label."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.col("lang"), F.lit(" , "), F.col("source"), F.lit(","), F.col("n_chars").cast("string"))
    return docs.select("doc_id", F.posexplode(parse_labels(text)).alias("pos", "label"))


@query("ratings_as_int", """
SELECT doc_id, quality AS value FROM labels WHERE quality IS NOT NULL AND doc_id % 7 NOT IN (0, 1)""")
def ratings_as_int(spark, sf_dir):
    """Ratings kept as text, some not numbers: integers, the others dropped."""
    v = F.when(F.col("doc_id") % 7 == 0, F.lit("n/a")).when(F.col("doc_id") % 7 != 1, F.col("quality").cast("string"))
    return A.ratings_as_int(table(spark, sf_dir, "labels").select("doc_id", v.alias("value")))


@query("stacked_annotators", """
SELECT 'labels' AS tab, doc_id AS item_id, 'quality' AS annotator, quality AS value FROM labels WHERE quality IS NOT NULL
UNION ALL SELECT 'labels', doc_id, 'toxic', toxic FROM labels WHERE toxic IS NOT NULL""")
def stacked_annotators(spark, sf_dir):
    """A sheet with one column per annotator as long (tab, item, annotator, value) rows."""
    return A.wide_to_long(table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"], "labels")


@query("list_rows", """
SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS dim, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings""")
def list_rows(spark, sf_dir):
    """Parallel lists (dimension numbers, values) as one row per position."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    e = e.select("vec_id", F.sequence(F.lit(0), F.size("embedding") - 1).alias("dim"), F.col("embedding").alias("value"))
    return io.lists_to_rows(e, ["dim", "value"], ["vec_id"]).select("vec_id", "dim", rnd("value").alias("value"))


@query("mean_row_dropped", "SELECT label, vec_id FROM embeddings")
def mean_row_dropped(spark, sf_dir):
    """Group mean rows appended to the vectors and dropped again: the rows of before."""
    u = V.append_mean_row(_emb(spark, sf_dir), ["label"], "vec_id", "vec")
    return u.where(~F.col("is_mean")).select("label", "vec_id")


@query("typical_answers_mean", f"""WITH {_ROUND_SQL},
md AS (SELECT a.label, a.cluster, ev.dim, avg(ev.x) AS cx FROM asg a JOIN ev ON ev.vec_id = a.vec_id
       GROUP BY a.label, a.cluster, ev.dim),
d2 AS (SELECT a.label, a.cluster, a.vec_id, sum((ev.x - md.cx) * (ev.x - md.cx)) AS d2
       FROM asg a JOIN ev ON ev.vec_id = a.vec_id JOIN md ON md.label = a.label AND md.cluster = a.cluster AND md.dim = ev.dim
       GROUP BY a.label, a.cluster, a.vec_id)
SELECT label, cluster::INTEGER AS cluster, vec_id AS medoid_vec_id, round(d2, 6) AS d2 FROM d2
QUALIFY row_number() OVER (PARTITION BY label, cluster ORDER BY round(d2, 9), vec_id) = 1""")
def typical_answers_mean(spark, sf_dir):
    """Per (group, cluster): the member nearest the cluster's mean."""
    t = C.typical_members(_one_round(spark, sf_dir), ["label"], "vec_id", "vec", "cluster", "mean")
    return t.select("label", F.col("cluster").cast("int").alias("cluster"), "medoid_vec_id", rnd("d2").alias("d2"))


#: Gain of each scorer: how much evidence a share of keywords is.
SCORERS = {"keyword": 60.0, "cautious": 15.0}


@query("scores_by_scorer", "WITH " + ", ".join(
    keyword_scores("documents", "doc_id", "text", LANGUAGES, gain=gain, prefix=f"k{i}") for i, gain in enumerate(SCORERS.values()))
    + " UNION ALL ".join(f"\nSELECT id AS doc_id, '{name}' AS scorer, label, round(score, 6) AS score FROM k{i}_top"
                         for i, name in enumerate(SCORERS)))
def scores_by_scorer(spark, sf_dir):
    """Predictions of two scorers written as CSV, one folder per scorer, and read back with the scorer's name."""
    docs = table(spark, sf_dir, "documents")
    predicted = [evaluation.language_predictions(docs, scorer=S.KeywordScorer(gain=gain)).select("doc_id", "label", "score")
                 .withColumn("scorer", F.lit(name)) for name, gain in SCORERS.items()]
    path = scratch_path(spark, f"scorer-{uuid.uuid4().hex}")
    io.write_csv(reduce(DataFrame.unionByName, predicted), path, partition_by=["scorer"])
    back = io.read_csv(spark, path, "doc_id long, label string, score double, scorer string", multi_line=False)
    return back.select("doc_id", "scorer", "label", rnd("score").alias("score"))


@query("point_table", f"""WITH {bag_vectors_sql("documents", "doc_id", "text", 64, 2)}
SELECT d.source AS chatbot, d.doc_id, round(v.vec[1], 6) AS x, round(v.vec[2], 6) AS y, d.text AS answer, 0 AS is_mean
FROM documents d JOIN bag_v v ON v.id = d.doc_id
UNION ALL SELECT d.source, NULL, round(avg(v.vec[1]), 6), round(avg(v.vec[2]), 6), 'MEAN EMBEDDING', 1
FROM documents d JOIN bag_v v ON v.id = d.doc_id GROUP BY d.source""")
def point_table(spark, sf_dir):
    """Answers as points: chatbot, two coordinates of the text's vector, the text itself, and a row for each chatbot's mean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    p = V.project(V.hash_embed(docs, "text", 64, "vec"), "vec", 64, 2, "vec")
    means = V.mean_vectors(p, ["source"], "vec", "vec").select(
        "source", F.lit(None).cast("long").alias("doc_id"), F.lit("MEAN EMBEDDING").alias("text"), "vec", F.lit(1).alias("is_mean"))
    p = p.select("source", "doc_id", "text", "vec", F.lit(0).alias("is_mean")).unionByName(means)
    return p.select(F.col("source").alias("chatbot"), "doc_id", rnd(F.col("vec")[0]).alias("x"),
                    rnd(F.col("vec")[1]).alias("y"), F.col("text").alias("answer"), "is_mean")
