"""Label evaluation queries: the flagship language sweep and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.operators import metrics
from colloquy.plans import evaluation
from colloquy.queries.sqlparts import keyword_scores
from colloquy.sources.taxonomy import LANGUAGES
from colloquy.sources.tables import table

_PRED = f"""
WITH {keyword_scores("documents", "doc_id", "text", LANGUAGES)},
pred AS (SELECT t.id AS doc_id, d.lang AS truth, t.label, t.score FROM k_top t JOIN documents d ON d.doc_id = t.id),
th AS (SELECT t::DOUBLE / 10.0::DOUBLE AS threshold FROM range(2, 10) r(t)),
labs AS (SELECT label FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('Other')) v(label)
         UNION SELECT DISTINCT lang FROM documents),
rel AS (SELECT th.threshold, p.truth, CASE WHEN p.score > th.threshold THEN p.label ELSE 'Other' END AS pred
        FROM pred p CROSS JOIN th),
ticks AS (
  SELECT threshold, truth AS label, 1 AS t, 0 AS p, CASE WHEN truth IS NOT DISTINCT FROM pred THEN 1 ELSE 0 END AS tp
  FROM rel
  UNION ALL SELECT threshold, pred, 0, 1, 0 FROM rel
  UNION ALL SELECT th.threshold, labs.label, 0, 0, 0 FROM th CROSS JOIN labs),
cnt AS (SELECT threshold, label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS n_pred, sum(tp)::BIGINT AS tp
        FROM ticks GROUP BY threshold, label),
prf AS (SELECT threshold, label, support, n_pred, tp,
   CASE WHEN n_pred = 0 THEN 0.0 ELSE tp::DOUBLE / n_pred END AS precision,
   CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
   CASE WHEN support + n_pred = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (support + n_pred) END AS f1
   FROM cnt)"""


def _prf(spark, sf_dir, tenths=range(2, 10)):
    return evaluation.language_sweep(table(spark, sf_dir, "documents"), tenths=tenths)


@query("threshold_sweep", _PRED + """
SELECT threshold, label, support, n_pred, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM prf""")
def threshold_sweep(spark, sf_dir):
    prf = _prf(spark, sf_dir)
    return prf.select("threshold", "label", "support", "n_pred", "tp", rnd("precision").alias("precision"),
                      rnd("recall").alias("recall"), rnd("f1").alias("f1"))


@query("language_top1", f"""
WITH {keyword_scores("documents", "doc_id", "text", LANGUAGES)}
SELECT d.doc_id, d.lang AS truth, t.label, round(t.score, 6) AS score
FROM k_top t JOIN documents d ON d.doc_id = t.id""")
def language_top1(spark, sf_dir):
    p = evaluation.language_predictions(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "truth", "label", rnd("score").alias("score"))


@query("confusion", f"""
WITH {keyword_scores("documents", "doc_id", "text", LANGUAGES)}
SELECT d.lang AS true_label, CASE WHEN t.score > 0.9::DOUBLE THEN t.label ELSE 'Other' END AS pred_label,
       count(*)::BIGINT AS n
FROM k_top t JOIN documents d ON d.doc_id = t.id GROUP BY 1, 2""")
def confusion(spark, sf_dir):
    p = evaluation.language_predictions(table(spark, sf_dir, "documents"))
    p = p.withColumn("pred", metrics.relabel_by_threshold(F.col("label"), F.col("score"), F.lit(0.9)))
    return metrics.confusion(p, "truth", "pred")


@query("per_class_prf", _PRED + """
SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM prf WHERE threshold = 0.9::DOUBLE""")
def per_class_prf(spark, sf_dir):
    prf = _prf(spark, sf_dir, tenths=[9])
    return prf.select("label", "support", rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                      rnd("f1").alias("f1"))


_AVG_SQL = """
SELECT threshold,
  round(CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END, 6) AS f1_weighted,
  round(CASE WHEN sum(tp) + 0.5 * ((sum(n_pred) - sum(tp)) + (sum(support) - sum(tp))) = 0 THEN 0.0
        ELSE sum(tp)::DOUBLE / (sum(tp) + 0.5::DOUBLE * ((sum(n_pred) - sum(tp)) + (sum(support) - sum(tp))))
        END, 6) AS f1_micro,
  round(avg(f1), 6) AS f1_macro
FROM prf GROUP BY threshold"""


@query("f1_averages", _PRED + _AVG_SQL)
def f1_averages(spark, sf_dir):
    avg = metrics.f1_averages(_prf(spark, sf_dir), ["threshold"])
    return avg.select("threshold", *[rnd(c).alias(c) for c in ("f1_weighted", "f1_micro", "f1_macro")])


@query("classification_report", _PRED + """
, rep AS (
  SELECT label AS "row", precision, recall, f1, support FROM prf WHERE threshold = 0.9::DOUBLE
  UNION ALL SELECT 'accuracy', NULL, NULL,
     CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(tp)::DOUBLE / sum(support) END, sum(support)::BIGINT
     FROM prf WHERE threshold = 0.9::DOUBLE
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT
     FROM prf WHERE threshold = 0.9::DOUBLE
  UNION ALL SELECT 'weighted avg',
     sum(precision * support) / sum(support), sum(recall * support) / sum(support),
     sum(f1 * support) / sum(support), sum(support)::BIGINT FROM prf WHERE threshold = 0.9::DOUBLE)
SELECT "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""")
def classification_report(spark, sf_dir):
    rep = metrics.classification_report(_prf(spark, sf_dir, tenths=[9]))
    return rep.select("row", rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                      rnd("f1").alias("f1"), "support")


_PIVOT_COLS = [f"{t / 10.0}" for t in range(2, 10)]


@query("threshold_sweep_pivot", _PRED + """
SELECT label, """ + ", ".join(
    f"round(max(f1) FILTER (WHERE threshold = {c}::DOUBLE), 6) AS \"{c}\"" for c in _PIVOT_COLS) + """
FROM prf GROUP BY label""")
def threshold_sweep_pivot(spark, sf_dir):
    piv = metrics.pivot_metric(_prf(spark, sf_dir), "f1")
    return piv.select("label", *[rnd(F.col(f"`{c}`")).alias(c) for c in _PIVOT_COLS])


@query("sweep_transposed", _PRED + """
SELECT threshold AS "row", """ + ", ".join(
    f"round(max(f1) FILTER (WHERE label = '{lab}'), 6) AS \"{lab}\"" for lab in ["Other", "de", "en", "es", "fr"])
    + """ FROM prf GROUP BY threshold""")
def sweep_transposed(spark, sf_dir):
    """The label x threshold F1 table turned so thresholds are rows."""
    piv = metrics.pivot_metric(_prf(spark, sf_dir), "f1")
    t = metrics.transpose(piv, "label", _PIVOT_COLS, row_name="row")
    labels = [c for c in t.columns if c != "row"]
    return t.select(F.col("row").cast("double").alias("row"), *[rnd(F.col(f"`{c}`")).alias(c) for c in labels])


@query("absent_labels", f"""
WITH {keyword_scores("documents", "doc_id", "text", LANGUAGES)},
present AS (SELECT lang AS label FROM documents UNION SELECT label FROM k_top)
SELECT label FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('Other'), ('it')) v(label)
WHERE label NOT IN (SELECT label FROM present WHERE label IS NOT NULL)""")
def absent_labels(spark, sf_dir):
    """Labels of the label list (4 languages, 'Other', 'it') absent from truth and prediction."""
    p = evaluation.language_predictions(table(spark, sf_dir, "documents"))
    labels = spark.createDataFrame([(x,) for x in ["en", "fr", "de", "es", "Other", "it"]], "label string")
    return metrics.absent_labels(p, "truth", "label", labels)
