"""Label cleaning queries over events-derived predictions and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.functions.text import capitalize_first
from colloquy.operators import labels as L
from colloquy.operators import metrics
from colloquy.queries.sqlparts import q
from colloquy.sources.tables import RAW_TOPIC_VOCAB, predicted_topics, tagged_topics
from colloquy.sources.taxonomy import LEVEL1, LEVEL2, LEVEL3, LEVEL_RENAME


def _list(vals):
    return "[" + ", ".join("NULL" if v is None else q(v) for v in vals) + "]"


def _pick(vals, idx):
    return f"{_list(vals)}[({idx}) % {len(vals)} + 1]"


PRED = f"""pred AS (
  SELECT event_id AS row_id, {_pick(RAW_TOPIC_VOCAB, 'user_id')} AS topic,
         least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS topic_score,
         {_pick(LEVEL1, 'user_id')} AS best_first_level_topic,
         least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS best_first_level_score,
         {_pick(LEVEL2, 'event_id')} AS best_second_level_topic,
         (event_id % 100) / 100.0::DOUBLE AS best_second_level_score,
         {_pick(LEVEL3, 'user_id + event_id')} AS best_third_level_topic,
         (user_id % 10) / 10.0::DOUBLE AS best_third_level_score
  FROM events)"""
TAG = f"""tag AS (SELECT event_id AS row_id, {_pick(RAW_TOPIC_VOCAB, 'user_id + event_id')} AS topic FROM events)"""


def _cap(x):
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def _sub_chain(x, rules):
    for old, new in rules:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def _pred_clean_sql(x="topic", s="topic_score"):
    c = f"coalesce({_cap(x)}, 'Other')"
    c = _sub_chain(c, L.PREDICTED_RULES_BEFORE_SCORE)
    c = f"(CASE WHEN {s} < 0.1::DOUBLE THEN 'Other' ELSE {c} END)"
    return _sub_chain(c, L.MERGE_RULES)


def _tag_clean_sql(x="topic"):
    return _sub_chain(f"coalesce({_cap(x)}, 'Other')", L.MERGE_RULES)


@query("label_capitalize", f"WITH {PRED} SELECT row_id, topic AS raw_topic, {_cap('topic')} AS topic FROM pred")
def label_capitalize(spark, sf_dir):
    p = predicted_topics(spark, sf_dir)
    return p.select("row_id", F.col("topic").alias("raw_topic"), capitalize_first("topic").alias("topic"))


@query("label_replace_chain", f"WITH {PRED} SELECT row_id, {_pred_clean_sql()} AS topic FROM pred")
def label_replace_chain(spark, sf_dir):
    p = L.clean_predicted(predicted_topics(spark, sf_dir), mode="substring")
    return p.select("row_id", "topic")


def _whole_sql():
    c = f"coalesce({_cap('topic')}, 'Other')"
    net1 = {}
    for old, _ in L.PREDICTED_RULES_BEFORE_SCORE:
        cur = old
        for o, n in L.PREDICTED_RULES_BEFORE_SCORE:
            cur = n if cur == o else cur
        net1[old] = cur
    c = "CASE " + " ".join(f"WHEN {c} = {q(k)} THEN {q(v)}" for k, v in net1.items()) + f" ELSE {c} END"
    c = f"(CASE WHEN topic_score < 0.1::DOUBLE THEN 'Other' ELSE {c} END)"
    net2 = {}
    for old, _ in L.MERGE_RULES:
        cur = old
        for o, n in L.MERGE_RULES:
            cur = n if cur == o else cur
        net2[old] = cur
    return "CASE " + " ".join(f"WHEN {c} = {q(k)} THEN {q(v)}" for k, v in net2.items()) + f" ELSE {c} END"


@query("label_replace_whole", f"WITH {PRED} SELECT row_id, {_whole_sql()} AS topic FROM pred")
def label_replace_whole(spark, sf_dir):
    p = L.clean_predicted(predicted_topics(spark, sf_dir), mode="label")
    return p.select("row_id", "topic")


@query("tagged_clean", f"WITH {TAG} SELECT row_id, {_tag_clean_sql()} AS topic FROM tag")
def tagged_clean(spark, sf_dir):
    return L.clean_tagged(tagged_topics(spark, sf_dir), mode="substring").select("row_id", "topic")


def _rename_sql(x):
    return "CASE " + " ".join(f"WHEN {x} = {q(k)} THEN {q(v)}" for k, v in LEVEL_RENAME.items()) + f" ELSE {x} END"


@query("label_remap", f"""WITH {PRED}
SELECT row_id, {_rename_sql('best_first_level_topic')} AS first_level,
       {_rename_sql('best_second_level_topic')} AS second_level,
       {_rename_sql('best_third_level_topic')} AS third_level FROM pred""")
def label_remap(spark, sf_dir):
    p = predicted_topics(spark, sf_dir)
    return p.select("row_id", L.level_rename("best_first_level_topic").alias("first_level"),
                    L.level_rename("best_second_level_topic").alias("second_level"),
                    L.level_rename("best_third_level_topic").alias("third_level"))


@query("low_score_other", f"""WITH {PRED}
SELECT row_id, CASE WHEN topic_score < 0.1::DOUBLE THEN 'Other' ELSE topic END AS topic FROM pred""")
def low_score_other(spark, sf_dir):
    p = predicted_topics(spark, sf_dir)
    return p.select("row_id", L.low_score_other("topic", "topic_score").alias("topic"))


@query("threshold_relabel", f"""WITH {PRED}
SELECT row_id, CASE WHEN topic_score > 0.6::DOUBLE THEN topic ELSE 'Other' END AS topic FROM pred""")
def threshold_relabel(spark, sf_dir):
    p = predicted_topics(spark, sf_dir)
    return p.select("row_id", L.threshold_relabel("topic", "topic_score", 0.6).alias("topic"))


@query("best_of_levels", f"""WITH {PRED},
m AS (SELECT *, greatest(best_first_level_score, best_second_level_score, best_third_level_score) AS mx FROM pred)
SELECT row_id, CASE
  WHEN best_first_level_score = mx AND mx >= 0.6::DOUBLE THEN best_first_level_topic
  WHEN best_second_level_score = mx AND mx >= 0.6::DOUBLE THEN best_second_level_topic
  WHEN best_third_level_score = mx AND mx >= 0.6::DOUBLE THEN
       CASE WHEN best_third_level_topic = 'Photography' THEN 'Other' ELSE best_third_level_topic END
  ELSE 'Other' END AS topic
FROM m""")
def best_of_levels(spark, sf_dir):
    p = predicted_topics(spark, sf_dir)
    return p.select("row_id", L.best_of_levels(p, 0.6).alias("topic"))


@query("label_codes", f"""WITH {PRED}, c AS (SELECT DISTINCT {_pred_clean_sql()} AS label FROM pred)
SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS code FROM c WHERE label IS NOT NULL""")
def label_codes(spark, sf_dir):
    p = L.clean_predicted(predicted_topics(spark, sf_dir))
    return L.label_codes(p)


@query("label_encode", f"""WITH {PRED}, {TAG},
pc AS (SELECT row_id, {_pred_clean_sql()} AS topic FROM pred),
codes AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS code
          FROM (SELECT DISTINCT topic AS label FROM pc) x),
tc AS (SELECT row_id, {_tag_clean_sql()} AS topic FROM tag)
SELECT 'predicted' AS frame, pc.row_id, pc.topic, codes.code AS topic_encoded FROM pc LEFT JOIN codes ON codes.label = pc.topic
UNION ALL
SELECT 'tagged', tc.row_id, tc.topic, codes.code FROM tc LEFT JOIN codes ON codes.label = tc.topic""")
def label_encode(spark, sf_dir):
    """Codes fitted on the cleaned predictions, applied to predictions and tags."""
    p = L.clean_predicted(predicted_topics(spark, sf_dir)).select("row_id", "topic")
    t = L.clean_tagged(tagged_topics(spark, sf_dir)).select("row_id", "topic")
    codes = L.label_codes(p)
    pe = L.encode(p, codes).withColumn("frame", F.lit("predicted"))
    te = L.encode(t, codes).withColumn("frame", F.lit("tagged"))
    return pe.unionByName(te).select("frame", "row_id", "topic", "topic_encoded")


@query("fill_and_drop_missing", f"""WITH {PRED}
SELECT row_id, coalesce(topic, 'Other') AS topic, topic_score FROM pred WHERE row_id IS NOT NULL""")
def fill_and_drop_missing(spark, sf_dir):
    p = predicted_topics(spark, sf_dir).na.drop(subset=["row_id"])
    return p.select("row_id", L.fill_missing("topic").alias("topic"), "topic_score")


@query("events_label_metrics", f"""WITH {PRED}, {TAG},
pc AS (SELECT row_id, {_pred_clean_sql()} AS topic FROM pred),
tc AS (SELECT row_id, {_tag_clean_sql()} AS topic FROM tag),
j AS (SELECT tc.topic AS truth, pc.topic AS pred FROM tc JOIN pc ON pc.row_id = tc.row_id),
ticks AS (SELECT truth AS label, 1 AS t, 0 AS p, CASE WHEN truth IS NOT DISTINCT FROM pred THEN 1 ELSE 0 END AS tp FROM j
          UNION ALL SELECT pred, 0, 1, 0 FROM j),
c AS (SELECT label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS n_pred, sum(tp)::BIGINT AS tp FROM ticks GROUP BY label)
SELECT label, support, n_pred, tp,
  round(CASE WHEN n_pred = 0 THEN 0.0 ELSE tp::DOUBLE / n_pred END, 6) AS precision,
  round(CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END, 6) AS recall,
  round(CASE WHEN support + n_pred = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (support + n_pred) END, 6) AS f1
FROM c""")
def events_label_metrics(spark, sf_dir):
    """Cleaned predictions vs cleaned tags, matched on the row id (not position)."""
    p = L.clean_predicted(predicted_topics(spark, sf_dir)).select("row_id", F.col("topic").alias("pred"))
    t = L.clean_tagged(tagged_topics(spark, sf_dir)).select("row_id", F.col("topic").alias("truth"))
    j = t.join(p, on="row_id", how="inner")
    prf = metrics.per_class_prf(metrics.class_counts(j, "truth", "pred"))
    return prf.select("label", "support", "n_pred", "tp", rnd("precision").alias("precision"),
                      rnd("recall").alias("recall"), rnd("f1").alias("f1"))
