"""Scoring queries: pairs, softmax, ranking, top-1, cascades, wide annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.functions.vectors import entailment_score
from colloquy.operators import scoring as S
from colloquy.operators import turns
from colloquy.queries.sqlparts import cascade_sql, keyword_scores, label_rows, q, sublist_scores
from colloquy.sources.tables import qa_pairs, table
from colloquy.sources.taxonomy import (
    ANNOTATION_TAXONOMIES, HYPOTHESIS_TEMPLATE, LANGUAGE_KEYWORDS, PAIR_TOPIC_LEVEL1, TOPIC_AMAZON,
    TOPIC_AMAZON_UNCASED, TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3, Taxonomy,
)

_HEAD, _TAIL = HYPOTHESIS_TEMPLATE.split("{}")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("text_label_pairs", f"""
SELECT d.doc_id, l.label, l.pos, {q(_HEAD)} || l.label || {q(_TAIL)} AS hypothesis
FROM documents d CROSS JOIN (VALUES {label_rows(TOPIC_LEVEL1.labels)}) l(label, pos)""")
def text_label_pairs(spark, sf_dir):
    """Every document with every first-level label and its hypothesis sentence."""
    return S.text_label_pairs(_docs(spark, sf_dir), TOPIC_LEVEL1, keep=["doc_id"])


@query("entailment_softmax", """
SELECT event_id, round(value / 50.0::DOUBLE, 6) AS contradiction, round(user_id / 10.0::DOUBLE, 6) AS entailment,
       round(1.0::DOUBLE / (1.0::DOUBLE + exp(value / 50.0::DOUBLE - user_id / 10.0::DOUBLE)), 6) AS score
FROM events""")
def entailment_softmax(spark, sf_dir):
    """Two-way softmax of (contradiction, entailment) logits derived from events."""
    ev = table(spark, sf_dir, "events")
    c, e = F.col("value") / F.lit(50.0), F.col("user_id") / F.lit(10.0)
    return ev.select("event_id", rnd(c).alias("contradiction"), rnd(e).alias("entailment"),
                     rnd(entailment_score(c, e)).alias("score"))


_L1 = keyword_scores("documents", "doc_id", "text", TOPIC_LEVEL1)


@query("labels_ranked", f"""WITH {_L1}
SELECT id AS doc_id, label, (row_number() OVER (PARTITION BY id ORDER BY score DESC, pos DESC))::INTEGER AS rank,
       round(score, 6) AS score FROM k_sc""")
def labels_ranked(spark, sf_dir):
    """All first-level labels of every document, best first (ties: later label first).

    The ranking is an in-row sort of the label structs: no shuffle.
    """
    space = S.LabelSpace([TOPIC_LEVEL1], S.KeywordScorer())
    out = space.add_scores(_docs(spark, sf_dir), "text")
    arr = F.array(*[F.struct(space._score_of(F.lit(space.gid[(TOPIC_LEVEL1.name, None, lab)])).alias("score"),
                             F.lit(i).alias("pos"), F.lit(lab).alias("label"))
                    for i, lab in enumerate(TOPIC_LEVEL1.labels)])
    ranked = out.select("doc_id", F.posexplode(F.sort_array(arr, asc=False)).alias("r", "s"))
    return ranked.select("doc_id", F.col("s.label").alias("label"), (F.col("r") + 1).alias("rank"),
                         rnd("s.score").alias("score"))


_TOP1_SQL = f"WITH {_L1} SELECT id AS doc_id, label, round(score, 6) AS score FROM k_top"


@query("top1_label", _TOP1_SQL)
def top1_label(spark, sf_dir):
    """Best first-level label per document (in-row path)."""
    t = S.top1(_docs(spark, sf_dir), "text", TOPIC_LEVEL1)
    return t.select("doc_id", "label", rnd("score").alias("score"))


@query("top1_label_long", _TOP1_SQL)
def top1_label_long(spark, sf_dir):
    """The same through the pluggable long-form path: pairs -> scorer -> max_by."""
    scorer = S.KeywordScorer()
    texts = scorer.prepare(_docs(spark, sf_dir), TOPIC_LEVEL1)
    pairs = S.text_label_pairs(texts, TOPIC_LEVEL1, keep=["doc_id", "_ntok", "_evidence"])
    scored = S.pair_scores(scorer.score_pairs(pairs, TOPIC_LEVEL1))
    t = S.top1_long(scored, ["doc_id"])
    return t.select("doc_id", "label", rnd("score").alias("score"))


@query("topic_subtopic_cascade", f"""WITH {_L1}, {sublist_scores("k", taxonomy=TOPIC_LEVEL1)}
SELECT t.id AS doc_id, t.label AS topic, round(t.score, 6) AS topic_score,
       coalesce(s.label, t.label) AS subtopic, round(coalesce(s.score, 0.0), 6) AS subtopic_score
FROM k_top t LEFT JOIN k_stop s ON s.id = t.id""")
def topic_subtopic_cascade(spark, sf_dir):
    """First-level topic, then the best label of that topic's sublist (or fallback)."""
    c = S.cascade(_docs(spark, sf_dir), "text", [TOPIC_LEVEL1])
    return c.select("doc_id", F.col("TOPIC_IS_1").alias("topic"), rnd("TOPIC_IS_SCORE_1").alias("topic_score"),
                    F.col("SUBTOPIC_IS_1").alias("subtopic"), rnd("SUBTOPIC_IS_SCORE_1").alias("subtopic_score"))


_WIDE = ["TOPIC_IS_1", "TOPIC_IS_SCORE_1", "SUBTOPIC_IS_1", "SUBTOPIC_IS_SCORE_1",
         "TOPIC_IS_2", "TOPIC_IS_SCORE_2", "SUBTOPIC_IS_2", "SUBTOPIC_IS_SCORE_2",
         "TOPIC_IS_3", "TOPIC_IS_SCORE_3", "SUBTOPIC_IS_3", "SUBTOPIC_IS_SCORE_3",
         "TOPIC_AMAZON_IS", "TOPIC_AMAZON_IS_SCORE", "TOPIC_AMAZON_UNCASED_IS", "TOPIC_AMAZON_UNCASED_IS_SCORE"]


def _wide(df, text_col, keys):
    out = S.cascade(df, text_col, [TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3],
                    flat=[TOPIC_AMAZON, TOPIC_AMAZON_UNCASED])
    return out.select(*keys, *[rnd(c).alias(c) if "SCORE" in c else F.col(c) for c in _WIDE])


@query("annotate_wide", cascade_sql("documents", "doc_id", "text", [TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3],
                                    flat=[TOPIC_AMAZON, TOPIC_AMAZON_UNCASED]))
def annotate_wide(spark, sf_dir):
    """Every document annotated with 3 topic levels + subtopics + 2 flat lists (16 columns)."""
    return _wide(_docs(spark, sf_dir), "text", ["doc_id"])


_USER_TURNS = ("ut AS (SELECT conv_id * 100000 + turn AS uid, conv_id, turn, text FROM conversations "
               "WHERE role = 'user')")


@query("annotate_turns", cascade_sql("ut", "uid", "text", [TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3],
                                     flat=[TOPIC_AMAZON, TOPIC_AMAZON_UNCASED], keep="s.conv_id, s.turn, ",
                                     pre=_USER_TURNS).replace("SELECT s.conv_id, s.turn, s.uid, ",
                                                              "SELECT s.conv_id, s.turn, "))
def annotate_turns(spark, sf_dir):
    """Every user turn annotated like the dialogues (same function, other column)."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return _wide(conv.select("conv_id", "turn", "text"), "text", ["conv_id", "turn"])


_PAIR_SRC = ("pr AS (SELECT conv_id * 100000 + turn AS uid, conv_id, turn, "
             "(CASE WHEN starts_with(text, ' ') THEN substr(text, 2) ELSE text END) || next_text AS sentence "
             "FROM (SELECT conv_id, turn, text, lead(text) OVER w AS next_text, lead(turn) OVER w AS nt "
             "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x WHERE nt IS NOT NULL)")


@query("pair_topics", f"""WITH {_PAIR_SRC}, {keyword_scores("pr", "uid", "sentence", PAIR_TOPIC_LEVEL1)}
SELECT p.conv_id AS CONV_ID, p.turn, p.sentence, t.label AS topic, round(t.score, 6) AS topic_score,
       t.label AS best_first_level_topic, round(t.score, 6) AS best_first_level_score
FROM pr p JOIN k_top t ON t.id = p.uid""")
def pair_topics(spark, sf_dir):
    """Adjacent turn pairs labelled with the first-level topic list."""
    pairs = turns.joined_turns(table(spark, sf_dir, "conversations"))
    t = S.top1(pairs, "sentence", PAIR_TOPIC_LEVEL1, label_col="topic", score_col="topic_score")
    return t.select(F.col("conv_id").alias("CONV_ID"), "turn", "sentence", "topic",
                    rnd("topic_score").alias("topic_score"), F.col("topic").alias("best_first_level_topic"),
                    rnd("topic_score").alias("best_first_level_score"))


# Target-vs-other: the target is English (keywords from the language list),
# 'other' has its own word as evidence.
TARGET = Taxonomy("target", ("en", "other"), {}, {"en": LANGUAGE_KEYWORDS["en"], "other": ["other"]})
_QA = ("qa AS (SELECT conv_id * 100000 + turn AS uid, conv_id, turn, question FROM ("
       "SELECT conv_id, turn, text AS question, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS nt "
       "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x "
       "WHERE nt IS NOT NULL AND role = 'user' AND next_role = 'assistant')")
_TVO = f"""WITH {_QA}, {keyword_scores("qa", "uid", "question", TARGET)},
tv AS (SELECT qa.conv_id, qa.turn, 'en' AS zs_topic, s.score AS zs_score
       FROM qa JOIN k_sc s ON s.id = qa.uid AND s.label = 'en')"""


def _target_vs_other(spark, sf_dir):
    qa = qa_pairs(spark, sf_dir).select("conv_id", "turn", "question")
    return S.target_vs_other(qa, "question", TARGET, "en")


@query("target_vs_other", _TVO + " SELECT conv_id, turn, zs_topic, round(zs_score, 6) AS zs_score FROM tv")
def target_vs_other(spark, sf_dir):
    """Each question scored for (target, 'other'); the target's own score is kept."""
    t = _target_vs_other(spark, sf_dir)
    return t.select("conv_id", "turn", "zs_topic", rnd("zs_score").alias("zs_score"))


@query("target_filter", _TVO + """
SELECT conv_id, turn, zs_topic, round(zs_score, 6) AS zs_score FROM tv WHERE zs_score > 0.7::DOUBLE""")
def target_filter(spark, sf_dir):
    """Questions whose target score exceeds 0.7 (strict)."""
    t = S.filter_score(_target_vs_other(spark, sf_dir), 0.7)
    return t.select("conv_id", "turn", "zs_topic", rnd("zs_score").alias("zs_score"))


__all__ = ["ANNOTATION_TAXONOMIES"]
