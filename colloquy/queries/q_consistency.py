"""Answer-consistency queries: main question, majority answer, answer bags."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.functions.text import tokens
from colloquy.operators import vectors as V
from colloquy.operators.scoring import top1
from colloquy.plans import consistency as CS
from colloquy.plans.evaluation import LANG_SCORER
from colloquy.queries.sqlparts import TOKENS, keyword_scores, typical_answers_sql, unit_vectors_sql
from colloquy.session import stored
from colloquy.sources.tables import qa_pairs, table
from colloquy.sources.taxonomy import LANGUAGES

LIKES_ROUNDS = 30  # rounds the tables need until no assignment changes, with some to spare
SIMILAR = 0.5  # cosine bar for "nearly the same question" with hashed vectors


@query("main_question", """
SELECT lang, text AS main, c AS count, nd AS n_distinct FROM (
  SELECT lang, text, count(*) AS c, count(*) OVER (PARTITION BY lang) AS nd FROM documents
  WHERE text IS NOT NULL GROUP BY lang, text) x
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, text) = 1""")
def main_question(spark, sf_dir):
    """Most frequent text per group (language); ties -> smallest text."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return CS.most_frequent(docs, ["lang"], "text", "main")


@query("majority_answer", """
SELECT source, text AS answer, c AS count, nd AS n_distinct, c = 1 AS is_tie FROM (
  SELECT source, text, count(*) AS c, count(*) OVER (PARTITION BY source) AS nd FROM documents
  WHERE text IS NOT NULL GROUP BY source, text) x
QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, text) = 1""")
def majority_answer(spark, sf_dir):
    """Majority text per source; all-unique groups flagged as ties (smallest text)."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return CS.majority(docs, ["source"], "text")


def _qa_topics(spark, sf_dir):
    qa = qa_pairs(spark, sf_dir).withColumn("uid", F.col("conv_id") * 100000 + F.col("turn"))
    t = top1(qa, "question", LANGUAGES, LANG_SCORER, label_col="topic", score_col="topic_score")
    return V.hash_embed(t, "question", 64, "vec")


def _qa_sql(where: str) -> str:
    """CTEs from conversations to ``bag``; ``where`` filters the topic's score."""
    return f"""
p AS (SELECT conv_id, turn, text, role, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role,
             lead(turn) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT conv_id * 100000 + turn AS uid, conv_id, turn, text AS question, next_text AS answer,
              'bot' || (conv_id % 4)::VARCHAR AS chatbot FROM p
       WHERE nt IS NOT NULL AND role = 'user' AND next_role = 'assistant'),
{keyword_scores("qa", "uid", "question", LANGUAGES)},
qt AS (SELECT qa.*, k_top.label AS topic FROM qa JOIN k_top ON k_top.id = qa.uid WHERE {where}),
qtok AS (SELECT uid, unnest({TOKENS.format(text='question')}) AS tok FROM qt),
qb AS (SELECT uid, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 64)::INTEGER AS dim, count(*) AS c
       FROM qtok WHERE tok <> '' GROUP BY uid, dim),
qn AS (SELECT uid, sqrt(sum(c * c)) AS nn FROM qb GROUP BY uid),
qv AS (SELECT qb.uid, qb.dim, qb.c / qn.nn AS value FROM qb JOIN qn ON qn.uid = qb.uid),
mq AS (SELECT topic, question AS main FROM (SELECT topic, question, count(*) AS c FROM qt GROUP BY topic, question) x
       QUALIFY row_number() OVER (PARTITION BY topic ORDER BY c DESC, question) = 1),
mu AS (SELECT mq.topic, mq.main, min(qt.uid) AS muid FROM mq JOIN qt ON qt.topic = mq.topic AND qt.question = mq.main
       GROUP BY mq.topic, mq.main),
sim AS (SELECT qt.uid, coalesce(sum(a.value * b.value), 0.0) AS similarity FROM qt JOIN mu ON mu.topic = qt.topic
        LEFT JOIN qv a ON a.uid = qt.uid LEFT JOIN qv b ON b.uid = mu.muid AND b.dim = a.dim GROUP BY qt.uid),
bag AS (SELECT qt.uid, qt.topic, qt.question, qt.answer, qt.chatbot, qt.conv_id, qt.turn,
               CASE WHEN qt.question = mu.main THEN 'main' ELSE 'similar' END AS source, sim.similarity
        FROM qt JOIN mu ON mu.topic = qt.topic JOIN sim ON sim.uid = qt.uid
        WHERE qt.question = mu.main OR sim.similarity > {SIMILAR}::DOUBLE)"""


_QA_SQL = _qa_sql("true")


def _bag(spark, sf_dir):
    qa = _qa_topics(spark, sf_dir)
    return CS.answer_bag(qa, ["topic"], "question", "answer", "vec", SIMILAR,
                         extra=["chatbot", "conv_id", "turn", "uid"])


@query("answer_bag", f"""WITH {_QA_SQL}
SELECT topic, question, answer, source, round(similarity, 6) AS similarity FROM bag""")
def answer_bag(spark, sf_dir):
    """Answers to each topic's main question plus answers to near-copies of it."""
    b = _bag(spark, sf_dir)
    return b.select("topic", "question", "answer", "source", rnd("similarity").alias("similarity"))


@query("answer_bag_by_chatbot", f"""WITH {_QA_SQL}
SELECT topic, chatbot, answer, source FROM bag""")
def answer_bag_by_chatbot(spark, sf_dir):
    """The same bag with the chatbot that gave each answer."""
    return _bag(spark, sf_dir).select("topic", "chatbot", "answer", "source")


@query("topic_likes", f"""WITH {_qa_sql("k_top.score > 0.7::DOUBLE")},
{typical_answers_sql("bag", "topic", "uid", "answer", LIKES_ROUNDS)}
SELECT g AS topic, cluster::INTEGER AS cluster, id AS medoid_uid, answer FROM typical""")
def topic_likes(spark, sf_dir):
    """Typical answers per topic: questions kept when their topic score exceeds
    0.7, answer bag, hashed vectors + mean row, 2-d projection, k sweep with
    Euclidean silhouette, standardised k-means, medoid answer per cluster."""
    qa = _qa_topics(spark, sf_dir).where(F.col("topic_score") > 0.7)
    bag = CS.answer_bag(qa, ["topic"], "question", "answer", "vec", SIMILAR, extra=["uid"])
    out = CS.typical_answers_per_group(bag, ["topic"], "uid", "answer")
    return out.select("topic", F.col("cluster").cast("int").alias("cluster"), "medoid_uid", "answer")


MATCH = 0.3  # cosine bar between a filled template and a question with hashed vectors
KINDS = ("like", "favorite", "no-fill")


@query("likes_by_word", f"""WITH {_qa_sql("k_top.score > 0.7::DOUBLE")},
alq AS MATERIALIZED (SELECT qa.uid, qa.question, k_top.label AS topic FROM qa JOIN k_top ON k_top.id = qa.uid),
{unit_vectors_sql("alq", "alq", "uid", "question")},
alv AS MATERIALIZED (SELECT alq.uid, alq.topic, alq_v.v FROM alq JOIN alq_v ON alq_v.uid = alq.uid),
tvx AS (SELECT topic, unnest(range(64)) AS dim, unnest(v) AS x FROM alv),
tvs AS (SELECT topic, list(x ORDER BY dim) AS v FROM (SELECT topic, dim, avg(x) AS x FROM tvx GROUP BY topic, dim) m GROUP BY topic),
wtok AS (SELECT topic, unnest({TOKENS.format(text='question')}) AS word FROM alq),
subj AS (SELECT DISTINCT word FROM (SELECT topic, word FROM wtok WHERE length(word) >= 3 GROUP BY topic, word
         QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, word) = 1) x),
{unit_vectors_sql("sbj", "subj", "word", "word")},
fnd AS (SELECT w.word, t.topic FROM sbj_v w CROSS JOIN tvs t
        QUALIFY row_number() OVER (PARTITION BY w.word ORDER BY round(list_cosine_similarity(w.v, t.v), 9) DESC, t.topic) <= 10),
tpl(kind, head, tail) AS (VALUES ('like', 'do you like ', '?'), ('favorite', 'what''s your favorite ', '?'), ('no-fill', '', '')),
askd AS (SELECT word, kind, word || '/' || kind AS akey, head || word || tail AS text FROM subj CROSS JOIN tpl),
{unit_vectors_sql("ask", "askd", "akey", "text")},
rps AS (SELECT a.topic, a.v FROM alv a JOIN tvs t ON t.topic = a.topic
        QUALIFY row_number() OVER (PARTITION BY a.topic ORDER BY round(list_cosine_similarity(a.v, t.v), 9) DESC, a.uid) <= 3),
matched AS (SELECT DISTINCT k.word, k.kind, f.topic FROM askd k JOIN ask_v v ON v.akey = k.akey JOIN fnd f ON f.word = k.word
            JOIN rps r ON r.topic = f.topic WHERE list_cosine_similarity(r.v, v.v) >= {MATCH}::DOUBLE),
{typical_answers_sql("bag", "topic", "uid", "answer", LIKES_ROUNDS)}
SELECT m.word, m.kind, m.topic, t.cluster::INTEGER AS cluster, t.id AS medoid_uid, t.answer
FROM matched m JOIN typical t ON t.g = m.topic""")
def likes_by_word(spark, sf_dir):
    """From subject words (each topic's most frequent word of three letters or more) and both question
    templates to the typical answers of the topics that hold such a question."""
    qa = stored(_qa_topics(spark, sf_dir), "questions")
    said = qa.select("topic", F.explode(tokens("question")).alias("word")).where(F.length("word") >= 3)
    words = stored(CS.most_frequent(said, ["topic"], "word", "word").select("word").distinct(), "subject-words")
    out = CS.likes_by_word(qa, words, list(KINDS), "topic", "question", "answer", "vec", "topic_score", "uid",
                           threshold=SIMILAR, bar=MATCH)
    return out.select("word", "kind", "topic", F.col("cluster").cast("int").alias("cluster"), "medoid_uid", "answer")
