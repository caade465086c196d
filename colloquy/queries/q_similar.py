"""Near copies among all distinct questions of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.operators import similarity_join as SJ
from colloquy.queries.sqlparts import TOKENS
from colloquy.sources.tables import qa_pairs

BAR = 0.5


@query("similar_questions", f"""WITH
p AS (SELECT conv_id, turn, text, role, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT min(conv_id * 100000 + turn) AS uid, text FROM p WHERE role = 'user' AND next_role = 'assistant' GROUP BY text),
t AS (SELECT uid, unnest({TOKENS.format(text='text')}) AS term FROM q),
c AS (SELECT uid, term, count(*)::DOUBLE AS c FROM t WHERE term <> '' GROUP BY uid, term),
v AS (SELECT uid, term, c / sqrt(sum(c * c) OVER (PARTITION BY uid)) AS w FROM c),
s AS (SELECT a.uid AS uid_a, b.uid AS uid_b, sum(a.w * b.w) AS similarity FROM v a JOIN v b ON b.term = a.term AND a.uid < b.uid
      GROUP BY a.uid, b.uid)
SELECT uid_a, uid_b, round(similarity, 6) AS similarity FROM s WHERE round(similarity, 9) >= {BAR}::DOUBLE""")
def similar_questions(spark, sf_dir):
    """All pairs of distinct questions with a cosine of their term counts of 0.5 or more."""
    qa = qa_pairs(spark, sf_dir).select((F.col("conv_id") * 100000 + F.col("turn")).alias("uid"), "question")
    once = qa.groupBy("question").agg(F.min("uid").alias("uid"))
    pairs = SJ.cosine_pairs(SJ.term_vectors(once, "uid", "question"), "uid", BAR)
    return pairs.select("uid_a", "uid_b", rnd("similarity").alias("similarity"))
