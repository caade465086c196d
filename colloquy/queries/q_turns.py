"""Turn pairing queries over ``conversations`` (and ids over ``customer``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.operators import turns
from colloquy.sources.io import row_range
from colloquy.sources.tables import table

_PAIRS_SQL = """
SELECT conv_id, turn, text, next_text, role, next_role FROM (
  SELECT conv_id, turn, text, role,
         lead(text) OVER w AS next_text, lead(role) OVER w AS next_role, lead(turn) OVER w AS nt
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x
WHERE nt IS NOT NULL"""


@query("turn_pairs", f"SELECT conv_id, turn, text, next_text FROM ({_PAIRS_SQL}) p")
def turn_pairs(spark, sf_dir):
    return turns.turn_pairs(table(spark, sf_dir, "conversations"))


@query("turn_pair_text", f"""
SELECT conv_id, turn,
       (CASE WHEN starts_with(text, ' ') THEN substr(text, 2) ELSE text END) || next_text AS sentence
FROM ({_PAIRS_SQL}) p""")
def turn_pair_text(spark, sf_dir):
    return turns.joined_turns(table(spark, sf_dir, "conversations"))


@query("question_answer_pairs", f"""
SELECT conv_id, turn, text AS question, next_text AS answer FROM ({_PAIRS_SQL}) p
WHERE role = 'user' AND next_role = 'assistant'""")
def question_answer_pairs(spark, sf_dir):
    return turns.question_answer_pairs(table(spark, sf_dir, "conversations"))


# No text of the test tables contains '?'; the operator takes the needle as an
# argument and this query looks for ','. Unit tests cover '?'.
@query("question_filter", "SELECT conv_id, turn, text FROM conversations WHERE strpos(text, ',') > 0")
def question_filter(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.question_filter(conv, "text", ",")


@query("id_prefix", """
SELECT c_custkey, c_name, substr(c_name, 1, greatest(length(c_name) - 4, 0)) AS conv_prefix FROM customer""")
def id_prefix(spark, sf_dir):
    from colloquy.functions.text import id_prefix as prefix

    cust = table(spark, sf_dir, "customer")
    return cust.select("c_custkey", "c_name", prefix("c_name").alias("conv_prefix"))


@query("first_seen_order", "SELECT source, min(doc_id) AS first_row FROM documents GROUP BY source")
def first_seen_order(spark, sf_dir):
    return turns.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("row_range", """
SELECT event_id, event_type, value FROM events WHERE event_id BETWEEN 0 AND 1000""")
def row_range_q(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return row_range(ev, "event_id", 0, 1000)


@query("segments_to_pairs", """
WITH seg AS (
  SELECT CAST(conv_id AS VARCHAR) || lpad(CAST(turn AS VARCHAR), 4, '0') AS uid, text FROM conversations),
ids AS (SELECT substr(uid, 1, greatest(length(uid) - 4, 0)) AS conv_id, substr(uid, -4) AS turn, text FROM seg),
p AS (SELECT conv_id, turn, text, lead(text) OVER w AS next_text, lead(turn) OVER w AS nt
      FROM ids WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, (CASE WHEN starts_with(text, ' ') THEN substr(text, 2) ELSE text END) || next_text AS sentence
FROM p WHERE nt IS NOT NULL""")
def segments_to_pairs(spark, sf_dir):
    """Segment ids (conversation id + 4-digit segment) split back and paired."""
    conv = table(spark, sf_dir, "conversations")
    seg = conv.select(F.concat(F.col("conv_id").cast("string"),
                               F.lpad(F.col("turn").cast("string"), 4, "0")).alias("UID"),
                      F.col("text").alias("SEG"))
    t = turns.segments_to_turns(seg)
    return turns.joined_turns(t)
