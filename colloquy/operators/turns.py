"""Turn pairing and conversation-level text preparation.

Adjacent turns are paired over range partitions: rows are dealt by ranges of
(conversation, turn), so a conversation with a large share of all turns is many
partitions. Each row takes the next one of its partition, and the last row of a
partition takes the first of the next one, from a table of one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import contains_literal, id_prefix, strip_one_leading_space
from colloquy.session import stored


def turn_pairs(conv: DataFrame, conv_col: str = "conv_id", order_col: str = "turn",
               text_col: str = "text", extra: tuple = (), method: str = "ranges") -> DataFrame:
    """Row i with row i+1 of the same conversation; n-1 rows per conversation.

    ``method="ranges"`` (default): next rows over range partitions; any turn
    numbering works, and no task holds a conversation. ``method="window"``:
    ``lead`` over the conversation in one task. ``method="join"``: for
    gap-free turn numbers, an equi-join on (conversation, turn + 1). Rows of
    one turn are taken by text.
    """
    if method == "ranges":
        return _next_over_ranges(conv, conv_col, order_col, text_col, extra)
    if method == "join":
        cols = [text_col, *extra]
        left = conv.select(conv_col, order_col, *cols)
        right = conv.select(F.col(conv_col).alias("_c"), (F.col(order_col) - 1).alias("_t"),
                            *[F.col(c).alias(f"next_{c}") for c in cols])
        j = left.join(right, (left[conv_col] == right["_c"]) & (left[order_col] == right["_t"]), "inner")
        return j.drop("_c", "_t")
    if method != "window":
        raise ValueError("method must be 'window' or 'join'")
    return _drop_last(conv, conv_col, order_col, text_col, extra)


def _next_over_ranges(conv, conv_col, order_col, text_col, extra):
    cols = [text_col, *extra]
    # long texts break ties inside a partition only: they are no range bounds
    dealt = conv.select(conv_col, order_col, *cols).repartitionByRange(conv_col, order_col).sortWithinPartitions(
        conv_col, order_col, *cols)
    rows = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    mine = F.struct(F.col(conv_col).alias("conv"), *(F.col(c).alias(f"next_{c}") for c in cols))
    firsts = rows.groupBy("_part").agg(F.min_by(mine, "_row").alias("_first"))
    follow = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_over"))  # a row per partition
    inside = rows.withColumn("_next", F.lead(mine).over(Window.partitionBy("_part").orderBy("_row")))
    j = inside.join(follow, "_part").withColumn("_next", F.coalesce("_next", "_over"))
    return j.where(F.col("_next.conv") == F.col(conv_col)).select(
        conv_col, order_col, *cols, *(F.col(f"_next.next_{c}") for c in cols))


def _drop_last(conv, conv_col, order_col, text_col, extra):
    w = Window.partitionBy(conv_col).orderBy(order_col)
    cols = [text_col, *extra]
    out = conv.select(conv_col, order_col, *cols,
                      *[F.lead(c).over(w).alias(f"next_{c}") for c in cols],
                      F.lead(F.col(order_col)).over(w).alias("_next_turn"))
    return out.where(F.col("_next_turn").isNotNull()).drop("_next_turn")


def pair_sentence(pairs: DataFrame, text_col: str = "text", next_col: str = "next_text",
                  out_col: str = "sentence") -> DataFrame:
    """First turn (one leading blank removed) glued to the second, no separator."""
    return pairs.withColumn(out_col, F.concat(strip_one_leading_space(text_col), F.col(next_col)))


def joined_turns(conv: DataFrame, conv_col: str = "conv_id", order_col: str = "turn",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, turn, sentence): the adjacent-turn join as one text per pair."""
    pairs = turn_pairs(conv, conv_col, order_col, text_col)
    return pair_sentence(pairs, text_col, f"next_{text_col}").select(conv_col, order_col, "sentence")


def question_answer_pairs(conv: DataFrame, role_col: str = "role", q_role: str = "user",
                          a_role: str = "assistant") -> DataFrame:
    """A user turn followed directly by an assistant turn: (question, answer)."""
    pairs = turn_pairs(conv, extra=(role_col,))
    return (pairs.where((F.col(role_col) == q_role) & (F.col(f"next_{role_col}") == a_role))
            .select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer")))


def question_filter(df: DataFrame, col: str, needle: str = "?") -> DataFrame:
    """Rows whose text contains the literal ``needle``; null text is dropped."""
    return df.where(contains_literal(col, needle))


def segments_to_turns(seg: DataFrame, uid_col: str = "UID", text_col: str = "SEG",
                      order_col: str | None = None, suffix_len: int = 4) -> DataFrame:
    """Split segment ids into conversation id (prefix) and segment number (suffix)."""
    order = F.col(order_col) if order_col else F.substring(F.col(uid_col), -suffix_len, suffix_len)
    return seg.select(id_prefix(uid_col, suffix_len).alias("conv_id"), order.alias("turn"),
                      F.col(text_col).alias("text"))


def first_seen(df: DataFrame, value_col: str, order_col: str) -> DataFrame:
    """Distinct values with the first row id where each appears.

    Ordering by ``first_row`` gives first-seen order; that sort is left to the
    caller (a distributed range sort), no single-partition window is used.
    """
    return df.groupBy(value_col).agg(F.min(order_col).alias("first_row"))
