from pyspark.sql import functions as F

from colloquy.functions.text import capitalize_first, id_prefix
from colloquy.operators import turns


def test_pairs_skip_single_turn_conversations(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", " there"), (1, 2, "user", "bye"), (2, 0, "user", "alone")],
        "conv_id long, turn long, role string, text string")
    p = turns.turn_pairs(conv).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.text, r.next_text) for r in p] == [(1, 0, "hi", " there"), (1, 1, " there", "bye")]


def test_pair_sentence_strips_one_leading_space_of_first_turn_only(spark):
    conv = spark.createDataFrame(
        [(1, 0, "  two", " x"), (1, 1, " x", "y"), (1, 2, "y", "z")],
        "conv_id long, turn long, text string, other string").select("conv_id", "turn", "text")
    s = [r.sentence for r in turns.joined_turns(conv).orderBy("turn").collect()]
    assert s == [" two x", "xy"]


def test_question_answer_pairs_need_user_then_assistant(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "system", "s"), (1, 3, "assistant", "a2"),
         (1, 4, "user", "q2"), (1, 5, "user", "q3")], "conv_id long, turn long, role string, text string")
    qa = turns.question_answer_pairs(conv).collect()
    assert [(r.question, r.answer) for r in qa] == [("q1", "a1")]


def test_question_filter_is_literal_and_drops_null(spark):
    df = spark.createDataFrame([("why?",), ("no question",), (None,), ("a.b",)], "q string")
    assert [r.q for r in turns.question_filter(df, "q").collect()] == ["why?"]
    assert [r.q for r in turns.question_filter(df, "q", ".").collect()] == ["a.b"]


def test_id_prefix_short_ids_give_empty(spark):
    df = spark.createDataFrame([("conv0001",), ("abcd",), ("ab",), (None,)], "uid string")
    out = [r.p for r in df.select(id_prefix("uid").alias("p")).collect()]
    assert out == ["conv", "", "", None]


def test_capitalize_is_not_initcap(spark):
    df = spark.createDataFrame([("climate CONDITIONS",), ("x",), ("",), (None,)], "t string")
    assert [r.c for r in df.select(capitalize_first("t").alias("c")).collect()] == \
        ["Climate conditions", "X", "", None]


def test_segments_split_uid(spark):
    seg = spark.createDataFrame([("c10001", "hello "), ("c10002", "world"), ("x0001", "solo")], "UID string, SEG string")
    t = turns.segments_to_turns(seg)
    pairs = turns.joined_turns(t).collect()
    assert [(r.conv_id, r.sentence) for r in pairs] == [("c1", "hello world")]


def test_first_seen(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (5, "c")], "rid long, v string")
    out = {r.v: r.first_row for r in turns.first_seen(df, "v", "rid").collect()}
    assert out == {"a": 1, "b": 2, "c": 5}
    assert F is not None


def test_join_method_equals_window_for_gap_free_turns(spark):
    rows = [(c, t, f"t{c}-{t}") for c in range(5) for t in range(c + 1)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    a = sorted(map(tuple, turns.turn_pairs(conv).collect()))
    b = sorted(map(tuple, turns.turn_pairs(conv, method="join").select("conv_id", "turn", "text", "next_text").collect()))
    assert a == b and len(a) == sum(range(5))


def test_parse_labels_and_lists_to_rows(spark):
    from colloquy.functions.text import parse_labels
    from colloquy.sources.io import lists_to_rows

    df = spark.createDataFrame([("sports, politics ,movies",)], "l string")
    assert df.select(parse_labels("l").alias("a")).first().a == ["sports", "politics", "movies"]
    arr = spark.createDataFrame([(1, ["a", "b"], [0.5, 0.7])], "id int, answers array<string>, sim array<double>")
    rows = [tuple(r) for r in lists_to_rows(arr, ["answers", "sim"], keep=["id"]).collect()]
    assert rows == [(1, "a", 0.5), (1, "b", 0.7)]
