import math

from pyspark.sql import functions as F

from colloquy.operators import labels as L


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_replace_chain_substring_vs_label(spark):
    rows = [("Newspaper",), ("Nanny",), ("Art",), ("Martial arts",), ("Teacher",)]
    sub = _one(spark, rows, "t string", L.replace_chain("t", L.MERGE_RULES, "substring"))
    assert sub == ["Otherpaper", "Nanny", "Other", "Martial arts", "Teacher"]
    whole = _one(spark, rows, "t string", L.replace_chain("t", L.PREDICTED_RULES_BEFORE_SCORE + L.MERGE_RULES, "label"))
    assert whole == ["Other", "Nanny", "Other", "Martial arts", "Other"]


def test_clean_predicted_chain(spark):
    df = spark.createDataFrame(
        [(1, "newspaper", 0.5), (2, None, 0.9), (3, "climate CONDITIONS", 0.5), (4, "music", 0.05),
         (5, "nan", 0.5), (6, "teacher", 0.5), (7, "food", float("nan"))], "id long, topic string, topic_score double")
    out = {r.id: r.topic for r in L.clean_predicted(df).collect()}
    assert out == {1: "Other", 2: "Other", 3: "Weather", 4: "Other", 5: "Other", 6: "Other", 7: "Food"}


def test_clean_tagged_substring_keeps_reference_quirk(spark):
    df = spark.createDataFrame([(1, "Newspaper"), (2, None), (3, "music")], "id long, topic string")
    out = {r.id: r.topic for r in L.clean_tagged(df).collect()}
    assert out == {1: "Otherpaper", 2: "Other", 3: "Music"}
    out2 = {r.id: r.topic for r in L.clean_tagged(df, mode="label").collect()}
    assert out2[1] == "Newspaper"


def test_threshold_is_strict_and_low_score_strict(spark):
    rows = [("a", 0.6), ("b", 0.6000001), ("c", 0.1), ("d", 0.0999)]
    t = _one(spark, rows, "l string, s double", L.threshold_relabel("l", "s", 0.6))
    assert t == ["Other", "b", "Other", "Other"]
    lo = _one(spark, rows, "l string, s double", L.low_score_other("l", "s"))
    assert lo == ["a", "b", "c", "Other"]


def test_best_of_levels_ties_go_to_first_level_and_photography(spark):
    schema = ("best_first_level_topic string, best_first_level_score double, best_second_level_topic string, "
              "best_second_level_score double, best_third_level_topic string, best_third_level_score double")
    rows = [("sports", 0.7, "art", 0.7, "food", 0.2),
            ("sports", 0.1, "art", 0.2, "Photography", 0.9),
            ("sports", 0.6, "art", 0.1, "food", 0.1),
            ("sports", float("nan"), "art", 0.65, "food", 0.1),
            ("sports", 0.5, "art", 0.5, "food", 0.5)]
    df = spark.createDataFrame(rows, schema)
    out = [r[0] for r in df.select(L.best_of_levels(df, 0.6)).collect()]
    assert out == ["sports", "Other", "sports", "art", "Other"]


def test_label_codes_sorted_and_unknown_null(spark):
    p = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "topic string")
    codes = L.label_codes(p)
    assert {r.label: r.code for r in codes.collect()} == {"a": 0, "b": 1}
    t = spark.createDataFrame([("a",), ("z",)], "topic string")
    enc = {r.topic: r.topic_encoded for r in L.encode(t, codes).collect()}
    assert enc == {"a": 0, "z": None}


def test_level_rename(spark):
    out = _one(spark, [("teacher",), ("facebook",), ("sports",)], "t string", L.level_rename("t"))
    assert out == ["education", "social media", "sports"]
    assert math.isfinite(1.0) and F is not None
