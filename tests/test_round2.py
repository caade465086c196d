"""Cases that earlier versions got wrong."""
import os
import tempfile

from pyspark.sql import functions as F

from colloquy.operators import labels, metrics, scoring
from colloquy.plans import consistency
from colloquy.sources import io, taxonomy


def test_typical_answers_keep_every_group(spark):
    rows = [("one", 1, "yes")] + [("same", 10 + i, "no idea") for i in range(5)]
    rows += [("two", 20, "red"), ("two", 21, "blue")]
    rows += [("mixed", 30 + i, t) for i, t in enumerate(["i like cats", "i like cats", "cats i like", "never mind the weather",
                                                         "never mind the weather", "the weather never mind"])]
    bag = spark.createDataFrame(rows, "topic string, id long, answer string")
    got = consistency.typical_answers_per_group(bag, ["topic"], "id", "answer").collect()
    by = {}
    for r in got:
        by.setdefault(r["topic"], []).append(r["answer"])
    assert set(by) == {"one", "same", "two", "mixed"}
    assert by["one"] == ["yes"] and by["same"] == ["no idea"] and sorted(by["two"]) == ["blue", "red"]


def test_few_answers_give_the_majority(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y")]
    bag = spark.createDataFrame(rows, "topic string, id long, answer string")
    got = consistency.typical_answers_per_group(bag, ["topic"], "id", "answer", min_answers=3).collect()
    assert [(r["topic"], r["medoid_id"], r["answer"]) for r in got] == [("a", 2, "y")]


def test_csv_keeps_text(spark):
    df = spark.createDataFrame([(1, "  lead and trail  "), (2, ""), (3, None), (4, 'a "quoted", b\nnext')], "id int, t string")
    path = os.path.join(tempfile.mkdtemp(), "csv")
    io.write_csv(df, path)
    assert sorted(map(tuple, io.read_csv(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_nan_passes_no_threshold(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 0.9)], "label string, zs_score double")
    assert [r[0] for r in scoring.filter_score(df).select("label").collect()] == ["b"]
    got = df.select(labels.threshold_relabel("label", "zs_score", 0.6),
                    metrics.relabel_by_threshold(F.col("label"), F.col("zs_score"), F.lit(0.6))).collect()
    assert [tuple(r) for r in got] == [("Other", "Other"), ("b", "b")]


def test_underscore_labels_have_words():
    t = taxonomy.Taxonomy("t", ("Entertainment_Movies", "Other"))
    assert t.keywords_of("Entertainment_Movies") == ["entertainment", "movies"]
