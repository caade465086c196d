import os
import tempfile

from pyspark.sql import functions as F

from colloquy.operators import vectors as V
from colloquy.plans import consistency as CS
from colloquy.streaming.annotate import annotate, annotate_stream


def test_most_frequent_ties_smallest_and_nulls_ignored(spark):
    df = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", None), ("t", None), ("u", "x")], "grp string, q string")
    out = {r.grp: (r.main, r["count"]) for r in CS.most_frequent(df, ["grp"], "q").collect()}
    assert out == {"t": ("a", 1), "u": ("x", 1)}
    maj = {r.grp: r.is_tie for r in CS.majority(df, ["grp"], "q").collect()}
    assert maj == {"t": True, "u": True}


def test_answer_bag_main_plus_similar(spark):
    rows = [("t", "fav movie", "a1"), ("t", "fav movie", "a2"), ("t", "fav movie please", "a3"),
            ("t", "weather today", "a4"), ("s", "x", "a5")]
    qa = spark.createDataFrame(rows, "grp string, question string, answer string")
    qa = V.hash_embed(qa, "question", 64, "vec")
    bag = CS.answer_bag(qa, ["grp"], "question", "answer", "vec", 0.6)
    got = sorted((r.grp, r.answer, r.source) for r in bag.collect())
    assert got == [("s", "a5", "main"), ("t", "a1", "main"), ("t", "a2", "main"), ("t", "a3", "similar")]


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="colloquy-stream-", dir="/tmp")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["football coach", "song and dance", "xyz", None])],
                               "id long, DIAL string")
    df.write.mode("overwrite").parquet(os.path.join(d, "in"))
    q = annotate_stream(spark, os.path.join(d, "in"), df.schema, "DIAL", sink="memory", query_name="ann_test",
                        checkpoint=os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    streamed = sorted(map(tuple, spark.sql("SELECT * FROM ann_test").collect()), key=lambda r: r[0])
    batch = sorted(map(tuple, annotate(df, "DIAL").collect()), key=lambda r: r[0])
    assert streamed == batch and len(batch) == 4
    assert F is not None
