import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators.positions import positional_index


def test_positional_index_matches_row_number_with_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", None if i % 11 == 0 else "a", int(v), i)
            for i, v in enumerate(rng.integers(0, 10_000, size=3000))]
    df = spark.createDataFrame(rows, "tab string, ann string, v long, id long")
    got = positional_index(df, ["tab", "ann"], ["v", "id"], num_partitions=9)
    w = Window.partitionBy("tab", "ann").orderBy("v", "id")
    want = df.withColumn("pos", F.row_number().over(w) - 1)
    a = sorted((r.id, r.pos) for r in got.collect())
    b = sorted((r.id, r.pos) for r in want.collect())
    assert a == b and len(a) == 3000
