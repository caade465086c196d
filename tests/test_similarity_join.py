"""Exact cosine join against all pairs, and next rows over range partitions."""
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import similarity_join as SJ
from colloquy.operators import turns


@pytest.mark.parametrize("block", [500, 3])
def test_all_pairs_above_the_bar(spark, monkeypatch, block):
    monkeypatch.setattr(SJ, "LIST_BLOCK", block)
    rng = random.Random(block)
    words = ["a" * i + "x" for i in range(25)]
    texts = {i: " ".join(rng.choice(words[:3] if rng.random() < 0.4 else words) for _ in range(rng.randint(0, 12))) for i in range(150)}
    texts |= {200 + i: texts[i] for i in range(30)} | {300: None, 301: "", 302: "?! 12"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(4)
    vec = {i: Counter((t or "").split()) for i, t in texts.items() if i < 300}
    norm = {i: sum(c * c for c in v.values()) ** 0.5 for i, v in vec.items()}
    for bar in (0.5, 0.9, 1.0):
        want = {}
        for a, b in itertools.combinations(sorted(vec), 2):
            if norm[a] and norm[b]:
                s = sum(c * vec[b][t] for t, c in vec[a].items()) / norm[a] / norm[b]
                if round(s, 9) >= bar:
                    want[a, b] = round(s, 6)
        got = {(r["id_a"], r["id_b"]): round(r["similarity"], 6) for r in SJ.cosine_pairs(SJ.term_vectors(df, "id", "text"), "id", bar).collect()}
        assert got == want and want
    assert SJ.cosine_pairs(SJ.term_vectors(df.where("false"), "id", "text"), "id", 0.5).count() == 0


def test_next_turn_over_many_ranges(spark):
    rows = [(c, 3 * t + c, f"{c}-{t}") for c, n in ((1, 400), (2, 1), (3, 2), (4, 90)) for t in range(n)] + [(None, 1, "x"), (None, 2, "y")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep all ranges
    try:
        got = sorted(tuple(r) for r in turns.turn_pairs(conv).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(tuple(r) for r in turns.turn_pairs(conv.where(F.col("conv_id").isNotNull()), method="window").collect())
    assert got == want and len(got) == 399 + 1 + 89
    assert turns.turn_pairs(conv.where("false")).count() == 0
