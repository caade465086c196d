"""Fitted topics, diverse terms and blocked topic search against plain versions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import topic_fit as TF
from colloquy.operators.graph import components


def _fit(V, k, bar, min_size):
    n = len(V)
    length = np.linalg.norm(V, axis=1)
    U = V / np.where(length == 0, 1, length)[:, None]
    S = np.round(U @ U.T, TF.PLACES)
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (-S[i, j], j))[:k] for i in range(n)]
    strong = [[j for j in near[i] if S[i, j] >= bar] for i in range(n)]
    dense = {i for i in range(n) if len(strong[i]) == k}
    region = {i: i for i in dense}
    changed = True
    while changed:
        changed = False
        for i in dense:
            for j in strong[i]:
                if j in dense and region[i] != region[j]:
                    low, high = sorted((region[i], region[j]))
                    region = {x: low if c == high else c for x, c in region.items()}
                    changed = True
    for i in range(n):
        if i not in dense:
            reach = [j for j in strong[i] if j in dense]
            if reach:
                region[i] = region[reach[0]]
    sizes = {}
    for i, c in region.items():
        sizes.setdefault(c, []).append(i)
    order = sorted((c for c in sizes if len(sizes[c]) >= min_size), key=lambda c: (-len(sizes[c]), min(sizes[c])))
    return [order.index(region[i]) if i in region and region[i] in order else -1 for i in range(n)]


@pytest.mark.parametrize("tile", [256, 7])
def test_topics_match_a_plain_fit(spark, tile):
    rng = np.random.default_rng(4)
    groups = {"a": np.vstack([rng.normal(size=(n, 6)) * 0.3 + at for n, at in ((20, [3, 0, 0, 0, 0, 0]), (14, [0, 3, 0, 0, 0, 0]),
                                                                              (2, [0, 0, 0, 3, 0, 0]), (9, [0, 0, 0, 0, 0, 0]))]),
              "copies": np.repeat(rng.normal(size=(3, 6)), 6, axis=0), "zero": np.zeros((5, 6)), "one": np.ones((1, 6)),
              None: rng.normal(size=(12, 6)) + 2.0}
    rows = [(g, i, [float(x) for x in v]) for g, V in groups.items() for i, v in enumerate(V)]
    df = spark.createDataFrame(rows, "grp string, id long, vec array<double>").repartition(4)
    got = {(r["grp"], r["id"]): r["topic"] for r in TF.fit_topics(df, ["grp"], "id", "vec", 3, 0.9, 3, tile).collect()}
    assert got == {(g, i): t for g, V in groups.items() for i, t in enumerate(_fit(V, 3, 0.9, 3))}
    assert len({t for (g, _), t in got.items() if g == "a"}) > 2
    assert TF.fit_topics(df.where("false"), ["grp"], "id", "vec").count() == 0


def test_terms_are_chosen_for_relevance_and_diversity(spark):
    rng = random.Random(5)
    vecs = {f"t{i}": [float(rng.random() < 0.4) for _ in range(5)] for i in range(25)} | {"zero": [0.0] * 5}
    rows = [(t, w, rng.choice([1.0, 2.0, rng.random()])) for t in ("x", "y") for w in vecs] + [("z", "t0", 1.0)]
    weights = spark.createDataFrame(rows, "topic string, term string, weight double")
    table = spark.createDataFrame(list(vecs.items()), "term string, _vec array<double>")
    got = {}
    for r in sorted(TF.diverse_terms(weights, "topic", lambda d: d.join(table, "term"), 6, 0.5, 15).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["topic"], []).append((r["term"], round(r["score"], 6)))
    unit = {w: np.array(v) / (np.linalg.norm(v) or 1.0) for w, v in vecs.items()}
    for topic in "xyz":
        best = sorted((-x, w) for t, w, x in rows if t == topic)[:15]
        value = {w: x / best[0][0] for x, w in best}
        taken = []
        while len(taken) < min(6, len(value)):
            score = {w: value[w] if not taken else 0.5 * value[w] - 0.5 * max(unit[w] @ unit[t] for t, _ in taken)
                     for w in value if w not in dict(taken)}
            w = min(score, key=lambda w: (-round(score[w], TF.PLACES), w))
            taken.append((w, round(score[w], 6)))
        assert got[topic] == taken


def test_topics_of_texts_over_blocks(spark):
    rng = np.random.default_rng(6)
    topics = [(f"t{i}", [float(x) for x in rng.integers(0, 3, 4)]) for i in range(23)]
    texts = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(17)] + [(99, [0.0] * 4)]
    t = spark.createDataFrame(topics, "topic string, topic_vec array<double>")
    q = spark.createDataFrame(texts, "item long, query_vec array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    want = {}
    for i, v in texts:
        sims = sorted((-round(float(unit(v) @ unit(x)), TF.PLACES), name) for name, x in topics)[:4]
        want[i] = [(name, round(-s, 6)) for s, name in sims]
    for block in (1000, 5):
        got = {}
        for r in sorted(TF.topics_of_texts(t, q, "topic", "item", n=4, block=block).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["item"], []).append((r["topic"], round(r["similarity"], 6)))
        assert got == want
    assert TF.topics_of_texts(t.where("false"), q, "topic", "item").count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(7)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = [("a", x, y) for x, y in zip(path, path[1:])] + [("a", 7, i) for i in range(8, 40)] + [("b", 7, 3), ("b", 5, 5)]
    got = {(r["_g"], r["_id"]): r["_c"] for r in components(spark.createDataFrame(edges, "_g string, _u long, _x long")).collect()}
    assert got == {**{("a", i): 100 for i in path}, **{("a", i): 7 for i in range(7, 40)}, ("b", 7): 3, ("b", 3): 3, ("b", 5): 5}
