"""All pairs by parts: how often points are copied, and results against plain versions."""
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import blocks as B
from colloquy.operators import clustering as C
from colloquy.operators import scoring as S
from colloquy.operators import similarity_join as SJ
from colloquy.operators import spectral
from colloquy.operators import topic_fit as TF
from colloquy.operators import vectors as V
from colloquy.sources.taxonomy import TOPIC_LEVEL1


def test_copies_do_not_grow_with_the_number_of_tiles(spark):
    pts = spark.range(3_000).select(F.lit("g").alias("g"), F.col("id").alias("_id"))
    pairs = B.part_pairs(*B.deal(pts, ["g"], 16), ["g"])  # 188 tiles
    assert pairs.groupBy("_id").count().agg(F.max("count")).first()[0] <= B.PARTS
    parts = {frozenset((r["_a"], r["_b"])) for r in pairs.select("_a", "_b").distinct().collect()}
    assert parts == {frozenset(p) for p in itertools.combinations_with_replacement(range(B.PARTS), 2)}


def _silhouettes(X, labels):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mean = {c: D[i, labels == c].sum() / max((labels == c).sum() - (c == own), 1) for c in set(labels)}
        a, others = mean.pop(own), list(mean.values())
        out.append(None if not others else 0.0 if (labels == own).sum() == 1 else (min(others) - a) / max(a, min(others)))
    return out


@pytest.mark.parametrize("tile", [7, 500])
def test_silhouettes_of_several_labellings_share_their_distances(spark, tile):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(90, 3))
    labels = {2: rng.integers(0, 2, 90), 5: rng.integers(0, 5, 90), 9: np.where(np.arange(90) == 4, 1, 0), 1: np.zeros(90, int)}
    rows = [("g", f"p{i}", [float(v) for v in x], [(k, int(c[i])) for k, c in labels.items()]) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "g string, id string, vec array<double>, l array<struct<k: int, cluster: long>>").repartition(3)
    got = {(r["k"], r["id"]): r["s"] for r in C.silhouettes_of_labellings(df, ["g"], "id", "vec", "l", tile).collect()}
    assert len(got) == 360
    for k, c in labels.items():
        for i, s in enumerate(_silhouettes(X, c)):
            assert got[k, f"p{i}"] == (s if s is None else pytest.approx(s, abs=1e-7))


def test_kmeans_of_large_groups_by_jobs_is_that_of_one_call(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, [float(v) for v in rng.normal(size=2)]) for g, n in (("a", 70), ("b", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>")
    seeds = C._seeds(df, C.k_candidates(df, ["g"], 4).drop("n"), ["g"], "id", "vec", None, 4)
    one, jobs = ({(r["g"], r["k"], r["id"]): r["cluster"] for r in C.lloyd(df, seeds, ["g"], "id", block=16, whole=w)[0].collect()}
                 for w in (1_000, 50))
    assert one == jobs and len(one) == 3 * 110
    with pytest.raises(Exception, match="no stable assignment after 1 rounds"):
        C.lloyd(df, seeds, ["g"], "id", block=16, whole=50, max_rounds=1)
    assert C.MAX_ROUNDS > 300  # 51,282 points as one group took 274 rounds for k = 9, and rounds grow with the points


def test_only_neighbours_of_the_bar_or_more(spark):
    rng = np.random.default_rng(1)
    X = np.round(rng.normal(size=(60, 3)), 1)
    X[10:25] = X[9]  # copies tie by id
    U = X / np.linalg.norm(X, axis=1)[:, None]
    want = set()
    sims = np.round(U @ U.T, TF.PLACES)
    for i in range(60):
        for rank, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:4]):
            if sims[i, j] >= 0.8:
                want.add((i, rank, j))
    df = spark.createDataFrame([("g", i, [float(x) for x in u]) for i, u in enumerate(U)], "_g string, _id long, _v array<double>")
    got = {(r["_id"], r["_rank"], r["_other"]) for r in TF.nearest_neighbours(df, 4, 9, 0.8).collect()}
    assert got == want


def test_pairs_of_texts_are_made_inside_tasks(spark):
    df = spark.createDataFrame([(i, f"a b{i % 7} c{i % 5}") for i in range(40)], "id long, text string")
    plan = SJ.cosine_pairs(SJ.term_vectors(df, "id", "text"), "id", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "term#" not in plan  # no join of rows by their terms


def test_vectors_are_counted_in_little_memory():
    buckets = pa.array([[i % 64] * 2_000 for i in range(2_000)], pa.list_(pa.int32()))
    tracemalloc.start()
    out = V._unit_counts(buckets, 64)
    assert tracemalloc.get_traced_memory()[1] < 20e6  # two numbers for each of four million tokens are 64 MB
    tracemalloc.stop()
    assert [v.index(1.0) for v in out.to_pylist()] == [i % 64 for i in range(2_000)]
    assert V._unit_counts(pa.array([[], [3, 3]], pa.list_(pa.int32())).slice(1), 4).to_pylist() == [[0.0, 0.0, 0.0, 1.0]]


def test_texts_are_read_once_for_all_labels(spark):
    docs = spark.createDataFrame([(1, "Sport and politics; sport"), (2, None), (3, "xx yy")], "doc_id long, text string")
    scorer = S.KeywordScorer()
    plain = scorer.score_pairs(S.text_label_pairs(docs, TOPIC_LEVEL1), TOPIC_LEVEL1)
    ready = S.text_label_pairs(scorer.prepare(docs, TOPIC_LEVEL1), TOPIC_LEVEL1, keep=["doc_id", "_ntok", "_evidence"])
    ready = scorer.score_pairs(ready, TOPIC_LEVEL1)
    assert "text" not in ready.columns
    rows = lambda d: sorted((r["doc_id"], r["label"], r["contradiction"], r["entailment"]) for r in d.collect())
    assert rows(plain) == rows(ready)


def test_reduction_of_a_group_in_one_call_is_that_by_joins(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, [float(v) for v in rng.normal(size=4) + (2.0 if i % 2 else -2.0)]) for g, n in (("a", 40), ("b", 25), ("few", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>")
    one, joins = ({(r["g"], r["id"]): r for r in spectral.spectral_reduce(df, ["g"], "id", "vec", k=6, whole=w).collect()} for w in (100, 30))
    assert one.keys() == joins.keys() and not one["few", 0]["reduced"]
    for key, r in one.items():
        assert r["vec"] == pytest.approx(joins[key]["vec"], abs=5e-4)
