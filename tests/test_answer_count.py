"""The parts of ``group_answer_count`` that were rewritten to grow with the rows."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import blocks as B
from colloquy.operators import clustering as C
from colloquy.operators import vectors as V
from colloquy.plans.consistency import with_mean_row


def _points(spark, sizes, dim=5, clusterings=3, seed=0):
    """Points of groups with clusterings of 2, 3, ... clusters; some vectors are equal, one is zero."""
    rng, rows = np.random.default_rng(seed), []
    for g, n in sizes.items():
        X = rng.normal(size=(n, dim)).round(1)
        X[n // 2] = X[0]
        X[n - 1] = 0
        for x in X:
            rows.append((g, len(rows), x.tolist(), [(k, int(rng.integers(k))) for k in range(2, 2 + clusterings)]))
    return spark.createDataFrame(rows, "g string, id long, vec array<double>, _labels array<struct<k int, cluster int>>"), rows


def _brute(rows, distance):
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        X, L = np.array([r[2] for r in mine]), np.array([[c for _, c in r[3]] for r in mine])
        D = distance(X)
        np.fill_diagonal(D, 0.0)
        for q, (k, _) in enumerate(mine[0][3]):
            for i, r in enumerate(mine):
                same = L[:, q] == L[i, q]
                a = D[i][same].sum() / (same.sum() - 1) if same.sum() > 1 else 0.0
                b = [D[i][L[:, q] == c].mean() for c in set(L[:, q]) - {L[i, q]}]
                most = max(a, min(b)) if b else 0.0
                out[g, k, r[1]] = None if not b else 0.0 if same.sum() == 1 or most == 0 else (min(b) - a) / most
    return out


def _cosine(X):
    U = X / np.where((X == 0).all(axis=1), 1.0, np.linalg.norm(X, axis=1))[:, None]
    return 1.0 - U @ U.T


def _euclid(X):
    return np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))


def _same(found, want):
    found = {(r["g"], r["k"], r["id"]): r["s"] for r in found.collect()}
    assert found.keys() == want.keys()
    for key, s in want.items():
        assert (found[key] is None) == (s is None) and (s is None or abs(found[key] - s) < 1e-9), key


def test_cosine_silhouettes_of_packed_clusterings(spark):
    df, rows = _points(spark, {"a": 41, "b": 7, "c": 1})
    want = _brute(rows, _cosine)
    _same(C.silhouette_samples_cosine(df, ["g"], "id", "vec", labels_col="_labels"), want)
    _same(C._cosine_of_labellings(df, ["g"], "id", "vec", "_labels", block=5), want)
    long = df.select("g", "id", "vec", F.inline("_labels"))
    _same(C.silhouette_samples_cosine(long, ["g", "k"], "id", "vec", "cluster"), want)


def test_euclidean_silhouettes_with_long_and_short_runs(spark):
    for clusterings in (1, 8):
        df, rows = _points(spark, {"a": 600, "b": 9}, clusterings=clusterings)
        want = _brute(rows, _euclid)
        _same(C.silhouettes_of_sweep(df, None, ["g"], "id", "vec", tile=64), want)


def test_kinds_tell_rows_apart():
    w = np.array([[1.0, 0, 2], [0, 1, 0], [1, 0, 2], [0, 0, 0], [0, 1, 0]])
    kind = C._kinds(w)
    assert [[kind[i] == kind[j] for j in range(5)] for i in range(5)] == [[(w[i] == w[j]).all() for j in range(5)] for i in range(5)]
    assert len(set(C._kinds(w[:, :0]))) == 1


def test_rounds_are_the_same_in_one_call_and_in_jobs(spark):
    df, _ = _points(spark, {"a": 90, "b": 25, "c": 12})
    ks = C.k_candidates(df, ["g"], 4).drop("n")
    seeds = C._seeds(df, ks, ["g"], "id", "vec", None)
    runs = []
    for whole in (1000, 20):
        by_point, centres = C.lloyd(df, seeds, ["g"], "id", "vec", block=8, whole=whole, by_point=True)
        rows = {r["id"]: (r["g"], r["vec"], sorted(map(tuple, r["_labels"]))) for r in by_point.collect()}
        runs.append((rows, {(r["g"], r["k"], r["cluster"]): np.round(r["center"], 9).tolist() for r in centres.collect()}))
    assert runs[0] == runs[1]
    by_k = C.lloyd(df, seeds, ["g"], "id", "vec")[0].collect()
    assert {(r["id"], r["k"], r["cluster"]) for r in by_k} == {(i, *x) for i, (_, _, labels) in runs[0][0].items() for x in labels}
    assert {i: v for i, (_, v, _) in runs[0][0].items()} == {r["id"]: r["vec"] for r in df.collect()}


def test_points_are_made_once_for_rows_and_means(spark):
    made = spark.sparkContext.accumulator(0)

    def vec(i):
        made.add(1)
        return [float(i), 1.0]

    df = spark.range(30).select((F.col("id") % 3).alias("g"), "id", F.udf(vec, T.ArrayType(T.DoubleType()))("id").alias("vec"))
    u = with_mean_row(df, ["g"], "id", "vec")
    assert made.value == 30
    assert sorted(r["vec"] for r in u.where("is_mean").collect()) == [[13.5, 1.0], [14.5, 1.0], [15.5, 1.0]]
    assert u.select("_row").distinct().count() == u.count() == 33


def test_even_parts_copy_many_groups_less(spark):
    pts = spark.range(64 * 400).select((F.col("id") % 64).alias("g"), F.col("id").alias("_id"))
    dealt, pairs = B.deal(pts, ["g"], 10, even=True)
    assert pairs <= 64 * 10 < B.deal(pts, ["g"], 10)[1]
    assert dealt.count() == 64 * 400
    assert B.deal(pts.where("g = 0"), ["g"], 10, even=True)[1] > 1  # one group is work for several tasks


def test_tokens_hashed_once_give_the_buckets_of_the_rule(spark):
    texts = [None, "", " ", "One two  TWO, three3three\n", "éÀ ß straße Ω中文 x", "...", "a-b_c'd", " lead", "trail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = V.hash_embed(df, "t", 8).select("id", "vec", V.token_buckets("t", 8).alias("b")).collect()
    for r in rows:
        n = np.bincount(r["b"], minlength=8).astype(float)
        assert np.allclose(r["vec"], n / (np.linalg.norm(n) or 1.0), atol=1e-15), r
    assert rows[7]["b"] == [int(hashlib.md5(b"lead").hexdigest()[:8], 16) % 8]


def test_projection_sums_in_order_and_gives_nulls_for_other_lengths(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2, 0.3]), (1, None), (2, [1.0, None, 2.0]), (3, [1.0]), (4, [])], "id int, v array<double>")
    found = {r["id"]: r["p"] for r in V.project(df, "v", 3, 4, "p").collect()}
    want = []
    for row in V.sign_matrix(3, 4):
        total = 0.0
        for x, r in zip([0.1, 0.2, 0.3], row):
            total += x * r
        want.append(total)
    assert found == {0: want, 1: [None] * 4, 2: [None] * 4, 3: [None] * 4, 4: [None] * 4}
