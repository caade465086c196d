import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import clustering as C


def _blobs(spark, seed=3, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for g, shift in (("g1", 0.0), ("g2", 5.0)):
        for i in range(n):
            c = i % 3
            v = rng.normal(size=3) * 0.5 + np.array([c * 3.0 + shift, -c * 2.0, c])
            rows.append((g, int(i + (0 if g == "g1" else 1000)), c, [float(x) for x in v]))
    return spark.createDataFrame(rows, "grp string, id long, cluster long, vec array<double>"), rows


def _brute(rows, metric):
    out = {}
    for g in {r[0] for r in rows}:
        rs = [r for r in rows if r[0] == g]
        X = np.array([r[3] for r in rs])
        lab = np.array([r[2] for r in rs])
        if metric == "euclid":
            D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
        else:
            U = X / np.linalg.norm(X, axis=1, keepdims=True)
            D = 1 - U @ U.T
            np.fill_diagonal(D, 0.0)
        s = []
        for i in range(len(rs)):
            own = lab == lab[i]
            a = D[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else 0.0
            b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
            s.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
        out[g] = (np.mean(s), dict(zip([r[1] for r in rs], s)))
    return out


def test_euclidean_silhouette_matches_brute_force_across_tiles(spark):
    df, rows = _blobs(spark)
    want = _brute(rows, "euclid")
    s = C.silhouette_samples_euclid(df, ["grp"], "id", "vec", "cluster", tile=16)  # 4 tiles per group
    per = {r.id: r.s for r in s.collect()}
    for g, (mean, samples) in want.items():
        for i, v in samples.items():
            assert per[i] == pytest.approx(v, abs=1e-9)
    means = {r.grp: r.silhouette for r in C.silhouette(s, ["grp"]).collect()}
    assert means["g1"] == pytest.approx(want["g1"][0], abs=1e-9)


def test_cosine_silhouette_matches_brute_force(spark):
    df, rows = _blobs(spark)
    want = _brute(rows, "cosine")
    s = C.silhouette_samples_cosine(df, ["grp"], "id", "vec", "cluster")
    means = {r.grp: r.silhouette for r in C.silhouette(s, ["grp"]).collect()}
    assert means["g2"] == pytest.approx(want["g2"][0], abs=1e-9)


def test_singleton_cluster_scores_zero(spark):
    rows = [("g", 1, 0, [0.0, 0.0]), ("g", 2, 0, [0.0, 1.0]), ("g", 3, 1, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "grp string, id long, cluster long, vec array<double>")
    s = {r.id: r.s for r in C.silhouette_samples_euclid(df, ["grp"], "id", "vec", "cluster").collect()}
    assert s[3] == 0.0


def test_kmeans_sweep_invariants(spark):
    df, _ = _blobs(spark, n=12)
    a = C.kmeans_sweep(df.drop("cluster"), ["grp"], "id", "vec")
    rows = a.collect()
    ks = {(r.grp, r.k) for r in rows}
    assert ks == {(g, k) for g in ("g1", "g2") for k in range(2, 11)}
    per = {}
    for r in rows:
        per.setdefault((r.grp, r.k), []).append(r)
        assert 0 <= r.cluster < r.k
    assert all(len(v) == 12 for v in per.values())  # every point exactly once per k
    again = C.kmeans_sweep(df.drop("cluster").repartition(3), ["grp"], "id", "vec")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))  # order / partitioning free


def test_k_candidates_skip_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)], "grp string, id long")
    ks = sorted((r.grp, r.k) for r in C.k_candidates(df, ["grp"]).collect())
    assert ks == [("b", 2)]


def test_k_rules(spark):
    sc = spark.createDataFrame([("g", 2, 0.5), ("g", 3, 0.7), ("g", 4, 0.7), ("h", 2, None)],
                               "grp string, k int, silhouette double")
    assert {r.grp: r.k for r in C.best_k_first_max(sc, ["grp"]).collect()} == {"g": 3}
    cnt = spark.createDataFrame([("g", 2, 3, 0.3), ("g", 3, 5, 0.5), ("g", 4, 5, 0.5), ("h", 2, 0, 0.0)],
                                "grp string, k int, n_above long, ratio double")
    assert {r.grp: r.k for r in C.best_k_by_count(cnt, ["grp"]).collect()} == {"g": 3, "h": 1}


def test_typical_members_drop_mean_row(spark):
    rows = [("g", 1, 0, [0.0], False), ("g", 2, 0, [1.0], False), ("g", 3, 0, [10.0], False),
            ("g", -1, 1, [100.0], True)]
    df = spark.createDataFrame(rows, "grp string, id long, cluster long, vec array<double>, is_mean boolean")
    out = C.typical_members(df, ["grp"], "id", "vec", flag_col="is_mean").collect()
    assert [(r.cluster, r.medoid_id) for r in out] == [(0, 2)]
    assert F is not None


def _components_brute(X, ids, eps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if D[i, j] <= eps:
                parent[find(i)] = find(j)
    comp = {}
    for i in range(len(ids)):
        comp.setdefault(find(i), []).append(ids[i])
    return {i: min(members) for members in comp.values() for i in members}


def test_eps_components_exact_across_tiles(spark):
    rng = np.random.default_rng(5)
    # a chain that needs several propagation rounds, plus blobs and outliers
    chain = np.array([[i * 0.9, 0.0] for i in range(12)])
    blob = rng.normal(size=(30, 2)) * 0.3 + np.array([30.0, 30.0])
    far = np.array([[100.0, -100.0], [-50.0, 80.0]])
    X = np.vstack([chain, blob, far])
    ids = list(range(1000, 1000 + len(X)))
    order = rng.permutation(len(X))
    rows = [("g", ids[i], [float(v) for v in X[i]]) for i in order]
    df = spark.createDataFrame(rows, "grp string, id long, vec array<double>")
    got = {r.id: r.component for r in C.eps_components(df, ["grp"], "id", "vec", eps=1.0, tile=8).collect()}
    assert got == _components_brute(X, ids, 1.0)
    members, summary = C.dominant_clusters(df, ["grp"], "id", "vec", eps=1.0, tile=8)
    s = summary.first()
    assert s.n == 44 and s.n_clusters == 1 and s.dominant_share == 30 / 44
    m = {r.id: r.cluster for r in members.collect()}
    assert sum(1 for v in m.values() if v == 1) == 30 and all(0.0 <= r.probability <= 1.0 for r in members.collect())


def _lloyd_brute(X, k):
    """Lloyd's rounds from the first k different rows until nothing moves; a lost cluster keeps its centre."""
    firsts = list(dict.fromkeys(map(tuple, X)))[:k]
    centres, last = np.array(firsts, dtype=float), None
    while True:
        d2 = ((X[:, None, :] - centres[None, :, :]) ** 2).sum(-1)
        near = np.argmax(d2 <= d2.min(1, keepdims=True) * (1 + 1e-9) + 1e-9, axis=1)
        if last is not None and (near == last).all():
            return near
        centres = np.array([X[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        last = near


def test_kmeans_runs_to_convergence_with_any_ids(spark):
    rng = np.random.default_rng(9)
    X = np.round(rng.normal(size=(80, 2)) * 3, 2)
    X[1] = X[0]  # equal vectors seed once
    rows = [("g", f"id{i:03d}", [float(v) for v in x]) for i, x in enumerate(X)] + [("tiny", "a", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "grp string, id string, vec array<double>")
    ks = C.k_candidates(df, ["grp"], 5).drop("n")
    got = C.lloyd(df, C._seeds(df, ks, ["grp"], "id", "vec", None, 5), ["grp"], "id", "vec", block=16)[0].collect()
    for k in range(2, 6):
        mine = {r.id: r.cluster for r in got if r.k == k}
        assert [mine[f"id{i:03d}"] for i in range(80)] == list(_lloyd_brute(X, k))
    assert {r.grp for r in got} == {"g"}


def test_silhouette_keeps_string_ids(spark):
    df, rows = _blobs(spark, n=20)
    named = df.withColumn("id", F.concat(F.lit("x"), F.col("id").cast("string")))
    a = {r.id: r.s for r in C.silhouette_samples_euclid(named, ["grp"], "id", "vec", "cluster", tile=8).collect()}
    b = {r.id: r.s for r in C.silhouette_samples_euclid(df, ["grp"], "id", "vec", "cluster", tile=64).collect()}
    assert {k[1:]: pytest.approx(v, abs=1e-9) for k, v in a.items()} == {str(k): v for k, v in b.items()}
