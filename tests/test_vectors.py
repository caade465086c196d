import hashlib

import numpy as np
import pytest

from colloquy.operators import vectors as V


def _pts(spark):
    rows = [("g", 1, [1.0, 0.0]), ("g", 2, [3.0, 2.0]), ("g", 3, [2.0, 10.0]), ("g", 4, [10.0, 4.0]),
            ("h", 5, [0.0, 0.0]), ("h", 6, [0.0, 0.0])]
    return spark.createDataFrame(rows, "grp string, id long, vec array<double>")


def test_median_interpolates_and_mean(spark):
    med = {r.grp: r.median_vec for r in V.median_vectors(_pts(spark), ["grp"], "vec").collect()}
    assert med["g"] == [2.5, 3.0] and med["h"] == [0.0, 0.0]
    mean = {r.grp: r.mean_vec for r in V.mean_vectors(_pts(spark), ["grp"], "vec").collect()}
    assert mean["g"] == [4.0, 4.0]


def test_standardize_population_std_zero_std_is_one(spark):
    z = {r.id: r.z for r in V.standardize(_pts(spark), ["grp"], "vec", "z").collect()}
    x = np.array([[1, 0], [3, 2], [2, 10], [10, 4]], dtype=float)
    want = (x - x.mean(0)) / x.std(0)
    for i, idx in enumerate([1, 2, 3, 4]):
        assert z[idx] == pytest.approx(list(want[i]))
    assert z[5] == [0.0, 0.0]


def test_medoid_ties_smallest_id(spark):
    m = {r.grp: r.medoid_id for r in V.medoid(_pts(spark), ["grp"], "id", "vec", "median").collect()}
    assert m["h"] == 5
    x = np.array([[1, 0], [3, 2], [2, 10], [10, 4]], dtype=float)
    d = ((x - np.median(x, 0)) ** 2).sum(1)
    assert m["g"] == [1, 2, 3, 4][int(np.argmin(d))]


def test_append_mean_row(spark):
    u = V.append_mean_row(_pts(spark), ["grp"], "id", "vec").collect()
    means = [r for r in u if r.is_mean]
    assert len(u) == 8 and {r.grp for r in means} == {"g", "h"} and all(r.id is None for r in means)


def test_hash_embed_matches_python(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT! été"), (2, ""), (3, None)], "id long, text string")
    out = {r.id: r.vec for r in V.hash_embed(df, "text", 16).collect()}
    want = np.zeros(16)
    for tok in ["the", "cat", "the", "cat", "été"]:
        want[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % 16] += 1
    want /= np.linalg.norm(want)
    assert out[1] == pytest.approx(list(want))
    assert out[2] == [0.0] * 16 and out[3] == [0.0] * 16


def test_projection_matches_numpy(spark):
    R = np.array(V.sign_matrix(2, 3))
    out = {r.id: r.proj for r in V.project(_pts(spark), "vec", 2, 3).collect()}
    assert out[2] == pytest.approx(list(R @ np.array([3.0, 2.0])))
    assert abs(R[0][0]) == pytest.approx(1 / np.sqrt(3))


def test_exact_median_band_path_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=4001), np.full(3000, 0.25)])  # heavy ties near the middle
    rows = [("hot", float(v)) for v in vals] + [("even", 1.0), ("even", 4.0), ("even", 2.0), ("even", 10.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    for few, bins in ((100_000, 1024), (50, 7), (2, 2)):
        got = {r.k: r.value for r in V.exact_median(df, ["k"], "x", few, bins).collect()}
        assert got["hot"] == np.median(vals)
        assert got["even"] == 3.0


def test_exact_median_of_awkward_values(spark):
    inf = float("inf")
    groups = {"two": [0.25] * 300 + [0.75] * 300, "wide": [10.0 ** k for k in range(-300, 300)], "inf": [-inf] * 5 + [1.0, 2.0] * 60 + [inf] * 4,
              "all_inf": [inf] * 200, "one": [5.0], "copies": [3.5] * 500, "huge": [1.7e308, -1.7e308] * 150 + [0.0], None: [2.0, 9.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("two", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    for few, bins in ((100_000, 1024), (20, 64)):
        got = {r.k: r.value for r in V.exact_median(df, ["k"], "x", few, bins).collect()}
        assert got == {k: float(np.median(v)) for k, v in groups.items()}
    assert V.exact_median(df.where("false"), ["k"], "x").count() == 0
