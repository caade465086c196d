"""Neighbour-graph reduction against dense eigenvectors."""
import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import spectral as S


def _graph(V, k):
    length = np.linalg.norm(V, axis=1)
    U = V / np.where(length == 0, 1, length)[:, None]
    sim = np.round(U @ U.T, 9)
    np.fill_diagonal(sim, -np.inf)
    W = np.zeros_like(sim)
    for i in range(len(V)):
        for j in sorted(range(len(V)), key=lambda j: (-sim[i, j], j))[:k]:
            W[i, j] = W[j, i] = max(0.0, sim[i, j])
    d = W.sum(1)
    return W / np.sqrt(np.where(d == 0, 1, d))[:, None] / np.sqrt(np.where(d == 0, 1, d))[None, :]


def test_dimensions_are_eigenvectors(spark):
    rng = np.random.default_rng(9)
    groups = {"ring": np.array([[np.cos(t), np.sin(t), 0.2] for t in np.linspace(0, 2 * np.pi, 60, endpoint=False)]),
              "blobs": np.vstack([rng.normal(size=(20, 5)) * 0.6 + at for at in np.eye(5)[:3] * 2]),
              "small": rng.normal(size=(6, 5)), None: rng.normal(size=(40, 5)) + 1.0}
    rows = [(g, i, [float(x) for x in v]) for g, V in groups.items() for i, v in enumerate(V)]
    df = spark.createDataFrame(rows, "grp string, id long, vec array<double>").repartition(3)
    got = {}
    for r in S.spectral_reduce(df, ["grp"], "id", "vec", dims=2, k=6, tol=1e-4, tile=32).collect():
        got.setdefault(r["grp"], {})[r["id"]] = r
    assert sum(len(v) for v in got.values()) == len(rows)
    assert all(not r["reduced"] and r["vec"] == [float(x) for x in groups["small"][i]] for i, r in got["small"].items())
    for g in ("ring", "blobs", None):
        N = _graph(groups[g], 6)
        X = np.array([got[g][i]["vec"] for i in range(len(groups[g]))])
        theta = np.array(got[g][0]["eigenvalues"])
        want = np.sort(np.linalg.eigvalsh(N))[::-1]
        assert np.allclose(theta, want[1:3], atol=1e-6), g
        assert np.allclose(X.T @ X, np.eye(2), atol=1e-6)
        assert np.linalg.norm(N @ X - X * theta, axis=0).max() <= 2e-4
        assert np.allclose(np.array(got[g][0]["residuals"]), np.linalg.norm(N @ X - X * theta, axis=0), atol=1e-5)
    assert S.spectral_reduce(df.where("false"), ["grp"], "id", "vec").count() == 0
