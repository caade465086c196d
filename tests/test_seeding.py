"""Oversampled seeds: repeatable, cheap, and no worse than the first vectors."""
import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import seeding as S


def test_seeds_find_far_groups_and_cost_no_more(spark):
    rng = np.random.default_rng(5)
    at = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    groups = {"blobs": np.vstack([rng.normal(size=(n, 2)) * 0.3 + a for n, a in zip((200, 30, 8, 5), at)]),
              "few": np.repeat([[1.0, 2.0], [3.0, 4.0]], 20, axis=0), "one": np.ones((1, 2)), None: rng.normal(size=(50, 2))}
    rows = [(g, i, [float(x) for x in v]) for g, V in groups.items() for i, v in enumerate(V)] + [("one", 9, None)]
    df = spark.createDataFrame(rows, "grp string, id long, vec array<double>")

    def seeds(frame):
        return sorted(((r["grp"], r["cluster"], tuple(r["center"])) for r in S.oversampled_seeds(frame, ["grp"], "id", "vec", 4).collect()), key=str)
    got = seeds(df)
    assert got == seeds(df.repartition(7))
    centers = {g: np.array([c for x, _, c in got if x == g]) for g in groups}
    assert len(centers["few"]) == 2 and len(centers["one"]) == 1 and len(centers["blobs"]) == 4
    assert all(np.abs(centers["blobs"] - a).max(axis=1).min() < 1.0 for a in at)  # every blob has a seed, however small
    chosen, costs = S.best_seeds(df, ["grp"], "id", "vec", 4)
    costs = {r["grp"]: r for r in costs.collect()}
    picked = {g: np.array([r["center"] for r in chosen.where(F.col("grp").eqNullSafe(F.lit(g))).collect()]) for g in groups}
    for g, V in groups.items():
        cost = lambda C: ((V[:, None] - C[None]) ** 2).sum(-1).min(1).sum()
        assert abs(costs[g]["cost_oversampled"] - cost(centers[g])) < 1e-6
        assert abs(costs[g]["cost"] - cost(picked[g])) < 1e-6 and costs[g]["cost"] <= costs[g]["cost_first"]
    assert costs["blobs"]["cost_oversampled"] < 0.2 * costs["blobs"]["cost_first"]
    assert S.oversampled_seeds(df.where("false"), ["grp"], "id", "vec", 3).count() == 0
