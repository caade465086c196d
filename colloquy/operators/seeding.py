"""Scalable seeding for k-means: oversampling in a few rounds, then a weighted reduction to k.

Each round draws every point of a group with probability
min(1, factor * k * d2 / cost), d2 being its squared distance to the nearest seed so far
and cost their sum: far points are likelier. The draw is a hash of id and
round, so seeding repeats exactly. A round is one pass: the new seeds of a group (about factor * k)
are joined to its points, which keep their d2. At the end every candidate weighs as many points as
are nearest to it, and the candidates of a group, about rounds * factor * k rows, are reduced to k: the
heaviest first, then by weight times d2, then weighted Lloyd rounds among them.

Rules: the first candidate is the point with the smallest hash; ties of any kind go to the smaller id. A group with
fewer different vectors than k has as many seeds as those. Null vectors take no part. ``best_seeds`` compares the
seeds' cost with that of the first different vectors and takes the cheaper for each group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import sq_dist
from colloquy.operators.clustering import first_distinct
from colloquy.operators.density import group_points
from colloquy.operators.joins import join_small
from colloquy.session import stored

ROUNDS, FACTOR = 4, 2.0


def _uniform(number: int):
    return (F.pmod(F.xxhash64("_id", F.lit(number)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _nearest(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """Points with the smaller of ``_d`` and the squared distance to the group's new seeds, and that seed."""
    packed = seeds.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_c", "_s"))).alias("_new"))
    j = join_small(points, packed, on=["_g"], how="left")
    best = F.array_min(F.transform("_new", lambda s: F.struct(sq_dist(F.col("_v"), s["_s"]).alias("d"), s["_c"].alias("c"))))
    j = j.withColumn("_best", best).drop("_new")
    closer = F.col("_best").isNotNull() & (F.col("_d").isNull() | (F.col("_best.d") < F.col("_d")))
    return j.withColumn("_near", F.when(closer, F.col("_best.c")).otherwise(F.col("_near"))).withColumn(
        "_d", F.when(closer, F.col("_best.d")).otherwise(F.col("_d"))).drop("_best")


def reduce_to_k(X: np.ndarray, weight: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """k centres of weighted rows: greedy by weight times distance, then weighted Lloyd rounds."""
    chosen = [int(np.argmax(weight))]
    d2 = ((X - X[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (d2 > 0).any():
        chosen.append(int(np.argmax(weight * d2)))
        d2 = np.minimum(d2, ((X - X[chosen[-1]]) ** 2).sum(axis=1))
    C, before = X[chosen].copy(), None
    for _ in range(rounds):
        near = np.argmin(((X[:, None, :] - C[None]) ** 2).sum(axis=2), axis=1)
        if before is not None and (near == before).all():
            break
        for j in np.unique(near):
            C[j] = np.average(X[near == j], axis=0, weights=weight[near == j])
        before = near
    return C


def _reduced(k: int):
    def fn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_c")
        C = reduce_to_k(np.stack(rows["_s"].to_numpy()), rows["_w"].to_numpy(dtype=np.float64), k)
        return pd.DataFrame({"_g": key[0], "cluster": np.arange(len(C), dtype=np.int32), "center": list(C)})
    return fn


def _with_groups(points: DataFrame, group_cols: list[str]) -> DataFrame:
    return points.groupBy("_g").agg(*(F.first(c).alias(c) for c in group_cols))


def _candidates(points: DataFrame, k: int, rounds: int, factor: float) -> DataFrame:
    """(_g, _c, _s, _w): candidate seeds by id with the number of points nearest to each."""
    first = points.groupBy("_g").agg(F.min(F.struct(_uniform(-1).alias("u"), "_id", "_v")).alias("f"))
    seeds = [stored(first.select("_g", F.col("f._id").alias("_c"), F.col("f._v").alias("_s")), "seeds")]
    state = points.select("_g", "_id", "_v", F.lit(None).cast("double").alias("_d"), F.lit(None).cast("long").alias("_near"))
    for number in range(rounds):
        state = stored(_nearest(state, seeds[-1]), "seed-distances")
        cost = stored(state.groupBy("_g").agg(F.sum("_d").alias("_cost")), "costs")
        drawn = join_small(state, cost, on=["_g"]).where(
            (F.col("_d") > 0) & (_uniform(number) < factor * k * F.col("_d") / F.col("_cost")))
        seeds.append(stored(drawn.select("_g", F.col("_id").alias("_c"), F.col("_v").alias("_s")), "seeds"))
    state = _nearest(state, seeds[-1])
    weights = state.groupBy("_g", F.col("_near").alias("_c")).agg(F.count(F.lit(1)).alias("_w"))
    every = seeds[0]
    for more in seeds[1:]:
        every = every.unionByName(more)
    return every.join(weights, ["_g", "_c"])


def oversampled_seeds(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, k: int, rounds: int = ROUNDS,
                      factor: float = FACTOR) -> DataFrame:
    """(groups..., cluster, center): k seeds per group, as ``clustering.lloyd`` takes them (with a column ``k``)."""
    points = group_points(df, group_cols, id_col, vec_col)
    found = _candidates(points, k, rounds, factor).groupBy("_g").applyInPandas(  # rounds * factor * k rows, about
        _reduced(k), "_g string, cluster int, center array<double>")
    return found.join(_with_groups(points, group_cols), "_g").select(*group_cols, "cluster", "center")


def seed_costs(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, seeds: DataFrame) -> DataFrame:
    """(groups..., cost): the sum of squared distances to the nearest seed."""
    points = group_points(df, group_cols, id_col, vec_col)
    named = seeds.withColumn("_g", F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}))
    blank = points.select("_g", "_id", "_v", F.lit(None).cast("double").alias("_d"), F.lit(None).cast("long").alias("_near"))
    near = _nearest(blank, named.select("_g", F.col("cluster").cast("long").alias("_c"), F.col("center").alias("_s")))
    cost = near.groupBy("_g").agg(F.sum("_d").alias("cost"))
    return cost.join(_with_groups(points, group_cols), "_g").select(*group_cols, "cost")


def best_seeds(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(seeds, costs): per group the cheaper of oversampled seeds and the first different vectors.

    Costs: groups..., ``cost_oversampled``, ``cost_first``, ``cost``.
    """
    over = stored(oversampled_seeds(df, group_cols, id_col, vec_col, k), "oversampled-seeds")
    first = first_distinct(df.where(F.col(vec_col).isNotNull()), group_cols, id_col, vec_col, k)
    first = stored(first.select(*group_cols, F.col("rank").cast("int").alias("cluster"), "center"), "first-seeds")
    key = lambda d: d.withColumn("_g", F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}))
    costs = [key(seed_costs(df, group_cols, id_col, vec_col, s)) for s in (over, first)]
    both = costs[0].withColumnRenamed("cost", "cost_oversampled").join(
        costs[1].drop(*group_cols).withColumnRenamed("cost", "cost_first"), "_g")
    both = stored(both.withColumn("cost", F.least("cost_oversampled", "cost_first")), "seed-costs")
    cheaper = F.col("cost_oversampled") <= F.col("cost_first")
    chosen = key(over).join(both.where(cheaper).select("_g"), "_g", "left_semi").unionByName(
        key(first).join(both.where(~cheaper).select("_g"), "_g", "left_semi"))
    return chosen.drop("_g"), both.drop("_g")
