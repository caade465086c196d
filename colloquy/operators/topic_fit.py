"""Fit topics from vectors, choose diverse terms for them, and find the topics of many texts.

Fit: topics are the connected dense regions of the exact k-nearest-neighbour
graph (cosine) of each group. A point is dense if its k nearest neighbours all
have a similarity of ``bar`` or more; dense points that are among each other's
neighbours (either way) are connected; a point that is not dense joins the
topic of its nearest dense neighbour within reach of the bar. Regions of fewer than
``min_size`` rows, and points that no region reaches, are outliers (topic -1); topics are numbered by size.

Neighbours come from tasks of two parts of a group (see ``blocks``), k per point and part,
merged by an aggregation over at most k rows a part. The work is quadratic in
the group's size, as exact neighbours are, what is shuffled is not; no task holds a group of more than one tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.vectors import as_double_array, normalize
from colloquy.operators.blocks import Smallest, blocks, deal, matrix, part_pairs, sides
from colloquy.operators.density import group_points
from colloquy.operators.graph import components
from colloquy.operators.positions import positional_index
from colloquy.session import ship_package, stored

PLACES = 9  # similarities equal to so many decimals are ties


def _top(S: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; ties go to the first column."""
    return np.argsort(-S, axis=1, kind="stable")[:, :k]


# ---------------------------------------------------------------------------
# fit
# ---------------------------------------------------------------------------

def _part_neighbours(k: int, least: float):
    def found(group: pa.Scalar, ids: np.ndarray, best: Smallest) -> pa.Table:
        some = np.isfinite(best.value)
        n = some.sum(axis=1)
        near = pa.StructArray.from_arrays([pa.array(-(-best.value[some] + 0.0)), pa.array(best.id[some])], names=["_neg", "_other"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[n > 0])).astype(np.int32)), near)
        return pa.table([pa.repeat(group, len(lists)), pa.array(ids[n > 0]), lists], names=["_g", "_id", "_near"])

    def limit(best: Smallest, rows: slice) -> np.ndarray:
        last = best.last(rows)  # of equal similarities the first id stays
        return np.where(np.isfinite(last), last - 0.4 * 10.0 ** -PLACES, best.most + 10.0 ** -PLACES)

    def fn(key: tuple, table: pa.Table) -> pa.Table:
        two = sides(key, table, ["_id"]) or [table.slice(0, 0)]
        ids, X = [t["_id"].to_numpy() for t in two], [matrix(t["_v"]) if len(t) else np.zeros((0, 1)) for t in two]
        best = [Smallest(len(x), k, -least) for x in X]
        for i, j in blocks(len(X[0]), len(X[-1])):
            S = -(X[0][i] @ X[-1][j].T)
            if len(two) == 1:
                own = np.arange(max(i.start, j.start), min(i.stop, j.stop))
                S[own - i.start, own - j.start] = np.inf
            exact = lambda a, b: np.round(S[a, b], PLACES)  # noqa: B023, E731
            best[0].take(i, S, limit(best[0], i), 10.0 ** -PLACES, exact, ids[-1][j])
            if len(two) > 1:
                best[1].take(j, S, limit(best[1], j), 10.0 ** -PLACES, exact, ids[0][i], turned=True)
        return pa.concat_tables([found(key[0], n, b) for n, b in zip(ids, best)])
    return fn


def nearest_neighbours(points: DataFrame, k: int, tile: int, least: float = -np.inf) -> DataFrame:
    """(_g, _id, _rank from 0, _other, _sim): the k nearest by cosine of each point (_g, _id, unit vector _v); ties by id.

    Only neighbours with a similarity of ``least`` or more are given.
    """
    near = part_pairs(*deal(points, ["_g"], tile), ["_g"]).groupBy("_g", "_a", "_b").applyInArrow(
        _part_neighbours(k, least), "_g string, _id long, _near array<struct<_neg: double, _other: long>>")
    merged = near.groupBy("_g", "_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))
    return merged.select("_g", "_id", F.posexplode("_near").alias("_rank", "_n")).select(
        "_g", "_id", "_rank", "_n._other", (-F.col("_n._neg")).alias("_sim"))


def fit_topics(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, k: int = 4, bar: float = 0.88,
               min_size: int = 3, tile: int = 256) -> DataFrame:
    """(groups..., id, topic) for every row with a vector; -1 for outliers."""
    points = group_points(df, group_cols, id_col, vec_col)
    unit = points.select("_g", "_id", normalize("_v").alias("_v"))
    strong = stored(nearest_neighbours(unit, k, tile, bar), "neighbours")
    dense = stored(strong.groupBy("_g", "_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n"), "dense")
    to_dense = strong.join(dense.withColumnRenamed("_id", "_other"), ["_g", "_other"])
    edges = to_dense.join(dense, ["_g", "_id"]).select("_g", F.col("_id").alias("_u"), F.col("_other").alias("_x"))
    # a dense point whose neighbours are all not dense is a region of its own
    alone = dense.select("_g", F.col("_id").alias("_u"), F.col("_id").alias("_x"))
    region = components(edges.unionByName(alone))
    border = to_dense.join(dense, ["_g", "_id"], "left_anti").groupBy("_g", "_id").agg(
        F.min(F.struct("_rank", "_other")).alias("_f")).select("_g", "_id", F.col("_f._other").alias("_other"))
    border = border.join(region.withColumnRenamed("_id", "_other"), ["_g", "_other"]).select("_g", "_id", "_c")
    placed = stored(region.unionByName(border), "placed")
    sizes = placed.groupBy("_g", "_c").agg((-F.count(F.lit(1))).alias("_neg"), F.min("_id").alias("_first")).where(
        F.col("_neg") <= -min_size)
    numbered = positional_index(sizes, ["_g"], ["_neg", "_first"], "topic").select("_g", "_c", "topic")
    topics = placed.join(numbered, ["_g", "_c"]).select("_g", "_id", "topic")
    out = points.join(topics, ["_g", "_id"], "left")
    return out.select(*group_cols, F.col("_key").alias(id_col), F.coalesce("topic", F.lit(-1)).cast("int").alias("topic"))


# ---------------------------------------------------------------------------
# terms
# ---------------------------------------------------------------------------

def _rerank(topic_col: str, n: int, diversity: float):
    def fn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("term")
        V = np.stack(rows["_vec"].to_numpy())
        length = np.linalg.norm(V, axis=1)
        V = V / np.where(length == 0, 1.0, length)[:, None]
        S = V @ V.T
        value = rows["relevance"].to_numpy()
        taken, scores = [], []
        left = np.ones(len(rows), dtype=bool)
        while left.any() and len(taken) < n:
            score = value if not taken else (1 - diversity) * value - diversity * S[:, taken].max(axis=1)
            score = np.where(left, np.round(score, PLACES), -np.inf)
            taken.append(int(np.argmax(score)))  # ties: the first term
            scores.append(float(score[taken[-1]]))
            left[taken[-1]] = False
        return pd.DataFrame({topic_col: rows[topic_col].iloc[0], "term": rows["term"].to_numpy()[taken],
                             "score": scores, "rank": np.arange(1, len(taken) + 1)})
    return fn


def diverse_terms(weights: DataFrame, topic_col: str, vectors, n: int = 10, diversity: float = 0.5,
                  candidates: int = 30) -> DataFrame:
    """(topic, term, score, rank): maximal marginal relevance among each topic's ``candidates`` best terms.

    Relevance is the weight over the topic's largest. The first term is the
    most relevant one; every next has the largest (1 - diversity) * relevance - diversity * (largest cosine to
    a term already taken); ties go to the first term by name. ``vectors`` adds the column ``_vec`` to rows with a ``term``.
    A task sees at most ``candidates`` rows of a topic.
    """
    ship_package(weights.sparkSession)
    best = Window.partitionBy(topic_col).orderBy(F.col("weight").desc(), F.col("term"))
    top = weights.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= candidates)
    largest = Window.partitionBy(topic_col)
    top = top.withColumn("relevance", F.col("weight") / F.max("weight").over(largest))
    kind = weights.schema[topic_col].dataType.simpleString()
    return vectors(top.select(topic_col, "term", "relevance")).groupBy(topic_col).applyInPandas(
        _rerank(topic_col, n, diversity), f"`{topic_col}` {kind}, term string, score double, rank int")


# ---------------------------------------------------------------------------
# topics of many texts
# ---------------------------------------------------------------------------

def _best_of_block(n: int):
    def fn(key: tuple, queries: pd.DataFrame, topics: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or topics.empty:
            return pd.DataFrame(columns=["_q", "_t", "_neg"])
        topics = topics.sort_values("_t")
        S = np.round(np.stack(queries["_v"].to_numpy()) @ np.stack(topics["_v"].to_numpy()).T, PLACES) + 0.0
        at = _top(S, min(n, S.shape[1]))
        return pd.DataFrame({"_q": np.repeat(queries["_q"].to_numpy(), at.shape[1]), "_t": topics["_t"].to_numpy()[at].reshape(-1),
                             "_neg": -np.take_along_axis(S, at, axis=1).reshape(-1)})
    return fn


def topics_of_texts(topic_vecs: DataFrame, queries: DataFrame, topic_col: str, query_col: str, vec_col: str = "topic_vec",
                    query_vec: str = "query_vec", n: int = 10, block: int = 2_000) -> DataFrame:
    """(query, topic, similarity, rank): the n topics of largest cosine to each query; ties by topic.

    Both sides are numbered and cut into blocks of about ``block`` rows; every pair of
    blocks is one matrix product that keeps n topics per query, and these are merged per query, so neither
    side is broadcast and no pair of rows leaves a task.
    """
    ship_package(queries.sparkSession)

    def side(df: DataFrame, key: str, vec: str, number: str, other: int) -> DataFrame:
        rows = stored(positional_index(df.select(F.col(key).alias("_key"), normalize(as_double_array(vec)).alias("_v"),
                                                 F.lit(0).alias("_all")), ["_all"], ["_key"], number), f"blocks-{number}")
        return rows.withColumn("_mine", F.floor(F.col(number) / block)).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.lit(max(0, other - 1)))))

    counts = [-(-df.count() // block) for df in (queries, topic_vecs)]
    q = side(queries, query_col, query_vec, "_q", counts[1])
    t = side(topic_vecs, topic_col, vec_col, "_t", counts[0])
    pairs = q.select(F.col("_mine").alias("_a"), F.col("_other").cast("long").alias("_b"), "_q", "_v").groupBy("_a", "_b").cogroup(
        t.select(F.col("_other").cast("long").alias("_a"), F.col("_mine").alias("_b"), "_t", "_v").groupBy("_a", "_b"))
    found = pairs.applyInPandas(_best_of_block(n), "_q long, _t long, _neg double")
    best = Window.partitionBy("_q").orderBy("_neg", "_t")  # n rows a block of topics
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    names = lambda side, key, name: side.where("_other = 0").select(key, F.col("_key").alias(name))
    out = found.join(names(q, "_q", query_col), "_q").join(names(t, "_t", topic_col), "_t")
    return out.select(query_col, topic_col, (-F.col("_neg")).alias("similarity"), "rank")
