"""Clustering of many groups at once: Lloyd rounds, silhouettes, k rules.

Layout: points are rows ``(group..., id, vec)``; ids and group keys may be of
any type. All (group, k) clusterings of a sweep advance in the same Spark job
and share one copy of the points. No driver loop over groups.

Silhouettes:

* cosine: linear. With unit vectors x^ and per-cluster sums S_C of unit
  vectors, the mean cosine distance from x to C is (|C| - x^.S_C)/|C|
  (own cluster: remove x itself). One aggregation + one small join.
* Euclidean: no linear form exists, so distances are computed exactly: each
  group's points are dealt to a bounded number of parts (``blocks``), every
  unordered pair of parts is one task that emits per-(point, cluster) sums
  for both sides -- never point pairs. The work is quadratic in a group's size; what is
  shuffled and held is not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.vectors import as_double_array, normalize, sq_dist
from colloquy.operators import vectors as V
from colloquy.operators.blocks import blocks, codes, deal, matrix, part_pairs, sides, tiled
from colloquy.operators.joins import join_small
from colloquy.session import checkpoint_dir, ship_package, stored

MAX_K = 10
ROWS, COLUMNS = 256, 1024  # of a block of distances; one stays in a core's cache
MAX_ROUNDS = 10_000  # rounds grow with the points; an assignment that still changes then is an error


# ---------------------------------------------------------------------------
# assignment and Lloyd rounds
# ---------------------------------------------------------------------------

def centers_by_group(centers: DataFrame, keys: list[str], cluster_col: str = "cluster",
                     vec_col: str = "center") -> DataFrame:
    """(keys..., cluster, center) rows -> one row per key with an array of centres."""
    return centers.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(cluster_col).alias("cluster"),
                                             F.col(vec_col).alias("center")))).alias("_centers"))


def assign(points: DataFrame, centers: DataFrame, keys: list[str], vec_col: str = "vec",
           cluster_col: str = "cluster", n_keys: int | None = None) -> DataFrame:
    """Nearest centre (squared Euclidean; ties -> lowest cluster index) for every point.

    ``centers`` holds one row per key with ``_centers`` (<= MAX_K entries), so
    the join multiplies nothing; it is broadcast when the key count is small
    (``n_keys``, if known, saves the count).
    """
    j = join_small(points, centers, on=keys, small_rows=n_keys)
    best = F.array_min(F.transform("_centers", lambda c: F.struct(
        sq_dist(F.col(vec_col), c["center"]).alias("d2"), c["cluster"].alias("cluster"))))
    return j.withColumn(cluster_col, best["cluster"]).drop("_centers")


def first_points_as_centers(points: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
                            k_max: int = MAX_K) -> DataFrame:
    """(group..., rank, center): the k_max lowest-id points of each group.

    ``row_number() <= k`` lets Spark insert a per-partition group limit before
    the shuffle, so only k rows per group and partition move.
    """
    w = Window.partitionBy(*group_cols).orderBy(id_col)
    firsts = points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k_max)
    return firsts.select(*group_cols, (F.col("_rn") - 1).alias("rank"), as_double_array(vec_col).alias("center"))


def first_distinct(points: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
                   k_max: int = MAX_K) -> DataFrame:
    """(group..., rank, center): the first k_max different vectors of each group, by their lowest id."""
    once = points.groupBy(*group_cols, as_double_array(vec_col).alias("_v")).agg(F.min(id_col).alias("_first"))
    return first_points_as_centers(once, group_cols, "_first", "_v", k_max)


def _schema(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _nearest(X: np.ndarray, C: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
    """Index of the nearest centre by squared distance; within 1e-9 of the smallest, the first.

    Distances come from one product; rows where its rounding could matter are done again from the differences.
    """
    length = (X * X).sum(axis=1) if length is None else length
    own = (C * C).sum(axis=1)
    d2 = C @ X.T  # a row per centre: what follows runs along the points
    d2 *= -2.0
    d2 += length
    d2 += own[:, None]
    least = d2.min(axis=0)
    close = d2 <= least + 2e-9 * (1.0 + np.abs(least)) + 1e-12 * (length + own.max())
    n = close.sum(axis=0, dtype=np.int32)
    near = (np.arange(len(C), dtype=np.float64) @ close.astype(np.float64)).astype(np.int64)
    lost = np.flatnonzero(n == 0)
    near[lost] = d2[:, lost].argmin(axis=0)
    unsure = np.flatnonzero(n > 1)
    if len(unsure):
        d2 = np.stack([((X[unsure] - c) ** 2).sum(axis=1) for c in C], axis=1)
        least = d2.min(axis=1, keepdims=True)
        near[unsure] = np.argmax(d2 <= least + 1e-9 * (1.0 + least), axis=1)
    return near


def _points(row) -> np.ndarray:
    return np.asarray(row["_vecs"], dtype=np.float64).reshape(len(row["_ids"]), -1)


def _centres(row):
    """(k, cluster numbers, centres) for every k of a row."""
    C = np.asarray(row["_centers"], dtype=np.float64).reshape(len(row["_k"]), -1)
    ks, clusters = np.asarray(row["_k"]), np.asarray(row["_cluster"])
    for k in np.unique(ks):
        yield int(k), clusters[ks == k], C[ks == k]


def _as_bytes(frames):
    """Vectors and hashes of blocks as bytes, which go to Python without a look at each number."""
    for frame in frames:
        yield pd.DataFrame({"_group": frame["_group"], "_vecs": [np.asarray(x, dtype=np.float64).tobytes() for x in frame["_vecs"]],
                            "_hashes": [np.asarray(x, dtype=np.int64).tobytes() for x in frame["_hashes"]]})


def _partial_sums(centres: dict):
    """Counts, xors of id hashes and sums of the clusters by (group number, k), of all blocks of a task together."""
    def fn(frames):
        totals: dict = {}
        for frame in frames:
            for group, vecs, hashes in zip(frame["_group"], frame["_vecs"], frame["_hashes"]):
                hashes = np.frombuffer(hashes, dtype=np.int64)
                X = np.frombuffer(vecs).reshape(len(hashes), -1)
                length = (X * X).sum(axis=1)
                for k, C in centres[int(group)].items():
                    near = _nearest(X, C, length)
                    none = np.zeros(len(C), dtype=np.int64)
                    n, h, m = totals.setdefault((int(group), k), (none, none.copy(), np.zeros_like(C)))
                    n += np.bincount(near, minlength=len(C))
                    m += (np.arange(len(C))[:, None] == near).astype(np.float64) @ X
                    np.bitwise_xor.at(h, near, hashes)
        yield pd.DataFrame([(*key, *(x.tobytes() for x in found)) for key, found in totals.items()], columns=["_group", "k", "_n", "_h", "_m"])
    return fn


def _settled(max_rounds: int):
    """Rounds to the end for some k of a group of a few blocks; gives their last centres."""
    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        X = np.vstack([_points(row) for row in rows[["_ids", "_vecs"]].to_dict("records")])
        length = (X * X).sum(axis=1)
        one, out = rows.iloc[0], []
        keys = [c for c in rows.columns if not c.startswith("_")]
        for k, clusters, C in _centres(one):
            before = None
            for _ in range(max_rounds):
                near = _nearest(X, C, length)
                if before is not None and (near == before).all():
                    break
                n = np.bincount(near, minlength=len(C))
                member = (np.arange(len(C))[:, None] == near).astype(np.float64)
                C[n > 0] = (member @ X)[n > 0] / n[n > 0, None]
                before = near
            else:
                raise RuntimeError(f"no stable assignment after {max_rounds} rounds")
            out.append(pd.DataFrame({**{c: [one[c]] * len(C) for c in keys}, "k": k, "cluster": clusters, "center": list(C)}))
        return pd.concat(out)
    return fn


def _assignments(keys: list[str]):
    def fn(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                X = _points(row)
                for k, clusters, C in _centres(row):
                    yield pd.DataFrame({**{c: [row[c]] * len(X) for c in keys}, "k": k, "_id": list(row["_ids"]),
                                        "cluster": clusters[_nearest(X, C)]})
    return fn


def _lists(values: pa.Array, n: int) -> pa.ListArray:
    """Values as n lists of equal length."""
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(len(values) // max(n, 1))), values)


def _labelled(keys: list[str]):
    """The points of a block with their vectors and their clusters for every k."""
    def fn(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                of = {c: batch[c][r].values for c in ("_ids", "_vecs", "_k", "_cluster", "_centers")}
                n, X = len(of["_ids"]), of["_vecs"].to_numpy(zero_copy_only=False).reshape(len(of["_ids"]), -1)
                found = [(k, clusters[_nearest(X, C)]) for k, clusters, C in _centres({c: of[c].to_numpy(zero_copy_only=False) for c in ("_k", "_cluster", "_centers")})]
                ks, clusters = np.tile(np.array([k for k, _ in found], dtype=np.int32), n), np.stack([c for _, c in found], axis=1).reshape(-1)
                labels = pa.StructArray.from_arrays([pa.array(ks), pa.array(clusters.astype(np.int32))], names=["k", "cluster"])
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch[c][r], n) for c in keys), of["_ids"], _lists(of["_vecs"], n), _lists(labels, n)],
                                                 names=[*keys, "_id", "_v", "_labels"])
    return fn


def lloyd(points: DataFrame, seeds: DataFrame, group_cols: list[str], id_col: str, vec_col: str = "vec",
          block: int = 2_000, max_rounds: int = MAX_ROUNDS, whole: int = 65_536, by_point: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lloyd's rounds for every (group, k) of ``seeds`` at once, until no assignment changes.

    ``seeds`` holds (group..., k, cluster, center). The points are packed once,
    one copy for all k, into checkpointed rows of about ``block`` points of a
    group. Groups of ``whole`` points at most run all rounds in one call for some k; a group is copied
    to no more calls than give every core work. Of
    larger ones a round is one job over the rows, kept where they are: each task gives the sum,
    count and xor of id hashes per (k, cluster), which are merged to a row per centre; the centres (a few per
    ``whole`` points) go back with the next round. A (group, k) whose counts and
    xors are those of the round before has the same assignment, and is left
    out of further rounds. Distances within 1e-9 tie: the lowest cluster wins.
    A cluster that lost its members keeps its centre; null vectors take no part.
    An assignment that still changes after ``max_rounds`` is an error.
    Returns (group..., k, id, cluster) and the centres (group..., k, cluster, center); ``by_point``, a row
    per point instead, (group..., id, vec, _labels) with an array of (k, cluster).
    """
    spark = points.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    pts = points.where(F.col(vec_col).isNotNull()).select(
        *group_cols, F.col(id_col).alias("_id"), as_double_array(vec_col).alias("_v"))
    n = F.count(F.lit(1))
    sizes = pts.groupBy(*group_cols).agg(F.ceil(n / F.lit(block)).cast("int").alias("_blocks"), (n > whole).alias("_long")).persist()
    pts = join_small(pts, sizes, on=group_cols, small_rows=sizes.count()).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    rows = pts.groupBy(*group_cols, "_long", "_block").agg(F.collect_list(F.struct("_id", "_v")).alias("_p"))
    rows = rows.select(*group_cols, "_long", F.col("_p._id").alias("_ids"), F.flatten(F.col("_p._v")).alias("_vecs"),
                       F.transform("_p", lambda x: F.xxhash64(x["_id"])).alias("_hashes"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = rows.repartition(tasks).checkpoint(eager=True)  # work for every core, however few bytes

    clustering = [*group_cols, "k"]
    schema = _schema(points, group_cols)
    seeds = seeds.select(*clustering, F.col("cluster").cast("int").alias("cluster"), as_double_array("center").alias("center"))
    seeds = seeds.checkpoint(eager=True)

    def packed(centres: DataFrame, keys: list[str], *first: str) -> DataFrame:
        """A row per key with the numbers and centres of its clusters."""
        some = centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first, "cluster", "center"))).alias("_c"))
        return some.select(*keys, *(F.col(f"_c.{c}").alias(f"_{c}") for c in (*first, "cluster")),
                           F.flatten(F.col("_c.center")).alias("_centers"))

    short = sizes.where("NOT _long")
    total = short.agg(F.sum("_blocks")).first()[0] or 1
    calls = short.select(*group_cols, F.ceil(F.col("_blocks") * F.lit(tasks) / F.lit(total)).cast("int").alias("_calls"))
    several = packed(seeds.join(calls, on=group_cols).withColumn("_call", F.pmod("k", "_calls")), [*group_cols, "_call"], "k").persist()
    runs = several.count()
    short = join_small(rows.where("NOT _long").select(*group_cols, "_ids", "_vecs"), several, on=group_cols, small_rows=runs)
    short = short.repartition(max(1, min(1_000, 2 * runs)), *group_cols, "_call").groupBy(*group_cols, "_call").applyInPandas(
        _settled(max_rounds), f"{schema}, k int, cluster int, center array<double>")
    centres = stored(short.select(*clustering, "cluster", "center"), "centres")
    several.unpersist()

    groups = stored(rows.where("_long").select(*group_cols).distinct().withColumn("_group", F.monotonically_increasing_id()), "long-groups")
    state: dict = {}  # group number -> k -> centres
    for r in seeds.join(groups, on=group_cols).orderBy("_group", "k", "cluster").select("_group", "k", "cluster", "center").toLocalIterator():
        state.setdefault(r["_group"], {}).setdefault(r["k"], []).append((r["cluster"], np.array(r["center"])))
    numbers = {(g, k): [c for c, _ in x] for g, ks in state.items() for k, x in ks.items()}
    state = {g: {k: np.stack([c for _, c in x]) for k, x in ks.items()} for g, ks in state.items()}
    active, before, done = set(numbers), {}, 0
    # few tasks have rows of a group, so what they give is a few rows per group and task
    far = rows.where("_long").join(groups, on=group_cols).select("_group", "_vecs", "_hashes")
    far = far.repartitionByRange(tasks // 4, "_group", F.element_at("_hashes", 1))
    far = far.mapInPandas(_as_bytes, "_group long, _vecs binary, _hashes binary").persist()
    while active:
        if done == max_rounds:
            raise RuntimeError(f"no stable assignment after {max_rounds} rounds")
        now = {g: {k: C for k, C in ks.items() if (g, k) in active} for g, ks in state.items()}
        partial = far.where(F.col("_group").isin([g for g, ks in now.items() if ks])).mapInPandas(
            _partial_sums(now), "_group long, k int, _n binary, _h binary, _m binary")
        seen: dict = {}
        for r in partial.collect():
            x = (r["_group"], r["k"])
            found = [np.frombuffer(r["_n"], dtype=np.int64), np.frombuffer(r["_h"], dtype=np.int64), np.frombuffer(r["_m"]).reshape(state[x[0]][x[1]].shape)]
            seen[x] = [seen[x][0] + found[0], seen[x][1] ^ found[1], seen[x][2] + found[2]] if x in seen else found
        for (g, k), (n, _, m) in seen.items():
            state[g][k][n > 0] = m[n > 0] / n[n > 0, None]
        seen = {x: (n.tobytes(), h.tobytes()) for x, (n, h, _) in seen.items()}
        active = {x for x in active if seen[x] != before.get(x)}
        before, done = seen, done + 1
    far.unpersist()
    if numbers:
        last = [(g, k, c, C.tolist()) for (g, k), cs in numbers.items() for c, C in zip(cs, state[g][k])]
        last = spark.createDataFrame(last, "_group long, k int, cluster int, center array<double>")
        centres = stored(centres.unionByName(last.join(groups, on="_group").select(*clustering, "cluster", "center")), "centres")
    every = packed(centres, group_cols, "k").persist()
    joined = join_small(rows, every, on=group_cols, small_rows=every.count())
    ids = points.schema[id_col].dataType.simpleString()
    if by_point:
        joined = joined.select(*group_cols, "_ids", "_vecs", "_k", "_cluster", "_centers")
        assigned = joined.mapInArrow(_labelled(group_cols), f"{schema}, _id {ids}, _v array<double>, _labels array<struct<k int, cluster int>>")
        return assigned.withColumnsRenamed({"_id": id_col, "_v": vec_col}), centres
    assigned = joined.mapInPandas(_assignments(group_cols), f"{schema}, k int, _id {ids}, cluster int")
    return assigned.withColumnRenamed("_id", id_col), centres


def k_candidates(points: DataFrame, group_cols: list[str], k_max: int = MAX_K) -> DataFrame:
    """(group..., n, k) for k = 2 .. min(k_max, n - 1); groups with n < 3 get none."""
    n = points.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))
    top = F.least(F.lit(k_max), F.col("n") - 1).cast("int")
    return n.where(F.col("n") >= 3).select(*group_cols, "n", F.explode(F.sequence(F.lit(2), top)).alias("k"))


def _seeds(points: DataFrame, ks: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
           flag_col: str | None, k_max: int = MAX_K) -> DataFrame:
    """First different vectors per (group, k); rows flagged by ``flag_col`` never seed."""
    own = points if flag_col is None else points.where(~F.col(flag_col))
    firsts = first_distinct(own, group_cols, id_col, vec_col, k_max)
    return firsts.join(ks, on=group_cols).where(F.col("rank") < F.col("k")).select(
        *group_cols, F.col("k").cast("int").alias("k"), F.col("rank").cast("int").alias("cluster"), "center")


def kmeans_sweep(points: DataFrame, group_cols: list[str], id_col: str, vec_col: str, k_max: int = MAX_K,
                 flag_col: str | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Cluster every group for every candidate k; returns (group..., k, id, cluster)."""
    ks = k_candidates(points, group_cols, k_max).drop("n")
    seeds = _seeds(points, ks, group_cols, id_col, vec_col, flag_col, k_max)
    return lloyd(points, seeds, group_cols, id_col, vec_col, max_rounds=max_rounds)[0]


def kmeans_fixed_k(points: DataFrame, group_cols: list[str], id_col: str, vec_col: str, k_col: str,
                   flag_col: str | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Cluster every group with its own k (column ``k_col`` on the points)."""
    ks = points.select(*group_cols, F.col(k_col).alias("k")).distinct()
    seeds = _seeds(points.drop("k"), ks, group_cols, id_col, vec_col, flag_col)
    assigned, _ = lloyd(points, seeds, group_cols, id_col, vec_col, max_rounds=max_rounds)
    return assigned.join(points.select(*group_cols, id_col, vec_col), on=[*group_cols, id_col])


# ---------------------------------------------------------------------------
# silhouettes
# ---------------------------------------------------------------------------

def _sil(a, b, own_size):
    s = (b - a) / F.greatest(a, b)
    return F.when(own_size <= 1, F.lit(0.0)).when(F.greatest(a, b) == 0, F.lit(0.0)).otherwise(s)


def silhouette_samples_cosine(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
                              cluster_col: str = "cluster", labels_col: str | None = None) -> DataFrame:
    """Per-point cosine silhouette; linear in the number of points.

    With ``labels_col``, an array of (k, cluster) per point, it is that of each of these clusterings
    within the groups: (groups..., k, id, cluster, s).
    """
    if labels_col is not None:
        return _cosine_of_labellings(df, group_cols, id_col, vec_col, labels_col)
    unit = df.select(*group_cols, id_col, cluster_col, normalize(vec_col).alias("_u"))
    sums_long = V.explode_dims(unit, [*group_cols, cluster_col], "_u").groupBy(*group_cols, cluster_col, "dim") \
        .agg(F.sum("x").alias("s"))
    sums = V.fold_dims(sums_long, [*group_cols, cluster_col], "s", "_S")
    sizes = unit.groupBy(*group_cols, cluster_col).agg(F.count(F.lit(1)).alias("_size"))
    per = sums.join(sizes, on=[*group_cols, cluster_col])
    per_group = per.groupBy(*group_cols).agg(F.collect_list(F.struct(
        F.col(cluster_col).alias("c"), F.col("_S").alias("S"), F.col("_size").alias("size"))).alias("_cl"))
    j = join_small(unit, per_group, on=group_cols)
    from colloquy.functions.vectors import dot

    self_dot = dot("_u", "_u")
    means = F.transform("_cl", lambda c: F.struct(
        c["c"].alias("c"), c["size"].alias("size"),
        F.when(c["c"] == F.col(cluster_col),
               F.when(c["size"] <= 1, F.lit(0.0)).otherwise(
                   (c["size"] - 1 - (dot("_u", c["S"]) - self_dot)) / (c["size"] - 1)))
        .otherwise((c["size"] - dot("_u", c["S"])) / c["size"]).alias("d")))
    j = j.withColumn("_m", means)
    own = F.filter("_m", lambda m: m["c"] == F.col(cluster_col))[0]
    others = F.filter("_m", lambda m: m["c"] != F.col(cluster_col))
    b = F.array_min(F.transform(others, lambda m: m["d"]))
    out = j.select(*group_cols, id_col, cluster_col, own["d"].alias("a"), b.alias("b"), own["size"].alias("_own"),
                   F.size(others).alias("_k_other"))
    return out.select(*group_cols, id_col, cluster_col,
                      F.when(F.col("_k_other") == 0, F.lit(None).cast("double"))
                      .otherwise(_sil(F.col("a"), F.col("b"), F.col("_own"))).alias("s"))


def _units_of(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Unit vectors of a block's points, and the point and value of each of their (k, cluster); points of no cluster count for none."""
    X = batch["_vecs"][r].values.to_numpy(zero_copy_only=False).reshape(len(batch["_ids"][r].values), -1)
    length = np.sqrt((X * X).sum(axis=1))
    at, entries = _entries(batch["_all"][r].values)
    return X / np.where(length == 0, 1.0, length)[:, None], at, entries


def _numbered(*entries: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (k, cluster), one after the other: codes of k, codes of the cluster (-1 for none) and of both."""
    k, c = (codes(pa.concat_arrays([x.field(i) for x in entries])) for i in (0, 1))
    return k, c, np.unique(k * (c.max(initial=0) + 2) + c + 1, return_inverse=True)[1]


def _unit_sums(keys: list[str], names: list[str]):
    def fn(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                U, at, entries = _units_of(batch, r)
                _, c, column = _numbered(entries)
                order = np.argsort(column, kind="stable")
                order = order[c[order] >= 0]
                if not len(order):
                    continue
                starts = np.flatnonzero(np.diff(column[order], prepend=-1))
                sums = np.add.reduceat(U[at[order]], starts, axis=0)
                some, size = entries.take(pa.array(order[starts])), np.diff([*starts, len(order)])
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch[x][r], len(starts)) for x in keys), some.field(0), some.field(1),
                                                  pa.array(size.astype(np.int64)), _lists(pa.array(sums.reshape(-1)), len(starts))], names=names)
    return fn


def _cosine_of_block(keys: list[str], names: list[str]):
    def fn(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                U, at, entries = _units_of(batch, r)
                sums, m = batch["_clusters"][r].values, len(entries)
                S = sums.field(3).flatten().to_numpy(zero_copy_only=False).reshape(len(sums), -1)
                size = sums.field(2).to_numpy(zero_copy_only=False).astype(np.float64)
                k, c, column = _numbered(entries, pa.StructArray.from_arrays([sums.field(0), sums.field(1)], names=["k", "c"]))
                s, none = np.zeros(m), np.ones(m, dtype=bool)
                for one in np.unique(k[:m]):
                    mine, cols = np.flatnonzero((k[:m] == one) & (c[:m] >= 0)), np.flatnonzero(k[m:] == one)
                    if len(cols) < 2 or not len(mine):
                        continue
                    units = U[at[mine]]
                    dots, n = units @ S[cols].T, size[cols]
                    own = column[m + cols][None, :] == column[mine][:, None]
                    mates = np.where(own, n - 1, 0.0).sum(axis=1)
                    near = np.where(own, dots, 0.0).sum(axis=1) - (units * units).sum(axis=1)
                    a = np.where(mates > 0, (mates - near) / np.maximum(mates, 1.0), 0.0)
                    b = np.where(own, np.inf, (n - dots) / n).min(axis=1)
                    most = np.maximum(a, b)
                    s[mine] = np.where((mates < 1) | (most == 0), 0.0, (b - a) / np.where(most == 0, 1.0, most))
                    none[mine] = False
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch[x][r], m) for x in keys), entries.field(0), batch["_ids"][r].values.take(pa.array(at)),
                                                  entries.field(1), pa.array(s, mask=none)], names=names)
    return fn


def _cosine_of_labellings(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, labels_col: str, block: int = 2_000) -> DataFrame:
    """Cosine silhouettes of several clusterings of the same points, which are packed once in blocks of a group.

    A block gives its sums of unit vectors per (k, cluster); those of the group come back to its blocks.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    ship_package(df.sparkSession)
    pts = df.where(F.col(vec_col).isNotNull()).select(
        *group_cols, F.col(id_col).alias("_id"), as_double_array(vec_col).alias("_v"), F.col(labels_col).alias("_labels"))
    schema, inner = _schema(pts, group_cols), pts.schema["_labels"].dataType.elementType
    k_name, k_type, c_name, c_type = (x for f in inner.fields for x in (f.name, f.dataType.simpleString()))
    sizes = pts.groupBy(*group_cols).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_blocks"))
    pts = join_small(pts, sizes, on=group_cols).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    rows = pts.groupBy(*group_cols, "_block").agg(F.collect_list(F.struct("_id", "_v", "_labels")).alias("_p"))
    rows = stored(rows.select(*group_cols, F.col("_p._id").alias("_ids"), F.flatten(F.col("_p._v")).alias("_vecs"),
                              F.col("_p._labels").alias("_all")), "blocks")
    sums = rows.mapInArrow(_unit_sums(group_cols, [*group_cols, "_k", "_c", "_n", "_S"]),
                           f"{schema}, _k {k_type}, _c {c_type}, _n long, _S array<double>")
    sums = sums.groupBy(*group_cols, "_k", "_c").agg(F.sum("_n").alias("_n"), Summarizer.sum(array_to_vector("_S")).alias("_S"))
    every = sums.groupBy(*group_cols).agg(F.collect_list(F.struct("_k", "_c", "_n", vector_to_array("_S").alias("_S"))).alias("_clusters"))
    return join_small(rows, every, on=group_cols).select(*group_cols, "_ids", "_vecs", "_all", "_clusters").mapInArrow(
        _cosine_of_block(group_cols, [*group_cols, k_name, id_col, c_name, "s"]),
        f"{schema}, `{k_name}` {k_type}, `{id_col}` {df.schema[id_col].dataType.simpleString()}, `{c_name}` {c_type}, s double")


def _entries(labels) -> tuple[np.ndarray, pa.StructArray]:
    """Row number of each (k, cluster) in a column of lists, and all of them one after the other."""
    lists = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten()


def _squares(n: int):
    """Slices of rows and columns that hold every unordered pair of n points once; those of a pair of equal slices hold both orders."""
    for i, to in tiled(n, ROWS):
        yield slice(i, to), slice(i, to)
        for j, end in tiled(n - to, COLUMNS):
            yield slice(i, to), slice(to + j, to + end)


def _kinds(weights: np.ndarray) -> np.ndarray:
    """A number for each different row, by a hash that is compared with the rows."""
    mix = np.random.default_rng(0).integers(1, np.iinfo(np.int64).max, weights.shape[1])
    _, first, kind = np.unique(weights.astype(np.int64) @ mix, return_index=True, return_inverse=True)
    return kind if (weights == weights[first[kind]]).all() else np.unique(weights, axis=0, return_inverse=True)[1].reshape(-1)


class _Side:
    """The points of a part with the weights that their clusters give them.

    Points of equal clusters stand together, so distances to them are summed by runs before they are
    weighted; where the runs are short, each is weighted.
    """

    def __init__(self, points: pa.Table):
        at, self.entries = _entries(points["_labels"])
        k, c = codes(self.entries.field(0)), codes(self.entries.field(1))
        named = np.flatnonzero(c >= 0)  # a point of no cluster counts for none
        _, first, column = np.unique(k[named] * (c.max(initial=0) + 1) + c[named], return_index=True, return_inverse=True)
        self.columns = named[first]
        weights = np.zeros((len(points), len(first)))
        np.add.at(weights, (at[named], column), 1.0)
        self.counts = weights.sum(axis=0)
        kind = _kinds(weights)
        self.order = np.argsort(kind, kind="stable")
        self.kind, self.weights = kind[self.order], weights[self.order]
        self.X = matrix(points["_v"])[self.order]
        self.tile = points["_tile"].to_numpy()

    def factor(self, left: bool) -> np.ndarray:
        """One of the two matrices whose product holds the squared distances."""
        one, length = np.ones((len(self.X), 1)), (self.X * self.X).sum(axis=1)[:, None]
        return np.hstack([-2.0 * self.X, length, one]) if left else np.hstack([self.X, one, length]).T.copy()

    def add(self, to: np.ndarray, D: np.ndarray, at: slice, turned: bool = False) -> None:
        """Add to ``to`` what distances to the points ``at`` come to, by cluster; they are the rows of D if ``turned``."""
        starts = np.flatnonzero(np.diff(self.kind[at], prepend=-1))
        weights = self.weights[at]
        if 4 * len(starts) > len(weights):
            to += (D.T if turned else D) @ weights
        elif turned:
            sums = np.empty((len(starts), D.shape[1]))
            for r, (one, end) in enumerate(zip(starts, [*starts[1:], len(D)])):
                np.add.reduce(D[one:end], axis=0, out=sums[r])
            to += sums.T @ weights[starts]
        else:
            to += np.add.reduceat(D, starts, axis=1) @ weights[starts]

    def as_given(self, sums: np.ndarray) -> np.ndarray:
        """Rows of the sorted points in the order in which the points came."""
        out = np.empty_like(sums)
        out[self.order] = sums
        return out


def _pair_sums(keys: list[str]):
    def messages(key: tuple, mine: _Side, other: _Side, sums: np.ndarray) -> list[pa.Table]:
        """A row per tile and cluster of the other side: the sums of all points of the tile."""
        out, starts = [], np.flatnonzero(np.diff(mine.tile, prepend=-1))
        named, m = other.entries.take(pa.array(other.columns)), len(other.columns)
        for at, to in zip(starts, [*starts[1:], len(mine.tile)]) if m else ():
            flat = np.ascontiguousarray(sums[at:to].T).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * np.int32(to - at)), pa.array(flat))
            out.append(pa.table([*(pa.repeat(x, m) for x in key[:len(keys)]), pa.array(np.full(m, mine.tile[at], dtype=np.int32)),
                                 named.field(0), named.field(1), pa.array(other.counts), lists],
                                names=[*keys, "_tile", "_k", "_c", "_cnt", "_sums"]))
        return out

    def fn(key: tuple, table: pa.Table) -> pa.Table:
        both = [_Side(x) for x in sides(key, table, ["_tile", "_row"])]
        out = []
        if both:
            left, right = both[0], both[-1]
            same = left is right
            rows, columns = left.factor(True), right.factor(False)
            of_left = np.zeros((len(rows), right.weights.shape[1]))
            of_right = of_left if same else np.zeros((columns.shape[1], left.weights.shape[1]))
            room = np.empty(ROWS * COLUMNS)
            for i, j in _squares(len(rows)) if same else blocks(len(rows), columns.shape[1], ROWS, COLUMNS):
                shape = (i.stop - i.start, j.stop - j.start)
                D = np.matmul(rows[i], columns[:, j], out=room[:shape[0] * shape[1]].reshape(shape))
                np.maximum(D, 0.0, out=D)
                np.sqrt(D, out=D)
                if same and i == j:
                    np.fill_diagonal(D, 0.0)
                else:
                    left.add(of_right[j], D, i, turned=True)
                right.add(of_left[i], D, j)
            out = messages(key, left, right, left.as_given(of_left))
            if not same:
                out += messages(key, right, left, right.as_given(of_right))
        if out:
            return pa.concat_tables(out)
        kind = table["_labels"].type.value_type
        return pa.table([*(pa.array([], x.type) for x in key[:len(keys)]), pa.array([], pa.int32()), pa.array([], kind.field(0).type),
                         pa.array([], kind.field(1).type), pa.array([], pa.float64()), pa.array([], pa.list_(pa.float64()))],
                        names=[*keys, "_tile", "_k", "_c", "_cnt", "_sums"])
    return fn


def _silhouettes_of_tile(keys: list[str]):
    def fn(key: tuple, found: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("_row")
        at, entries = _entries(points["_labels"])
        n, m = len(entries), len(found)
        k = codes(pa.concat_arrays([entries.field(0), found["_k"].combine_chunks()]))
        c = codes(pa.concat_arrays([entries.field(1), found["_c"].combine_chunks()]))
        _, column = np.unique(k * (c.max(initial=0) + 2) + c + 1, return_inverse=True)
        sums, counts = np.zeros((column.max(initial=0) + 1, len(points))), np.zeros(column.max(initial=0) + 1)
        np.add.at(sums, column[n:], matrix(found["_sums"]) if m else np.zeros((0, len(points))))
        np.add.at(counts, column[n:], found["_cnt"].to_numpy())
        kind = np.zeros(len(counts), dtype=np.int64)
        kind[column] = k
        # rows of equal id and cluster are one row, as many times as they come
        ids = codes(points["_id"].combine_chunks())[at]
        _, first, same = np.unique(np.stack([ids, column[:n]], axis=1), axis=0, return_index=True, return_inverse=True)
        same, times = same.reshape(-1), np.bincount(same.reshape(-1), minlength=len(first)).astype(float)
        s, none = np.zeros(len(first)), np.zeros(len(first), dtype=bool)
        for one in np.unique(k[:n]):
            mine, cols = np.flatnonzero(k[first] == one), np.flatnonzero((kind == one) & (counts > 0))
            place = np.full(len(first), -1)
            place[mine] = np.arange(len(mine))
            rows = np.flatnonzero(place[same] >= 0)
            total = np.zeros((len(mine), len(cols)))
            if len(rows) == len(mine):
                total[place[same[rows]]] = sums[cols][:, at[rows]].T
            else:
                np.add.at(total, place[same[rows]], sums[cols][:, at[rows]].T)
            count = times[mine][:, None] * counts[cols]
            own = cols[None, :] == column[first[mine]][:, None]
            size = np.where(own, count, 0.0).sum(axis=1)
            a = np.where(size > 1, np.where(own, total, 0.0).sum(axis=1) / np.maximum(size - 1, 1.0), 0.0)
            b = np.where(own, np.inf, total / count).min(axis=1, initial=np.inf)
            most = np.maximum(a, b)
            none[mine] = np.isinf(b) | (c[first[mine]] < 0)
            s[mine] = np.where((size <= 1) | (most == 0) | none[mine], 0.0, (b - a) / np.where((most == 0) | np.isinf(most), 1.0, most))
        rows = entries.take(pa.array(first))
        return pa.table([*(pa.repeat(x, len(first)) for x in key[:len(keys)]), rows.field(0), points["_id"].take(pa.array(at[first])),
                         rows.field(1), pa.array(s, mask=none)], names=[*keys, "_k", "_id", "_own", "s"])
    return fn


def silhouettes_of_labellings(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, labels_col: str,
                              tile: int = 1024) -> DataFrame:
    """(groups..., k, id, cluster, s): per-point Euclidean silhouettes of several clusterings of the same points, exact.

    ``labels_col`` holds an array of (k, cluster) per point. Distances are made once for all of
    them, in tasks of two parts of a group (see ``blocks``). A task gives the sums of its distances per point and
    cluster, packed by tile; the sums of a tile from all parts then meet in one small task.
    """
    ship_package(df.sparkSession)
    pts = df.where(F.col(vec_col).isNotNull()).select(
        *group_cols, F.col(id_col).alias("_id"), as_double_array(vec_col).alias("_v"), F.col(labels_col).alias("_labels"))
    pts = stored(pts.withColumn("_row", F.monotonically_increasing_id()), "points")
    inner = pts.schema["_labels"].dataType.elementType
    k_name, k_type, c_name, c_type = *(x for f in inner.fields for x in (f.name, f.dataType.simpleString())),
    dealt, pairs = deal(pts, group_cols, tile, even=True)
    sums = part_pairs(dealt, pairs, group_cols).groupBy(*group_cols, "_a", "_b").applyInArrow(
        _pair_sums(group_cols), f"{_schema(pts, group_cols)}, _tile int, _k {k_type}, _c {c_type}, _cnt double, _sums array<double>")
    rows = dealt.select(*group_cols, "_tile", "_row", "_id", "_labels")
    out = sums.groupBy(*group_cols, "_tile").cogroup(rows.groupBy(*group_cols, "_tile")).applyInArrow(
        _silhouettes_of_tile(group_cols),
        f"{_schema(pts, group_cols)}, _k {k_type}, {_schema(pts, ['_id'])}, _own {c_type}, s double")
    return out.select(*group_cols, F.col("_k").alias(k_name), F.col("_id").alias(id_col), F.col("_own").alias(c_name), "s")


def silhouette_samples_euclid(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
                              cluster_col: str = "cluster", tile: int = 1024) -> DataFrame:
    """Per-point Euclidean silhouette, exact, computed in blocks of the points of two parts of a group."""
    one = df.withColumn("_labels", F.array(F.struct(F.lit(0).alias("_one"), F.col(cluster_col).alias(cluster_col))))
    return silhouettes_of_labellings(one, group_cols, id_col, vec_col, "_labels", tile).drop("_one")


def silhouettes_of_sweep(assigned: DataFrame, points: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
                         tile: int = 1024) -> DataFrame:
    """(groups..., k, id, cluster, s) for the clusterings (groups..., k, id, cluster) of ``points`` (id, vec).

    Those that ``lloyd`` gave by point, with ``_labels``, hold the points already.
    """
    if "_labels" in assigned.columns:
        return silhouettes_of_labellings(assigned, group_cols, id_col, vec_col, "_labels", tile)
    labels = assigned.groupBy(*group_cols, id_col).agg(F.collect_list(F.struct("k", "cluster")).alias("_labels"))
    both = labels.join(points.select(id_col, vec_col), on=id_col)
    return silhouettes_of_labellings(both, group_cols, id_col, vec_col, "_labels", tile)


def silhouette(samples: DataFrame, group_cols: list[str]) -> DataFrame:
    """Mean silhouette per group (null when the group has a single cluster)."""
    return samples.groupBy(*group_cols).agg(F.avg("s").alias("silhouette"))


def count_above_mean(samples: DataFrame, means: DataFrame, group_cols: list[str],
                     mean_col: str = "silhouette") -> DataFrame:
    """Per group: how many per-point scores exceed the group's mean score, and the share."""
    j = join_small(samples, means, on=group_cols)
    return j.groupBy(*group_cols).agg(
        F.sum(F.when(F.col("s") > F.col(mean_col), 1).otherwise(0)).alias("n_above"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("ratio", F.col("n_above") / F.col("n"))


def best_k_first_max(scores: DataFrame, group_cols: list[str], score_col: str = "silhouette") -> DataFrame:
    """k with the highest score; the smallest such k on ties (scores equal to 9 decimals)."""
    s = scores.where(F.col(score_col).isNotNull())
    best = F.min_by(F.struct("k", score_col), F.struct((-F.round(score_col, 9)).alias("neg"), F.col("k")))
    return s.groupBy(*group_cols).agg(best.alias("_b")).select(
        *group_cols, F.col("_b.k").alias("k"), F.col(f"_b.{score_col}").alias(score_col))


def best_k_by_count(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """k with the most points above the mean score (strictly more wins, so the
    smallest k on ties); k = 1 when no k has any point above its mean."""
    best = F.min_by(F.struct("k", "n_above", "ratio"), F.struct((-F.col("n_above")).alias("neg"), F.col("k")))
    agg = counts.groupBy(*group_cols).agg(best.alias("_b"))
    return agg.select(*group_cols,
                      F.when(F.col("_b.n_above") > 0, F.col("_b.k")).otherwise(F.lit(1)).alias("k"),
                      F.col("_b.n_above").alias("n_above"), F.col("_b.ratio").alias("ratio"))


# ---------------------------------------------------------------------------
# typical members
# ---------------------------------------------------------------------------

def typical_members(assigned: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
                    cluster_col: str = "cluster", center: str = "median",
                    flag_col: str | None = None) -> DataFrame:
    """Per (group, cluster): the member closest to the cluster's median/mean.

    Rows flagged by ``flag_col`` (the appended mean row) take part in the
    clustering but are dropped here; a cluster holding only them disappears.
    """
    pts = assigned if flag_col is None else assigned.where(~F.col(flag_col))
    return V.medoid(pts, [*group_cols, cluster_col], id_col, vec_col, center)


def positional_ids(df: DataFrame, group_cols: list[str], order_col: str, out: str = "pos") -> DataFrame:
    """0-based position of each row within its group, by ``order_col`` (skew-safe)."""
    from colloquy.operators.positions import positional_index

    return positional_index(df, group_cols, [order_col], out)


# ---------------------------------------------------------------------------
# dominant cluster: connected components of the eps-neighbour graph
# ---------------------------------------------------------------------------

def _near_labels(eps: float):
    def fn(key: tuple, table: pa.Table) -> pa.Table:
        two = sides(key, table, ["_id"])
        if not two:
            return pa.table({"_id": pa.array([], pa.int64()), "_cand": pa.array([], pa.int64())})
        none = np.iinfo(np.int64).max
        X, labels = [matrix(t["_v"]) for t in two], [t["_l"].to_numpy() for t in two]
        length, found = [(x * x).sum(axis=1) for x in X], [np.full(len(x), none) for x in X]
        for i, j in blocks(len(X[0]), len(X[-1])):
            near = np.sqrt(np.maximum(length[0][i, None] + length[-1][j] - 2.0 * (X[0][i] @ X[-1][j].T), 0.0)) <= eps
            found[0][i] = np.minimum(found[0][i], np.where(near, labels[-1][None, j], none).min(axis=1))
            if len(two) > 1:
                found[1][j] = np.minimum(found[1][j], np.where(near, labels[0][i, None], none).min(axis=0))
        ids, found = np.concatenate([t["_id"].to_numpy() for t in two]), np.concatenate(found)
        return pa.table({"_id": ids[found < none], "_cand": found[found < none]})
    return fn


def eps_components(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, eps: float,
                   tile: int = 1024) -> DataFrame:
    """Connected components of the graph 'Euclidean distance <= eps' per group.

    Exact: labels start as row numbers; every round each point takes the
    smallest label within eps (in tasks of two parts of a group, never emitting point
    pairs), then the label of its label, until nothing changes. Labels are
    checkpointed each round. Returns (group..., id, component) with
    component = smallest id in it; ids may be of any orderable type.
    """
    ship_package(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    pts = df.select(*group_cols, F.col(id_col).alias("_key"), as_double_array(vec_col).alias("_v")) \
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    labels = pts.select("_id", F.col("_id").alias("_l"))
    changed = 1
    while changed:
        pairs = part_pairs(*deal(pts.drop("_key").join(labels, on="_id"), group_cols, tile), group_cols)
        cand = pairs.groupBy(*group_cols, "_a", "_b").applyInArrow(_near_labels(eps), "_id long, _cand long")
        best = cand.groupBy("_id").agg(F.min("_cand").alias("_c"))
        new = labels.join(best, on="_id", how="left").select(
            "_id", F.col("_l").alias("_old"), F.least("_l", "_c").alias("_l")).checkpoint(eager=True)
        # a label is a row of the same component, whose own label is as small or smaller
        step = new.select(F.col("_id").alias("_l"), F.col("_l").alias("_jump"))
        new = new.join(step, on="_l").select("_id", "_old", F.col("_jump").alias("_l")).checkpoint(eager=True)
        changed = new.where(F.col("_l") != F.col("_old")).limit(1).count()
        labels = new.drop("_old")
    out = pts.join(labels, on="_id")
    names = out.groupBy("_l").agg(F.min("_key").alias("component"))
    return out.join(names, on="_l").select(*group_cols, F.col("_key").alias(id_col), "component")


def dominant_clusters(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, eps: float,
                      tile: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Density clusters with a minimum size of half the group (at most two).

    Components of the eps-graph with at least max(2, n // 2) points are
    clusters (numbered 1.. by size, then smallest id); the rest is noise (0).
    Returns per-point rows (cluster, probability = 1 - d / d_max to the
    cluster centroid; 0 for noise) and per-group rows (n, n_clusters,
    dominant_share, silhouette over the labels with noise as one label).
    """
    comp = eps_components(df, group_cols, id_col, vec_col, eps, tile)
    n = comp.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))
    sizes = comp.groupBy(*group_cols, "component").agg(F.count(F.lit(1)).alias("size"))
    sizes = join_small(sizes, n, on=group_cols)
    big = sizes.where(F.col("size") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    w = Window.partitionBy(*group_cols).orderBy(F.col("size").desc(), F.col("component"))
    big = big.withColumn("cluster", F.row_number().over(w))  # at most two rows per group
    pts = comp.join(big.select(*group_cols, "component", "cluster"), on=[*group_cols, "component"], how="left")
    pts = pts.withColumn("cluster", F.coalesce("cluster", F.lit(0)))
    pts = pts.join(df.select(*group_cols, id_col, as_double_array(vec_col).alias("_v")), on=[*group_cols, id_col])
    cen = V.mean_vectors(pts.where(F.col("cluster") > 0), [*group_cols, "cluster"], "_v", "_c")
    pd_ = pts.join(cen, on=[*group_cols, "cluster"], how="left").withColumn(
        "_d", F.when(F.col("_c").isNull(), F.lit(None).cast("double")).otherwise(F.sqrt(sq_dist("_v", "_c"))))
    # farthest member per cluster by an aggregate: a window would gather all noise of a group in a task
    far = pd_.where(F.col("cluster") > 0).groupBy(*group_cols, "cluster").agg(F.max("_d").alias("_far"))
    pd_ = pd_.join(far, on=[*group_cols, "cluster"], how="left")
    members = pd_.withColumn("probability", F.when(F.col("cluster") == 0, F.lit(0.0)).otherwise(
        F.when(F.col("_far") == 0, F.lit(1.0)).otherwise(1 - F.col("_d") / F.col("_far"))))
    members = members.select(*group_cols, id_col, "cluster", "probability", "_v")
    labels_per_group = members.groupBy(*group_cols).agg(F.countDistinct("cluster").alias("_nl"),
                                                        F.count(F.lit(1)).alias("_np"))
    # silhouette is defined for 2 <= number of labels <= n - 1
    sil_in = members.join(labels_per_group, on=group_cols).where(
        (F.col("_nl") >= 2) & (F.col("_nl") <= F.col("_np") - 1))
    sil = silhouette(silhouette_samples_euclid(sil_in, group_cols, id_col, "_v", "cluster", tile), group_cols)
    summary = (big.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_clusters"), F.max("size").alias("_top")))
    summary = n.join(summary, on=group_cols, how="left").join(sil, on=group_cols, how="left")
    summary = summary.select(*group_cols, "n", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
                             F.coalesce(F.col("_top") / F.col("n"), F.lit(0.0)).alias("dominant_share"),
                             "silhouette")
    return members.drop("_v"), summary
