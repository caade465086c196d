"""Non-linear reduction of many groups at once: eigenvectors of the neighbour graph.

Per group the k nearest neighbours by cosine give a sparse symmetric graph
(an edge if either end names the other, weight = similarity, at least 0), and
N = D^-1/2 W D^-1/2 is its normalised adjacency. The reduced dimensions are
the eigenvectors of the largest eigenvalues of N after the trivial one
(square roots of the degrees), which is projected out.

Block power iteration with a Chebyshev filter: a thin matrix X of
``dims + GUARD`` columns lives in the rows of a table. A multiplication by N is
a join of the edges with X and one sum per column. Each round X is multiplied by a polynomial of N that grows
beyond the smallest Ritz value and stays below one under it, then X and N X are summed up
to small Gram matrices per group (columns x columns), from which numpy
finds the rotation, the Ritz values and the residuals |N x - theta x| of unit vectors; the rotation is joined
back. Rounds end when every returned dimension of every group has a residual of ``tol`` at most; if
``max_rounds`` do not do, an error is raised. Groups of ``whole`` points at most run these rounds in one call
each, on their edges and block as arrays, and shuffle nothing between rounds.

Rules: groups of ``dims + GUARD + 2`` points or fewer are returned as they are
(``reduced`` false). The start is drawn from hashes of ids, so results repeat; a dimension's
sign makes the entry of largest size positive (ties: smallest id). In a graph of several parts, leading dimensions tell
the parts apart. Null vectors are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import normalize
from colloquy.operators.density import group_points
from colloquy.operators.joins import join_small
from colloquy.operators.topic_fit import nearest_neighbours
from colloquy.session import stored

GUARD = 6
DEGREE = 6  # of the filter


def neighbour_graph(points: DataFrame, k: int, tile: int) -> DataFrame:
    """(_g, _u, _x, _w): both directions of each edge of the normalised neighbour graph of points (_g, _id, _v)."""
    unit = points.select("_g", "_id", normalize("_v").alias("_v"))
    one = nearest_neighbours(unit, k, tile).select("_g", F.col("_id").alias("_u"), F.col("_other").alias("_x"),
                                                   F.greatest(F.col("_sim"), F.lit(0.0)).alias("_w"))
    one = stored(one, "neighbours")  # read twice
    both = one.unionByName(one.select("_g", F.col("_x").alias("_u"), F.col("_u").alias("_x"), "_w"))
    edges = stored(both.groupBy("_g", "_u", "_x").agg(F.max("_w").alias("_w")).where("_w > 0"), "graph")
    degree = stored(edges.groupBy("_g", "_u").agg(F.sum("_w").alias("_d")), "degrees")
    j = edges.join(degree, ["_g", "_u"]).join(degree.select("_g", F.col("_u").alias("_x"), F.col("_d").alias("_e")), ["_g", "_x"])
    return stored(j.select("_g", "_u", "_x", (F.col("_w") / F.sqrt(F.col("_d") * F.col("_e"))).alias("_w"),
                           F.sqrt("_d").alias("_s")), "normalised-graph")


def _cols(prefix: str, p: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(p)]


def _times(edges: DataFrame, X: DataFrame, prefix: str, p: int) -> DataFrame:
    """(_g, _id, z0 ...): the graph times the columns ``prefix``0 ... of X."""
    side = X.select("_g", F.col("_id").alias("_x"), *_cols(prefix, p))
    sums = [F.sum(F.col("_w") * F.col(c)).alias(f"z{j}") for j, c in enumerate(_cols(prefix, p))]
    return edges.join(side, ["_g", "_x"]).groupBy("_g", F.col("_u").alias("_id")).agg(*sums)


def rotate(G: np.ndarray, H: np.ndarray, K: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, Ritz values descending, residuals) from the sums X'X, X'NX and (NX)'NX."""
    values, vectors = np.linalg.eigh(G)
    keep = values > values.max() * 1e-12
    white = vectors[:, keep] / np.sqrt(values[keep])
    theta, inner = np.linalg.eigh(white.T @ ((H + H.T) / 2) @ white)
    M = (white @ inner)[:, ::-1]
    theta = theta[::-1]
    left = np.einsum("ij,ik,kj->j", M, K, M) - theta ** 2
    missing = G.shape[0] - M.shape[1]  # columns that fell together begin anew as zero
    return (np.pad(M, ((0, 0), (0, missing))), np.pad(theta, (0, missing), constant_values=-1.0),
            np.pad(np.sqrt(np.maximum(left, 0.0)), (0, missing)))


def _rotations(p: int):
    def fn(key: tuple, row: pd.DataFrame) -> pd.DataFrame:
        r = row.iloc[0]
        square = lambda name: np.array([[r[f"{name}{i}_{j}" if name == "h" or i <= j else f"{name}{j}_{i}"]
                                         for j in range(p)] for i in range(p)])
        trivial = np.array([r[f"s{j}"] for j in range(p)])
        gone = np.outer(trivial, trivial) / r["ss"]  # N leaves the trivial direction as it is
        M, theta, residual = rotate(square("g") - gone, square("h") - gone, square("k") - gone)
        return pd.DataFrame({"_g": [key[0]], "_m": [M.T.reshape(-1)], "_theta": [theta], "_residual": [residual],
                             "_t": [trivial / r["ss"]]})
    return fn


def _ritz(XZ: DataFrame, p: int) -> DataFrame:
    """Rotation, Ritz values and residuals per group of the table (_g, _id, _s, x0 ..., z0 ...)."""
    x, z = _cols("x", p), _cols("z", p)
    sums = [F.sum(F.col("_s") * F.col("_s")).alias("ss"), *(F.sum(F.col("_s") * F.col(c)).alias(f"s{j}") for j, c in enumerate(x))]
    for i in range(p):
        sums += [F.sum(F.col(x[i]) * F.col(z[j])).alias(f"h{i}_{j}") for j in range(p)]
        sums += [F.sum(F.col(c[i]) * F.col(c[j])).alias(f"{n}{i}_{j}") for n, c in (("g", x), ("k", z)) for j in range(i, p)]
    return stored(XZ.groupBy("_g").agg(*sums).groupBy("_g").applyInPandas(
        _rotations(p), "_g string, _m array<double>, _theta array<double>, _residual array<double>, _t array<double>"), "ritz")


def _turned(prefix: str, p: int) -> list[Column]:
    """The columns less their part in the trivial direction, times the rotation."""
    plain = [F.col(f"{prefix}{i}") - F.col("_s") * F.col("_t")[i] for i in range(p)]
    return [sum((plain[i] * F.col("_m")[j * p + i] for i in range(p)), F.lit(0.0)).alias(f"{prefix}{j}") for j in range(p)]


def _whole(p: int, dims: int, tol: float, max_rounds: int, rounds: int | None = None):
    """The rounds of one group's edges and block in one call.

    Without ``rounds`` it gives the number that the group needs, with it the columns, Ritz values and residuals after so many.
    """
    def fn(key: tuple, edges: pa.Table, block: pa.Table) -> pa.Table:
        block, edges = block.sort_by("_id"), edges.sort_by("_u")
        ids, s = block["_id"].to_numpy(), block["_s"].to_numpy()
        X = np.column_stack([block[c].to_numpy() for c in _cols("x", p)])
        u, x = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("_u", "_x"))
        w, starts = edges["_w"].to_numpy()[:, None], np.flatnonzero(np.diff(u, prepend=-1))

        def times(Y: np.ndarray) -> np.ndarray:
            out = np.zeros_like(Y)
            if len(starts):
                out[u[starts]] = np.add.reduceat(w * Y[x], starts, axis=0)
            return out

        for done in range(1, max_rounds + 1):
            Z = times(X)
            trivial, ss = s @ X, s @ s
            gone = np.outer(trivial, trivial) / ss
            M, theta, residual = rotate(X.T @ X - gone, X.T @ Z - gone, Z.T @ Z - gone)
            X, Z = (X - np.outer(s, trivial / ss)) @ M, (Z - np.outer(s, trivial / ss)) @ M
            if done == rounds if rounds else residual[:dims].max() <= tol:
                break
            a = min(0.9, max(-0.9, theta[p - 1]))
            center, half = (a - 1) / 2, (a + 1) / 2
            before, X = X, (Z - center * X) / half
            for _ in range(DEGREE - 1):
                before, X = X, 2 * (times(X) - center * X) / half - before
        else:
            raise RuntimeError(f"residuals above {tol} after {max_rounds} rounds")
        if not rounds:
            return pa.table([pa.array([key[0].as_py()]), pa.array([done], pa.int32())], names=["_g", "_rounds"])
        n = len(ids)
        values = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p), pa.array(np.tile(v, n))) for v in (theta, residual)]
        return pa.table([pa.repeat(key[0], n), pa.array(ids), *(pa.array(X[:, j].copy()) for j in range(dims)), *values],
                        names=["_g", "_id", *_cols("x", dims), "_theta", "_residual"])
    return fn


def _whole_groups(edges: DataFrame, X: DataFrame, groups: int, p: int, dims: int, tol: float, max_rounds: int) -> DataFrame:
    """(_g, _id, x0 ..., _theta, _residual) of groups that are a call each; all take the rounds of the slowest."""
    tasks = max(1, min(1_000, 2 * groups))  # by groups, however few bytes they have
    both = edges.select("_g", "_u", "_x", "_w").repartition(tasks, "_g").groupBy("_g").cogroup(
        X.repartition(tasks, "_g").groupBy("_g"))
    rounds = both.applyInArrow(_whole(p, dims, tol, max_rounds), "_g string, _rounds int").agg(F.max("_rounds")).first()[0]
    schema = f"_g string, _id long, {', '.join(f'{c} double' for c in _cols('x', dims))}, _theta array<double>, _residual array<double>"
    return stored(both.applyInArrow(_whole(p, dims, tol, max_rounds, rounds or 1), schema), "dimensions")


def _joined_rounds(edges: DataFrame, X: DataFrame, p: int, dims: int, tol: float, max_rounds: int) -> DataFrame:
    """(_g, _id, x0 ..., _theta, _residual) by joins of the edges with the block."""
    zeros = {f"z{j}": 0.0 for j in range(p)}
    for _ in range(max_rounds):
        XZ = stored(X.join(_times(edges, X, "x", p), ["_g", "_id"], "left").fillna(zeros), "block")
        ritz = _ritz(XZ, p)
        XZ = join_small(XZ, ritz, on=["_g"]).select("_g", "_id", "_s", "_theta", *_turned("x", p), *_turned("z", p))
        if ritz.where(F.array_max(F.slice("_residual", 1, dims)) > tol).isEmpty():
            break
        # Chebyshev polynomial on [-1, a], a the smallest Ritz value
        a = F.least(F.lit(0.9), F.greatest(F.lit(-0.9), F.col("_theta")[p - 1]))
        center, half = (a - 1) / 2, (a + 1) / 2
        now = XZ.select("_g", "_id", "_s", center.alias("_c"), half.alias("_e"), *(F.col(c).alias(f"y{j}") for j, c in enumerate(_cols("x", p))),
                        *(((F.col(f"z{j}") - center * F.col(f"x{j}")) / half).alias(f"x{j}") for j in range(p)))
        for _ in range(DEGREE - 1):
            step = stored(now, "filter")
            both = step.join(_times(edges, step, "x", p), ["_g", "_id"], "left").fillna(zeros)
            now = both.select("_g", "_id", "_s", "_c", "_e", *(F.col(f"x{j}").alias(f"y{j}") for j in range(p)),
                              *((2 * (F.col(f"z{j}") - F.col("_c") * F.col(f"x{j}")) / F.col("_e") - F.col(f"y{j}")).alias(f"x{j}")
                                for j in range(p)))
        X = stored(now.select("_g", "_id", "_s", *_cols("x", p)), "block")
    else:
        raise RuntimeError(f"residuals above {tol} after {max_rounds} rounds")
    XZ = XZ.select("_g", "_id", *_cols("x", dims))
    return join_small(XZ, ritz.select("_g", "_theta", "_residual"), on=["_g"])


def spectral_reduce(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, dims: int = 2, k: int = 10,
                    tol: float = 1e-4, max_rounds: int = 60, tile: int = 256, whole: int = 100_000) -> DataFrame:
    """(groups..., id, vec, reduced, eigenvalues, residuals): the point's entries in the group's leading eigenvectors."""
    p = dims + GUARD
    points = group_points(df, group_cols, id_col, vec_col)
    big = stored(points.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > p + 2), "large-groups")
    some = points.join(big, "_g", "left_semi")
    edges = neighbour_graph(some, k, tile)
    roots = edges.groupBy("_g", F.col("_u").alias("_id")).agg(F.max("_s").alias("_s"))
    start = [(F.xxhash64("_id", F.lit(j)) / F.lit(float(1 << 63))).alias(f"x{j}") for j in range(p)]
    X = stored(some.select("_g", "_id").join(roots, ["_g", "_id"], "left").select(
        "_g", "_id", F.coalesce("_s", F.lit(0.0)).alias("_s"), *start), "block")
    one = big.where(F.col("_n") <= whole).select("_g")
    calls, rest = one.count(), big.where(F.col("_n") > whole).select("_g")
    found = []
    if calls:
        found.append(_whole_groups(edges.join(one, "_g", "left_semi"), X.join(one, "_g", "left_semi"), calls, p, dims, tol, max_rounds))
    if not calls or not rest.isEmpty():
        found.append(_joined_rounds(*(stored(d.join(rest, "_g", "left_semi"), "rest") for d in (edges, X)), p, dims, tol, max_rounds))
    XZ = stored(reduce(DataFrame.unionByName, found), "dimensions")
    signs = XZ.groupBy("_g").agg(*(F.max(F.struct(F.round(F.abs(f"x{j}"), 9), -F.col("_id"), F.signum(f"x{j}").alias("s")))["s"].alias(f"s{j}")
                                   for j in range(dims)))
    found = join_small(XZ, signs, on=["_g"]).withColumn("eigenvalues", F.slice("_theta", 1, dims)).withColumn(
        "residuals", F.slice("_residual", 1, dims))
    found = found.select(
        "_g", "_id", F.array(*(F.col(f"x{j}") * F.col(f"s{j}") for j in range(dims))).alias("_r"), "eigenvalues", "residuals")
    out = points.join(found, ["_g", "_id"], "left")
    return out.select(*group_cols, F.col("_key").alias(id_col), F.coalesce("_r", "_v").alias(vec_col),
                      F.col("_r").isNotNull().alias("reduced"), "eigenvalues", "residuals")
