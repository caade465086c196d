"""Hierarchical density clusters of many groups at once.

Per group: core distances, the minimum spanning tree of the mutual-reachability
distances max(core(a), core(b), d(a, b)), the condensed tree of clusters of at
least a share of the group, the selection of clusters by excess of mass, and
member probabilities and persistence.

* Points are dealt to tiles and these to parts, every pair of parts is one task (see ``blocks``). A first pass
  gives each point's nearest distances, whose merge holds its
  core distance. In a second pass each task takes the spanning tree of every pair of its tiles
  and then the tree of all their edges: an edge that is not in the tree of some of the points is the longest
  of a circle and not in the group's tree either. What is left, some
  (parts - 1) edges a point, goes through Boruvka rounds of joins: every
  component takes its shortest edge out, components are merged by pointer
  jumping, edges inside a component drop out. A group of one part needs no round.
* Edges have one order, (weight, ids), so the tree is unique. They are
  merged by ascending weight in blocks of ``MERGE_EDGES`` edges of a group, one block after
  the other: a task sees one block of one group, its ends replaced by the
  components before it. A component below the minimum size that joins a larger
  one names the cluster that its points fall out of and the weight; two small ones that reach the size
  are the birth of a cluster; two large ones are the children of a new one.
* With a minimum size of ``min_share`` of the group there are under
  2 / min_share clusters in a tree, so choosing among them sees a bounded table.

No task holds a group of more than one tile. The distances are quadratic in the group's size, as the
exact tree requires; what is shuffled is not.

Rules: lambda is 1 / weight (weights below 1e-6, copies, count as 1e-6). A
cluster's stability is the sum over its points of the lambda at which they
leave it less that at which it begins (0 for the whole group); it is chosen if its stability is no less than what
its descendants' choice adds up to. The whole group can be the only cluster (``allow_single``); its members then are
the points that stay until it splits or ends. Probability is a member's lambda over the largest of those that leave
the cluster itself, 1 at most; persistence is stability over (members x largest lambda of the group).
Noise is cluster -1, clusters are numbered by size (ties: the one that begins at the smaller weight).

Null vectors are left out. A group of one point is noise; a group with fewer
than ``min_samples`` + 1 points takes its farthest neighbour as core distance; ids may repeat
and be of any type with an order; group columns may be null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import as_double_array
from colloquy.operators.blocks import Smallest, blocks, deal, matrix, part_pairs, sides
from colloquy.operators.joins import join_small
from colloquy.operators.positions import positional_index
from colloquy.session import ship_package, stored

MERGE_EDGES = 100_000
LEAST_WEIGHT = 1e-6
PLACES = 12  # decimals of a weight; equal to so many, weights are ties


# ---------------------------------------------------------------------------
# distances and trees
# ---------------------------------------------------------------------------

def pair_distances(L: np.ndarray, R: np.ndarray, chunk: int = 65_536) -> np.ndarray:
    """Euclidean distances; where the fast form loses digits they are taken from the differences."""
    middle = L.mean(axis=0)
    L, R = L - middle, R - middle
    scale = (L * L).sum(1)[:, None] + (R * R).sum(1)[None, :]
    d2 = np.maximum(scale - 2.0 * (L @ R.T), 0.0)
    i, j = np.nonzero(d2 <= 1e-4 * scale)
    for at in range(0, len(i), chunk):
        a, b = i[at:at + chunk], j[at:at + chunk]
        d2[a, b] = ((L[a] - R[b]) ** 2).sum(axis=1)
    return np.round(np.sqrt(d2), PLACES)


def exact_distances(L: np.ndarray, R: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 65_536) -> np.ndarray:
    """Distances of the rows i of L to the rows j of R, from the differences."""
    d2 = [((L[i[at:at + chunk]] - R[j[at:at + chunk]]) ** 2).sum(axis=1) for at in range(0, len(i), chunk)]
    return np.round(np.sqrt(np.concatenate(d2)), PLACES) if d2 else np.zeros(0)


def _nearest_distances(k: int):
    def found(group: pa.Scalar, ids: np.ndarray, best: Smallest) -> pa.Table:
        some = np.isfinite(best.value)
        n = some.sum(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[n > 0])).astype(np.int32)), pa.array(best.value[some]))
        return pa.table([pa.repeat(group, len(lists)), pa.array(ids[n > 0]), lists], names=["_g", "_id", "_near"])

    def fn(key: tuple, table: pa.Table) -> pa.Table:
        two = sides(key, table, ["_id"]) or [table.slice(0, 0)]
        ids, X = [t["_id"].to_numpy() for t in two], [matrix(t["_v"]) if len(t) else np.zeros((0, 1)) for t in two]
        X = [x - X[0].mean(axis=0) for x in X] if len(X[0]) else X
        length = [(x * x).sum(axis=1) for x in X]
        slack = 1e-12 * sum(n.max(initial=0.0) for n in length)  # rounding of a squared distance
        best = [Smallest(len(x), k) for x in X]
        # nothing is nearer than a copy
        limit = lambda b, rows: np.where(b.last(rows) == 0.0, -np.inf, b.last(rows) ** 2 + slack)
        for i, j in blocks(len(X[0]), len(X[-1])):
            d2 = length[0][i, None] + length[-1][j] - 2.0 * (X[0][i] @ X[-1][j].T)
            if len(two) == 1:
                own = np.arange(max(i.start, j.start), min(i.stop, j.stop))
                d2[own - i.start, own - j.start] = np.inf
            exact = lambda a, b: np.where(np.isinf(d2[a, b]), np.inf, exact_distances(X[0][i], X[-1][j], a, b))  # noqa: B023, E731
            best[0].take(i, d2, limit(best[0], i), 2 * slack, exact, ids[-1][j])
            if len(two) > 1:
                best[1].take(j, d2, limit(best[1], j), 2 * slack, exact, ids[0][i], turned=True)
        return pa.concat_tables([found(key[0], n, b) for n, b in zip(ids, best)])
    return fn


def core_distances(points: DataFrame, min_samples: int, tile: int) -> DataFrame:
    """Points with ``_core``, the distance of the ``min_samples``-th nearest other point."""
    near = part_pairs(*deal(points.select("_g", "_id", "_v"), ["_g"], tile), ["_g"]).groupBy("_g", "_a", "_b").applyInArrow(
        _nearest_distances(min_samples), "_g string, _id long, _near array<double>")
    # at most min_samples numbers per part
    merged = near.groupBy(F.col("_g").alias("_h"), F.col("_id").alias("_i")).agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("_near"))), 1, min_samples).alias("_near"))
    j = points.join(merged, (F.col("_g") == F.col("_h")) & (F.col("_id") == F.col("_i")), "left")
    return j.withColumn("_core", F.coalesce(F.array_max("_near"), F.lit(0.0))).drop("_h", "_i", "_near")


def dense_tree(ids: np.ndarray, W: np.ndarray) -> list[tuple[int, int, float]]:
    """Minimum spanning tree of a block; equal weights go by (smaller id, larger id)."""
    n = len(ids)
    out, left = [], np.arange(1, n)
    start, weight = np.zeros(n, dtype=np.int64), W[0].copy()
    for _ in range(n - 1):
        w = weight[left]
        ties = left[w == w.min()]
        if len(ties) > 1:
            a, b = ids[start[ties]], ids[ties]
            ties = ties[np.lexsort((np.maximum(a, b), np.minimum(a, b)))]
        x = ties[0]
        a, b = int(ids[start[x]]), int(ids[x])
        out.append((min(a, b), max(a, b), float(weight[x])))
        left = left[left != x]
        new, old = W[x, left], weight[left]
        better = new < old
        same = np.flatnonzero(new == old)
        if len(same):
            at = left[same]
            was, now, other = ids[start[at]], ids[x], ids[at]
            better[same] = ((np.minimum(now, other) < np.minimum(was, other))
                            | ((np.minimum(now, other) == np.minimum(was, other)) & (np.maximum(now, other) < np.maximum(was, other))))
        start[left[better]], weight[left[better]] = x, new[better]
    return out


def sparse_tree(u: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest; edges go by (weight, ids)."""
    nodes, ends = np.unique(np.concatenate([u, x]), return_inverse=True)
    order = np.lexsort((x, u, w))
    up, kept = list(range(len(nodes))), []

    def find(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    for e, a, b in zip(order.tolist(), ends[:len(u)][order].tolist(), ends[len(u):][order].tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[a] = b
            kept.append(e)
            if len(kept) == len(nodes) - 1:
                break
    return np.array(kept, dtype=np.int64)


def _block_tree(tiles: list[pa.Table]) -> np.ndarray:
    """(smaller id, larger id, weight) of the spanning tree of the points of one or two tiles."""
    ids = np.concatenate([t["_id"].to_numpy() for t in tiles])
    order = np.argsort(ids)
    core = np.concatenate([t["_core"].to_numpy() for t in tiles])[order]
    X = np.vstack([matrix(t["_v"]) for t in tiles])[order]
    W = pair_distances(X, X)
    W = np.maximum(np.maximum(np.minimum(W, W.T), core[:, None]), core[None, :])
    return np.array(dense_tree(ids[order], W), dtype=[("u", np.int64), ("x", np.int64), ("w", np.float64)])


def _part_tree(key: tuple, table: pa.Table) -> pa.Table:
    """The tree of all edges that the trees of the pairs of tiles hold, of one part or between two."""
    two = sides(key, table, ["_tile", "_id"])
    cut = []
    for t in two:
        starts = np.flatnonzero(np.diff(t["_tile"].to_numpy(), prepend=-1))
        cut.append([t.slice(a, b - a) for a, b in zip(starts, [*starts[1:], len(t)])])
    if len(two) > 1:
        pairs = [[a, b] for a in cut[0] for b in cut[1]]
    else:
        pairs = [[a, b] for c in cut for a, b in itertools.combinations(c, 2)] or [[c[0]] for c in cut]
    edges, new = np.zeros(0, dtype=[("u", np.int64), ("x", np.int64), ("w", np.float64)]), []
    for n, pair in enumerate(pairs, 1):
        new.append(_block_tree(pair))
        if n == len(pairs) or sum(map(len, new)) > MERGE_EDGES:
            edges, new = np.concatenate([edges, *new]), []
            edges = edges[sparse_tree(edges["u"], edges["x"], edges["w"])] if len(pairs) > 1 else edges
    parts = table["_parts"][0]
    return pa.table([pa.repeat(key[0], len(edges)), *(pa.array(edges[c]) for c in "uxw"), pa.repeat(parts, len(edges))],
                    names=["_g", "_u", "_x", "_w", "_m"])


# ---------------------------------------------------------------------------
# spanning forest
# ---------------------------------------------------------------------------

def _boruvka(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of the edges (_g, _u, _x, _w) by rounds of joins."""
    edges = stored(edges.select("_g", "_u", "_x", "_w", F.col("_u").alias("_cu"), F.col("_x").alias("_cx")), "edges")
    chosen = None
    while not edges.isEmpty():
        sides = edges.select("_g", "_u", "_x", "_w", F.explode(F.array(
            F.struct(F.col("_cu").alias("c"), F.col("_cx").alias("o")),
            F.struct(F.col("_cx").alias("c"), F.col("_cu").alias("o")))).alias("_s"))
        best = stored(sides.groupBy("_g", F.col("_s.c").alias("_c")).agg(
            F.min(F.struct("_w", "_u", "_x", F.col("_s.o").alias("o"))).alias("_e")), "shortest")
        taken = best.select("_g", "_e._u", "_e._x", "_e._w").distinct()
        chosen = taken if chosen is None else chosen.unionByName(taken)
        # a component hangs on the one that its edge leads to; of two that lead to each other the smaller is the root
        up = best.select("_g", "_c", F.col("_e.o").alias("_p"))
        back = up.select("_g", F.col("_c").alias("_p"), F.col("_p").alias("_q"))
        up = up.join(back, ["_g", "_p"]).select(
            "_g", "_c", F.when((F.col("_q") == F.col("_c")) & (F.col("_c") < F.col("_p")), F.col("_c")).otherwise(F.col("_p")).alias("_p"))
        moved = True
        while moved:
            up = stored(up, "roots")
            for _ in range(2):
                jump = up.select("_g", F.col("_c").alias("_p"), F.col("_p").alias("_q"))
                up = up.join(jump, ["_g", "_p"]).select("_g", "_c", F.col("_q").alias("_p"), (F.col("_p") != F.col("_q")).alias("_moved"))
            up = stored(up, "roots")
            moved = not up.where("_moved").isEmpty()
            up = up.drop("_moved")
        for c in ("_cu", "_cx"):
            edges = edges.join(up.withColumnRenamed("_c", c), ["_g", c], "left").withColumn(c, F.coalesce("_p", c)).drop("_p")
        # of the edges between two components only the first can be of the tree
        a, b = F.least("_cu", "_cx"), F.greatest("_cu", "_cx")
        edges = edges.where("_cu != _cx").groupBy("_g", a.alias("_cu"), b.alias("_cx")).agg(
            F.min(F.struct("_w", "_u", "_x")).alias("_e")).select("_g", "_e._u", "_e._x", "_e._w", "_cu", "_cx")
        edges = stored(edges, "edges")
    return chosen if chosen is not None else edges.select("_g", "_u", "_x", "_w")


def group_points(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str) -> DataFrame:
    """(groups..., _key, _g, _id, _v): ``_g`` names the group, ``_id`` counts its points by id."""
    ship_package(df.sparkSession)
    pts = df.where(F.col(vec_col).isNotNull()).select(*group_cols, F.col(id_col).alias("_key"), as_double_array(vec_col).alias("_v"))
    pts = pts.withColumn("_g", F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}) if group_cols else F.lit(""))
    return stored(positional_index(pts, ["_g"], ["_key", "_v"], "_id"), "points")


def _forest(points: DataFrame, min_samples: int, tile: int) -> DataFrame:
    cored = stored(core_distances(points.select("_g", "_id", "_v"), min_samples, tile), "cores")
    pairs = part_pairs(*deal(cored, ["_g"], tile), ["_g"]).groupBy("_g", "_a", "_b")
    edges = stored(pairs.applyInArrow(_part_tree, "_g string, _u long, _x long, _w double, _m int"), "part-trees")
    several = edges.where("_m > 1")
    whole = edges.where("_m = 1").drop("_m")
    if several.isEmpty():
        return whole
    return stored(whole.unionByName(_boruvka(several.drop("_m").distinct())), "forest")


def spanning_forest(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, min_samples: int = 5,
                    tile: int = 512) -> DataFrame:
    """(groups..., id_a, id_b, weight): the mutual-reachability minimum spanning tree of each group."""
    points = group_points(df, group_cols, id_col, vec_col)
    edges = _forest(points, min_samples, tile)
    side = lambda i, name: points.select("_g", F.col("_id").alias(i), F.col("_key").alias(name))
    out = edges.join(side("_u", f"{id_col}_a"), ["_g", "_u"]).join(
        points.select(*group_cols, "_g", F.col("_id").alias("_x"), F.col("_key").alias(f"{id_col}_b")), ["_g", "_x"])
    return out.select(*group_cols, f"{id_col}_a", f"{id_col}_b", F.col("_w").alias("weight"))


# ---------------------------------------------------------------------------
# condensed tree
# ---------------------------------------------------------------------------

_MERGED = ("_g string, _kind string, _c long, _root long, _size long, _cluster long, _w double, _left long, _right long")


def merge_block(edges: list[tuple], least: int) -> list[tuple]:
    """Merge one block of a group's edges by rank.

    Edges: (rank, weight, (component, size, cluster) of either end); a
    component of fewer than ``least`` points has no cluster yet. Gives rows (kind, component, root, size, cluster,
    weight, left, right): ``part`` for the component that each one is in afterwards, ``fate`` for the
    cluster that a small one's points fall out of, ``node`` for a cluster and its children.
    """
    up: dict[int, int] = {}
    size: dict[int, int] = {}
    cluster: dict[int, int | None] = {}
    small: dict[int, list[int]] = {}
    out: list[tuple] = []

    def find(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    for rank, weight, *ends in sorted(edges):
        for c, n, k in ends:
            if c not in up:
                up[c], size[c], cluster[c] = c, n, k
                if k is None:
                    small[c] = [c]
        a, b = find(ends[0][0]), find(ends[1][0])
        if size[a] < size[b]:
            a, b = b, a
        ka, kb = cluster[a], cluster[b]
        total = size[a] + size[b]
        if ka is None and total < least:
            small[a] += small.pop(b)
            k = None
        else:
            k = ka
            if ka is None:
                k = rank
                out.append(("node", None, None, total, k, weight, None, None))
            elif kb is not None:
                k = rank
                out.append(("node", None, None, total, k, weight, ka, kb))
            for root in (a, b):
                for c in small.pop(root, []):
                    out.append(("fate", c, None, None, k, weight, None, None))
        up[b], size[a], cluster[a] = a, total, k
    for c in up:
        root = find(c)
        out.append(("part", c, root, size[root], cluster[root], None, None, None))
    return out


def _int(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    cols = ["_rank", "_w", "_cu", "_su", "_ku", "_cx", "_sx", "_kx"]
    edges = [(int(r), float(w), (int(cu), int(su), _int(ku)), (int(cx), int(sx), _int(kx)))
             for r, w, cu, su, ku, cx, sx, kx in zip(*(rows[c].tolist() for c in cols))]
    out = pd.DataFrame(merge_block(edges, int(rows["_least"].iloc[0])),
                       columns=["_kind", "_c", "_root", "_size", "_cluster", "_w", "_left", "_right"])
    out.insert(0, "_g", key[0])
    for c in ("_c", "_root", "_size", "_cluster", "_left", "_right"):
        out[c] = out[c].astype("Int64")
    return out


def condensed_tree(points: DataFrame, edges: DataFrame, min_share: float,
                   merge_edges: int = MERGE_EDGES) -> tuple[DataFrame, DataFrame]:
    """(points with the cluster ``_k`` they fall out of and the weight ``_w`` at which, clusters with weight and children)."""
    least = points.groupBy("_g").agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * F.lit(min_share))).cast("long").alias("_least"))
    ranked = positional_index(edges, ["_g"], ["_w", "_u", "_x"], "_rank")
    ranked = stored(join_small(ranked, least, on=["_g"]), "ranked-edges")
    top = ranked.agg(F.max("_rank")).first()[0]
    state = points.select("_g", "_id", F.col("_id").alias("_c"), F.lit(1).cast("long").alias("_size"),
                          F.lit(None).cast("long").alias("_cluster"), F.lit(None).cast("long").alias("_k"),
                          F.lit(None).cast("double").alias("_w"))
    nodes = None
    for at in range(0, -1 if top is None else top + 1, merge_edges):
        block = ranked.where(F.col("_rank").between(at, at + merge_edges - 1))
        for end, names in (("_u", ("_cu", "_su", "_ku")), ("_x", ("_cx", "_sx", "_kx"))):
            block = block.join(state.select("_g", F.col("_id").alias(end), *(
                F.col(c).alias(n) for c, n in zip(("_c", "_size", "_cluster"), names))), ["_g", end])
        merged = stored(block.groupBy("_g").applyInPandas(_merge, _MERGED), "merged")
        made = merged.where("_kind = 'node'").select("_g", F.col("_cluster").alias("_k"), "_w", "_left", "_right")
        nodes = made if nodes is None else nodes.unionByName(made)
        part = merged.where("_kind = 'part'").select("_g", "_c", "_root", F.col("_size").alias("_n"), F.col("_cluster").alias("_kn"))
        fate = merged.where("_kind = 'fate'").select("_g", "_c", F.col("_cluster").alias("_kf"), F.col("_w").alias("_wf"))
        state = stored(state.join(part, ["_g", "_c"], "left").join(fate, ["_g", "_c"], "left").select(
            "_g", "_id", F.coalesce("_root", "_c").alias("_c"), F.coalesce("_n", "_size").alias("_size"),
            F.when(F.col("_root").isNull(), F.col("_cluster")).otherwise(F.col("_kn")).alias("_cluster"),
            F.coalesce("_k", "_kf").alias("_k"), F.coalesce("_w", "_wf").alias("_w")), "components")
    if nodes is None:
        nodes = state.select("_g", "_k", "_w", F.col("_k").alias("_left"), F.col("_k").alias("_right")).where("false")
    return state.select("_g", "_id", "_k", "_w"), nodes


def choose(nodes: list[tuple], allow_single: bool) -> list[tuple]:
    """Excess of mass over one tree.

    Nodes: (cluster, weight, left, right, points that fall out, sum and largest of their lambdas). Gives (cluster,
    label or -1, lambda that a member needs, lambda of probability 1, stability of the label's cluster).
    """
    nodes = sorted(nodes)
    lam = {k: 1.0 / max(w, LEAST_WEIGHT) for k, w, *_ in nodes}
    begin = {c: lam[k] for k, _, left, right, *_ in nodes for c in (left, right) if left is not None}
    size, own, best, death, kids = {}, {}, {}, {}, {}
    for k, _, left, right, n, total, top in nodes:
        kids[k] = [] if left is None else [left, right]
        b = begin.get(k, 0.0)
        size[k] = n + sum(size[c] for c in kids[k])
        own[k] = total - n * b + sum((lam[k] - b) * size[c] for c in kids[k])
        death[k] = max([top, *([lam[k]] if kids[k] else [])])
    root = nodes[-1][0]
    chosen = set()
    for k, *_ in nodes:
        below = sum(best[c] for c in kids[k])
        if (k == root and not allow_single) or (kids[k] and below > own[k]):
            best[k] = below
            continue
        best[k] = own[k]
        rest = list(kids[k])
        while rest:
            c = rest.pop()
            chosen.discard(c)
            rest += kids[c]
        chosen.add(k)
    label = {k: i for i, k in enumerate(sorted(chosen, key=lambda k: (-size[k], k)))}
    out, rest = [], [(root, None)]
    while rest:
        k, above = rest.pop()
        mine = k if k in chosen else above
        rest += [(c, mine) for c in kids[k]]
        if mine is None:
            out.append((k, -1, 0.0, 1.0, 0.0))
        else:
            out.append((k, label[mine], death[mine] if mine == root else 0.0, death[mine], own[mine]))
    return out


def _choose(allow_single: bool):
    def fn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = [(int(k), w, _int(left), _int(right), int(n), total, top) for k, w, left, right, n, total, top in
                 zip(*(rows[c].tolist() for c in ("_k", "_w", "_left", "_right", "_n", "_sum", "_top")))]
        out = pd.DataFrame(choose(nodes, allow_single), columns=["_k", "cluster", "_need", "_death", "_stability"])
        out.insert(0, "_g", key[0])
        return out
    return fn


def density_clusters(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, min_share: float = 0.5,
                     min_samples: int = 5, allow_single: bool = True, tile: int = 512,
                     merge_edges: int = MERGE_EDGES) -> tuple[DataFrame, DataFrame]:
    """(members: groups, id, cluster, probability; clusters: groups, cluster, size, persistence).

    ``min_share`` is the least size of a cluster as a share of its group (two points at least).
    """
    points = group_points(df, group_cols, id_col, vec_col)
    falls, nodes = condensed_tree(points.select("_g", "_id"), _forest(points, min_samples, tile), min_share, merge_edges)
    falls = stored(falls.withColumn("_lambda", 1.0 / F.greatest(F.col("_w"), F.lit(LEAST_WEIGHT))).drop("_w"), "falls")
    sums = falls.where("_k IS NOT NULL").groupBy("_g", "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_lambda").alias("_sum"), F.max("_lambda").alias("_top"))
    tree = nodes.join(sums, ["_g", "_k"], "left").fillna({"_n": 0, "_sum": 0.0, "_top": 0.0})
    found = stored(tree.groupBy("_g").applyInPandas(  # under 2 / min_share rows a group
        _choose(allow_single), "_g string, _k long, cluster int, _need double, _death double, _stability double"), "chosen")
    stays = (F.col("cluster") >= 0) & (F.col("_lambda") >= F.col("_need"))
    members = falls.join(found, ["_g", "_k"], "left").withColumn(
        "probability", F.when(stays, F.least(F.lit(1.0), F.col("_lambda") / F.col("_death"))).otherwise(F.lit(0.0))).withColumn(
        "cluster", F.when(stays, F.col("cluster")).otherwise(F.lit(-1)))
    sizes = members.where("cluster >= 0").groupBy("_g", "cluster").agg(F.count(F.lit(1)).alias("size"), F.max("_stability").alias("_s"))
    last = falls.groupBy("_g").agg(F.max("_lambda").alias("_last"))
    names = points.groupBy("_g").agg(*(F.first(c).alias(c) for c in group_cols))
    clusters = sizes.join(last, "_g").join(names, "_g").select(
        *group_cols, "cluster", "size", (F.col("_s") / (F.col("size") * F.col("_last"))).alias("persistence"))
    out = members.join(points.select("_g", "_id", "_key", *group_cols), ["_g", "_id"])
    return out.select(*group_cols, F.col("_key").alias(id_col), "cluster", "probability"), clusters


def cluster_report(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, min_share: float = 0.5,
                   min_samples: int = 5, tile: int = 512) -> DataFrame:
    """Per group: n, clusters, noise, the largest cluster's size, persistence and mean member probability, and the
    silhouette of the labels with noise as one of them (null unless there are 2 to n - 1 labels)."""
    from colloquy.operators import clustering as C

    members, clusters = density_clusters(df, group_cols, id_col, vec_col, min_share, min_samples, tile=tile)
    members = stored(members, "members")
    key = lambda d: d.withColumn("_g", F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}))
    members, clusters = key(members), key(clusters).drop(*group_cols)
    counts = members.groupBy("_g").agg(
        *(F.first(c).alias(c) for c in group_cols), F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("cluster") < 0, 1)).alias("n_noise"), F.countDistinct("cluster").alias("_labels"),
        F.avg(F.when(F.col("cluster") == 0, F.col("probability"))).alias("mean_probability"))
    first = clusters.where("cluster = 0").select("_g", "size", "persistence")
    number = clusters.groupBy("_g").agg(F.count(F.lit(1)).alias("n_clusters"))
    fit = counts.where("_labels >= 2 AND _labels < n").select("_g")
    vecs = key(df.select(*group_cols, id_col, vec_col)).drop(*group_cols)
    labelled = members.drop(*group_cols).join(fit, "_g", "left_semi").join(vecs, ["_g", id_col])
    sil = C.silhouette(C.silhouette_samples_euclid(labelled, ["_g"], id_col, vec_col, "cluster", tile), ["_g"])
    out = counts.join(number, "_g", "left").join(first, "_g", "left").join(sil, "_g", "left")
    return out.select(*group_cols, "n", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), "n_noise",
                      F.coalesce("size", F.lit(0)).alias("size"), "persistence", "mean_probability", "silhouette")
