"""Density clusters against a plain top-down version over the full distance matrix."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import density as D


def _weights(X, k):
    d = np.round(np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), D.PLACES)
    n = len(X)
    core = np.array([np.sort(np.delete(d[i], i))[min(k, n - 1) - 1] if n > 1 else 0.0 for i in range(n)])
    return np.maximum(np.maximum(d, core[:, None]), core[None, :])


def _tree(W):
    """Kruskal over all edges in order of (weight, ids)."""
    n, up, out = len(W), list(range(len(W))), []
    for w, i, j in sorted((W[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = i, j
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        if a != b:
            up[a] = b
            out.append((w, i, j))
    return out


def _parts(points, edges):
    near = {p: [] for p in points}
    for _, i, j in edges:
        near[i].append(j)
        near[j].append(i)
    out, left = [], set(points)
    while left:
        part, todo = set(), [next(iter(left))]
        while todo:
            p = todo.pop()
            if p not in part:
                part.add(p)
                todo += near[p]
        left -= part
        out.append(part)
    return out


def _brute(X, k, share, allow_single=True):
    """(labels, probabilities, {label: persistence}) by cutting the tree from its longest edge down."""
    n = len(X)
    if n < 2:
        return [-1] * n, [0.0] * n, {}
    least, lam = max(2, int(n * share)), lambda w: 1 / max(w, D.LEAST_WEIGHT)
    clusters = []  # dicts: begin, rows (lambda, points), children

    def walk(points, edges, begin):
        me = {"begin": begin, "rows": [], "kids": [], "first": 0.0}
        clusters.append(me)
        number = len(clusters) - 1
        while True:
            edges = sorted(edges)
            if not edges:
                me["rows"].append((me["rows"][-1][0], points))
                return number
            w, *ends = edges.pop()
            me["first"] = (w, *ends)
            a, b = _parts(points, edges)
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            inside = lambda p: [e for e in edges if e[1] in p]
            if len(b) >= least:
                me["kids"] = [walk(p, inside(p), lam(w)) for p in (a, b)]
                me["split"] = (lam(w), [len(a), len(b)])
                return number
            me["rows"].append((lam(w), b))
            if len(a) < least:
                me["rows"].append((lam(w), a))
                return number
            points, edges = a, inside(a)

    walk(set(range(n)), _tree(_weights(X, k)), 0.0)

    def size(c):
        return sum(len(p) for _, p in clusters[c]["rows"]) + sum(size(x) for x in clusters[c]["kids"])

    def mass(c):
        c = clusters[c]
        total = sum((x - c["begin"]) * len(p) for x, p in c["rows"])
        return total + (sum((c["split"][0] - c["begin"]) * s for s in c["split"][1]) if c["kids"] else 0)

    def pick(c):
        below = [pick(x) for x in clusters[c]["kids"]]
        total = sum(b for b, _ in below)
        if (c == 0 and not allow_single) or (below and total > mass(c)):
            return total, [x for _, xs in below for x in xs]
        return mass(c), [c]

    chosen = sorted(pick(0)[1], key=lambda c: (-size(c), clusters[c]["first"]))
    labels, prob, falls = [-1] * n, [0.0] * n, {}

    def fall(c, label, need, death):
        for x, points in clusters[c]["rows"]:
            for p in points:
                falls[p] = x
                if label >= 0 and x >= need:
                    labels[p], prob[p] = label, min(1.0, x / death)
        for kid in clusters[c]["kids"]:
            here = (chosen.index(kid), 0.0, None) if kid in chosen else (label, need, death)
            fall(kid, here[0], here[1], _death(clusters[kid]) if kid in chosen else here[2])

    def _death(c):
        return max([x for x, _ in c["rows"]] + ([c["split"][0]] if c["kids"] else []))

    if 0 in chosen:
        fall(0, 0, _death(clusters[0]), _death(clusters[0]))
    else:
        fall(0, -1, 0.0, 1.0)
    top = max(falls.values())
    return labels, prob, {i: mass(c) / (labels.count(i) * top) for i, c in enumerate(chosen)}


def _groups(rng):
    blob = lambda n, at, s: rng.normal(size=(n, 3)) * s + at
    return {
        "two": np.vstack([blob(30, 0, 0.2), blob(22, 4, 0.3), blob(8, 9, 3.0)]),
        "one": np.vstack([blob(25, 1, 0.5), blob(5, 6, 2.0)]),
        "copies": np.vstack([np.repeat(blob(3, 0, 1.0), 9, axis=0), blob(6, 3, 1.0)]),
        "nested": np.vstack([blob(15, 0, 0.1), blob(15, 0.8, 0.1), blob(20, 6, 0.4)]),
        "grid": np.array([[i, j, 0.0] for i in range(6) for j in range(5)]),  # all weights tie
        "pair": blob(2, 0, 1.0), "single": blob(1, 0, 1.0), None: blob(12, 0, 1.0),
    }


@pytest.mark.parametrize("share,allow_single,tile,merge_edges", [(0.5, True, 512, 100_000), (0.15, True, 8, 7), (0.2, False, 512, 5)])
def test_clusters_match_top_down(spark, share, allow_single, tile, merge_edges):
    groups = _groups(np.random.default_rng(11))
    rows = [(g, f"{i:03d}", [float(x) for x in v]) for g, X in groups.items() for i, v in enumerate(X)]
    df = spark.createDataFrame(rows + [("one", "null", None)], "grp string, id string, vec array<double>").repartition(5)
    members, clusters = D.density_clusters(df, ["grp"], "id", "vec", share, 4, allow_single, tile, merge_edges)
    got = {(r["grp"], r["id"]): (r["cluster"], r["probability"]) for r in members.collect()}
    reports = {(r["grp"], r["cluster"]): (r["size"], r["persistence"]) for r in clusters.collect()}
    want_reports = {}
    for g, X in groups.items():
        labels, prob, persistence = _brute(X, 4, share, allow_single)
        assert [got[g, f"{i:03d}"][0] for i in range(len(X))] == labels, g
        assert np.allclose([got[g, f"{i:03d}"][1] for i in range(len(X))], prob)
        want_reports |= {(g, c): (labels.count(c), p) for c, p in persistence.items()}
    assert len(got) == len(rows) and reports.keys() == want_reports.keys()
    assert all(reports[k][0] == v[0] and abs(reports[k][1] - v[1]) < 1e-9 for k, v in want_reports.items())
    assert len(reports) >= 5


def test_forest_is_the_same_for_any_tiles(spark):
    groups = _groups(np.random.default_rng(12))
    rows = [(g, i, [float(x) for x in v]) for g, X in groups.items() for i, v in enumerate(X)]
    df = spark.createDataFrame(rows, "grp string, id long, vec array<double>")
    for tile in (512, 6):
        got = {(r["grp"], r["id_a"], r["id_b"], round(r["weight"], 9)) for r in D.spanning_forest(df, ["grp"], "id", "vec", 3, tile).collect()}
        assert got == {(g, i, j, round(w, 9)) for g, X in groups.items() for w, i, j in _tree(_weights(X, 3))}
    assert D.spanning_forest(df.where("false"), ["grp"], "id", "vec").count() == 0
    assert [d.count() for d in D.density_clusters(df.where("false"), ["grp"], "id", "vec")] == [0, 0]
