"""Hierarchical density clusters of ``embeddings`` (groups = label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.operators import density as D
from colloquy.queries.q_clustering import _emb


@query("density_forest", """WITH RECURSIVE
pts AS (SELECT label AS g, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS MATERIALIZED (SELECT a.g, a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM pts a JOIN pts b ON b.g = a.g AND b.id <> a.id),
core AS (SELECT g, i, max(d) AS c FROM (SELECT g, i, d, row_number() OVER (PARTITION BY g, i ORDER BY d) AS r FROM d) x
         WHERE r <= 5 GROUP BY g, i),
w AS MATERIALIZED (SELECT d.g, d.i, d.j, greatest(d.d, a.c, b.c) AS w FROM d JOIN core a ON a.g = d.g AND a.i = d.i
                   JOIN core b ON b.g = d.g AND b.i = d.j),
grown(g, tree, w) AS (SELECT g, [min(id)], NULL::DOUBLE FROM pts GROUP BY g
    UNION ALL SELECT p.g, list_append(any_value(p.tree), arg_min(w.j, w.w)), min(w.w) FROM grown p
              JOIN w ON w.g = p.g AND list_contains(p.tree, w.i) AND NOT list_contains(p.tree, w.j) GROUP BY p.g)
SELECT g AS label, (row_number() OVER (PARTITION BY g ORDER BY w))::INTEGER AS rank, round(w, 6) AS weight
FROM grown WHERE w IS NOT NULL""")
def density_forest(spark, sf_dir):
    """Edge weights of each label group's mutual-reachability spanning tree, by rank."""
    from colloquy.operators.positions import positional_index

    edges = D.spanning_forest(_emb(spark, sf_dir), ["label"], "vec_id", "vec", min_samples=5)
    ranked = positional_index(edges, ["label"], ["weight", "vec_id_a", "vec_id_b"], "rank")
    return ranked.select("label", (F.col("rank") + 1).cast("int").alias("rank"), rnd("weight").alias("weight"))


@query("density_clusters")
def density_clusters(spark, sf_dir):
    """Cluster and probability of every vector, clusters of at least a tenth of their label group."""
    members, _ = D.density_clusters(_emb(spark, sf_dir), ["label"], "vec_id", "vec", min_share=0.1, min_samples=5)
    return members.select("label", "vec_id", "cluster", rnd("probability").alias("probability"))


@query("cluster_report")
def cluster_report(spark, sf_dir):
    """Per label group: clusters of at least half of it, noise, persistence, mean probability, silhouette."""
    r = D.cluster_report(_emb(spark, sf_dir), ["label"], "vec_id", "vec", min_share=0.5, min_samples=5)
    return r.select("label", "n", F.col("n_clusters").cast("int").alias("n_clusters"), "n_noise", "size",
                    *(rnd(c).alias(c) for c in ("persistence", "mean_probability", "silhouette")))


@query("neighbour_graph_reduced")
def neighbour_graph_reduced(spark, sf_dir):
    """Two leading eigenvector dimensions of each label group's neighbour graph, with eigenvalues."""
    from colloquy.operators import spectral as S

    r = S.spectral_reduce(_emb(spark, sf_dir), ["label"], "vec_id", "vec", dims=2, k=10)
    return r.select("label", "vec_id", "reduced", rnd(F.col("vec")[0], 3).alias("x"), rnd(F.col("vec")[1], 3).alias("y"),
                    *(rnd(F.col("eigenvalues")[j], 4).alias(f"eigenvalue_{j + 1}") for j in range(2)))


@query("seeding_cost")
def seeding_cost(spark, sf_dir):
    """Per label group: cost of five oversampled k-means seeds, of the first five different vectors, and of the cheaper."""
    from colloquy.operators import seeding as S

    _, costs = S.best_seeds(_emb(spark, sf_dir), ["label"], "vec_id", "vec", 5)
    return costs.select("label", *(rnd(c, 4).alias(c) for c in ("cost_oversampled", "cost_first", "cost")))
