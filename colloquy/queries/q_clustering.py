"""Clustering queries over ``embeddings`` (groups = label) and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.functions.vectors import as_double_array
from colloquy.operators import clustering as C
from colloquy.queries.q_vectors import EV
from colloquy.queries.sqlparts import bag_vectors_sql, lloyd_sql, silhouette_sql
from colloquy.sources.tables import table


def _emb(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", as_double_array("embedding").alias("vec"))


def _one_round(spark, sf_dir, k=3):
    """Every label group clustered by one assignment to its k lowest-id points."""
    pts = _emb(spark, sf_dir)
    firsts = C.first_points_as_centers(pts, ["label"], "vec_id", "vec", k_max=k)
    centers = C.centers_by_group(firsts.withColumnRenamed("rank", "cluster"), ["label"])
    return C.assign(pts, centers, ["label"], "vec")


_ROUND_SQL = f"""{EV},
f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS c FROM embeddings
      QUALIFY c < 3),
cx AS (SELECT f.label, f.c, ev.dim, ev.x FROM f JOIN ev ON ev.vec_id = f.vec_id),
dd AS (SELECT e.vec_id, e.label, cx.c, sum((e.x - cx.x) * (e.x - cx.x)) AS d2
       FROM ev e JOIN cx ON cx.label = e.label AND cx.dim = e.dim GROUP BY e.vec_id, e.label, cx.c),
asg AS (SELECT vec_id, label, c AS cluster FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, c) = 1)"""


@query("assign_to_centers", f"WITH {_ROUND_SQL} SELECT vec_id, label, cluster::INTEGER AS cluster FROM asg")
def assign_to_centers(spark, sf_dir):
    """One k-means assignment step (k = 3, first points as centres) for every group."""
    a = _one_round(spark, sf_dir)
    return a.select("vec_id", "label", F.col("cluster").cast("int").alias("cluster"))


@query("typical_answers", f"""WITH {_ROUND_SQL},
md AS (SELECT a.label, a.cluster, ev.dim, median(ev.x) AS cx FROM asg a JOIN ev ON ev.vec_id = a.vec_id
       GROUP BY a.label, a.cluster, ev.dim),
d2 AS (SELECT a.label, a.cluster, a.vec_id, sum((ev.x - md.cx) * (ev.x - md.cx)) AS d2
       FROM asg a JOIN ev ON ev.vec_id = a.vec_id JOIN md ON md.label = a.label AND md.cluster = a.cluster AND md.dim = ev.dim
       GROUP BY a.label, a.cluster, a.vec_id)
SELECT label, cluster::INTEGER AS cluster, vec_id AS medoid_vec_id, round(d2, 6) AS d2 FROM d2
QUALIFY row_number() OVER (PARTITION BY label, cluster ORDER BY d2, vec_id) = 1""")
def typical_answers(spark, sf_dir):
    """Per (group, cluster): the member nearest the cluster's element-wise median."""
    a = _one_round(spark, sf_dir)
    t = C.typical_members(a, ["label"], "vec_id", "vec", "cluster", "median")
    return t.select("label", F.col("cluster").cast("int").alias("cluster"), "medoid_vec_id", rnd("d2").alias("d2"))


_PAIRS_E = f"""{EV},
pe AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d
       FROM ev a JOIN ev b ON a.dim = b.dim GROUP BY a.vec_id, b.vec_id)"""
_NN_PC = """nn AS (SELECT vec_id, sqrt(sum(x * x)) AS nx FROM ev GROUP BY vec_id),
pc AS (SELECT a.vec_id AS i, b.vec_id AS j,
              CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE 1.0 - sum(a.x * b.x) / (max(na.nx) * max(nb.nx)) END AS d
       FROM ev a JOIN ev b ON a.dim = b.dim JOIN nn na ON na.vec_id = a.vec_id JOIN nn nb ON nb.vec_id = b.vec_id
       GROUP BY a.vec_id, b.vec_id)"""
_PAIRS_C = f"{EV},\n{_NN_PC}"


def _sil_sql(pairs, clusters, keys="k", sfx=""):
    """Per (keys, i) silhouette ``ss{sfx}`` from a pair-distance table and (keys, vec_id, c) clusters."""
    m, own, oth, ss = f"m{sfx}", f"own{sfx}", f"oth{sfx}", f"ss{sfx}"
    return f"""
{m} AS (SELECT ci.{keys}, p.i, cj.c, sum(p.d) AS s, count(*) AS n FROM {pairs} p
      JOIN {clusters} cj ON cj.vec_id = p.j JOIN {clusters} ci ON ci.vec_id = p.i AND ci.{keys} = cj.{keys}
      GROUP BY ci.{keys}, p.i, cj.c),
{own} AS (SELECT x.{keys}, x.i, CASE WHEN x.n <= 1 THEN 0.0 ELSE x.s / (x.n - 1) END AS a, x.n AS sz FROM {m} x
        JOIN {clusters} c ON c.vec_id = x.i AND c.{keys} = x.{keys} AND c.c = x.c),
{oth} AS (SELECT x.{keys}, x.i, min(x.s / x.n) AS b FROM {m} x
        JOIN {clusters} c ON c.vec_id = x.i AND c.{keys} = x.{keys} AND c.c <> x.c GROUP BY x.{keys}, x.i),
{ss} AS (SELECT o.{keys}, o.i, CASE WHEN sz <= 1 OR greatest(a, b) = 0 THEN 0.0
                                      ELSE (b - a) / greatest(a, b) END AS s
       FROM {own} o JOIN {oth} t ON t.{keys} = o.{keys} AND t.i = o.i)"""


_BY_LABEL = "cl AS (SELECT 1 AS k, vec_id, label AS c FROM embeddings)"


def _label_clusters(spark, sf_dir):
    return _emb(spark, sf_dir).withColumn("_all", F.lit(1)).withColumnRenamed("label", "cluster")


@query("silhouette_euclid", f"WITH {_PAIRS_E}, {_BY_LABEL}, {_sil_sql('pe', 'cl')} "
       "SELECT round(avg(s), 6) AS silhouette FROM ss")
def silhouette_euclid(spark, sf_dir):
    """Mean Euclidean silhouette of the labels as clusters (exact, tiled)."""
    s = C.silhouette_samples_euclid(_label_clusters(spark, sf_dir), ["_all"], "vec_id", "vec", "cluster", tile=128)
    return C.silhouette(s, ["_all"]).select(rnd("silhouette").alias("silhouette"))


@query("silhouette_cosine", f"WITH {_PAIRS_C}, {_BY_LABEL}, {_sil_sql('pc', 'cl')} "
       "SELECT round(avg(s), 6) AS silhouette FROM ss")
def silhouette_cosine(spark, sf_dir):
    """Mean cosine silhouette of the labels as clusters (linear form)."""
    s = C.silhouette_samples_cosine(_label_clusters(spark, sf_dir), ["_all"], "vec_id", "vec", "cluster")
    return C.silhouette(s, ["_all"]).select(rnd("silhouette").alias("silhouette"))


@query("silhouette_samples", f"WITH {_PAIRS_E}, {_BY_LABEL}, {_sil_sql('pe', 'cl')} "
       "SELECT i AS vec_id, round(s, 6) AS s FROM ss")
def silhouette_samples(spark, sf_dir):
    """Per-vector Euclidean silhouette with the labels as clusters."""
    s = C.silhouette_samples_euclid(_label_clusters(spark, sf_dir), ["_all"], "vec_id", "vec", "cluster", tile=128)
    return s.select("vec_id", rnd("s").alias("s"))


@query("count_above_mean", f"""WITH {_PAIRS_E}, {_NN_PC}, {_BY_LABEL},
{_sil_sql('pe', 'cl')}, {_sil_sql('pc', 'cl', sfx='2')},
mc AS (SELECT avg(s) AS mu FROM ss2)
SELECT sum(CASE WHEN ss.s > mc.mu THEN 1 ELSE 0 END)::BIGINT AS n_above, count(*)::BIGINT AS n,
       round(sum(CASE WHEN ss.s > mc.mu THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS ratio
FROM ss CROSS JOIN mc""")
def count_above_mean(spark, sf_dir):
    """Points whose Euclidean silhouette exceeds the cosine mean silhouette, and the share."""
    pts = _label_clusters(spark, sf_dir)
    se = C.silhouette_samples_euclid(pts, ["_all"], "vec_id", "vec", "cluster", tile=128)
    mc = C.silhouette(C.silhouette_samples_cosine(pts, ["_all"], "vec_id", "vec", "cluster"), ["_all"])
    c = C.count_above_mean(se, mc, ["_all"])
    return c.select(F.col("n_above").cast("long").alias("n_above"), F.col("n").cast("long").alias("n"),
                    rnd("ratio").alias("ratio"))


# Candidate clusterings for the k rules: label mod k, k = 2..10.
_KS = "cl AS (SELECT k, vec_id, label % k AS c FROM embeddings, range(2, 11) r(k))"


def _mod_clusterings(spark, sf_dir):
    pts = _emb(spark, sf_dir)
    pts = pts.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(10))))
    return pts.withColumn("cluster", F.pmod(F.col("label"), F.col("k")))


@query("best_k_first_max", f"""WITH {_PAIRS_C}, {_KS}, {_sil_sql('pc', 'cl')},
per_k AS (SELECT k, avg(s) AS silhouette FROM ss GROUP BY k)
SELECT k::INTEGER AS k, round(silhouette, 6) AS silhouette FROM per_k ORDER BY silhouette DESC, k LIMIT 1""")
def best_k_first_max(spark, sf_dir):
    """Best k (first maximum of the cosine silhouette) over candidate clusterings."""
    s = C.silhouette_samples_cosine(_mod_clusterings(spark, sf_dir), ["k"], "vec_id", "vec", "cluster")
    per_k = C.silhouette(s, ["k"]).withColumn("_all", F.lit(1))
    b = C.best_k_first_max(per_k, ["_all"])
    return b.select(F.col("k").cast("int").alias("k"), rnd("silhouette").alias("silhouette"))


@query("best_k_by_count", f"""WITH {_PAIRS_E}, {_NN_PC}, {_KS},
{_sil_sql('pe', 'cl')}, {_sil_sql('pc', 'cl', sfx='2')},
mc AS (SELECT k, avg(s) AS mu FROM ss2 GROUP BY k),
cnt AS (SELECT ss.k, sum(CASE WHEN ss.s > mc.mu THEN 1 ELSE 0 END) AS n_above, count(*) AS n
        FROM ss JOIN mc ON mc.k = ss.k GROUP BY ss.k),
best AS (SELECT * FROM cnt ORDER BY n_above DESC, k LIMIT 1)
SELECT (CASE WHEN n_above > 0 THEN k ELSE 1 END)::INTEGER AS k, n_above::BIGINT AS n_above,
       round(n_above::DOUBLE / n, 6) AS ratio FROM best""")
def best_k_by_count(spark, sf_dir):
    """Best k by the count rule: most Euclidean samples above the cosine mean."""
    pts = _mod_clusterings(spark, sf_dir)
    labels = F.transform(F.sequence(F.lit(2), F.lit(10)), lambda k: F.struct(k.alias("k"), F.pmod(F.col("label"), k).alias("cluster")))
    every = _emb(spark, sf_dir).withColumn("_labels", labels).withColumn("_all", F.lit(1))  # distances once for every k
    se = C.silhouettes_of_labellings(every, ["_all"], "vec_id", "vec", "_labels", tile=128)
    mc = C.silhouette(C.silhouette_samples_cosine(pts, ["k"], "vec_id", "vec", "cluster"), ["k"])
    cnt = C.count_above_mean(se, mc, ["k"]).withColumn("_all", F.lit(1))
    b = C.best_k_by_count(cnt, ["_all"])
    return b.select(F.col("k").cast("int").alias("k"), F.col("n_above").cast("long").alias("n_above"),
                    rnd("ratio").alias("ratio"))


# Rounds that the tables need until no assignment changes, with some to spare.
SWEEP_ROUNDS = 20
_POINTS = """
pts AS MATERIALIZED (SELECT label AS g, vec_id AS id, embedding::DOUBLE[] AS vec, true AS own FROM embeddings),
pairs AS MATERIALIZED (SELECT a.g, a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS d FROM pts a
                       JOIN pts b ON b.g = a.g)"""


@query("kmeans_sweep", f"""WITH {_POINTS},
n AS (SELECT g, count(*) AS n FROM pts GROUP BY g),
ks AS (SELECT g, k FROM n, range(2, 11) r(k) WHERE n >= 3 AND k <= n - 1),
{lloyd_sql("km", "pts", "ks", SWEEP_ROUNDS)},
{silhouette_sql("sil", "km_cl", "pairs")}
SELECT g AS label, k::INTEGER AS k, round(avg(s), 6) AS silhouette FROM sil_s GROUP BY g, k""")
def kmeans_sweep(spark, sf_dir):
    """Lloyd k-means for every label group and k = 2..10 at once, with the Euclidean
    silhouette of each clustering."""
    pts = _emb(spark, sf_dir)
    a = C.kmeans_sweep(pts, ["label"], "vec_id", "vec")
    s = C.silhouettes_of_sweep(a, pts, ["label"], "vec_id", "vec", tile=256)
    return C.silhouette(s, ["label", "k"]).select("label", "k", rnd("silhouette").alias("silhouette"))


@query("dominant_cluster", f"""WITH RECURSIVE {_POINTS},
reach(g, i, j) AS (SELECT g, id, id FROM pts
                   UNION SELECT r.g, r.i, p.j FROM reach r JOIN pairs p ON p.g = r.g AND p.i = r.j WHERE p.d <= 1.25),
comp AS (SELECT g, i AS id, min(j) AS comp FROM reach GROUP BY g, i),
n AS (SELECT g, count(*) AS n FROM pts GROUP BY g),
sizes AS (SELECT g, comp, count(*) AS size FROM comp GROUP BY g, comp),
big AS (SELECT s.g, s.comp, s.size FROM sizes s JOIN n ON n.g = s.g WHERE s.size >= greatest(2, n.n // 2)),
cl AS (SELECT c.g, 0 AS k, c.id, coalesce(1 + b.comp, 0) AS c FROM comp c LEFT JOIN big b ON b.g = c.g AND b.comp = c.comp),
fit AS (SELECT g FROM cl GROUP BY g HAVING count(DISTINCT c) BETWEEN 2 AND count(*) - 1),
{silhouette_sql("sil", "cl", "pairs")},
mean AS (SELECT sil_s.g, avg(s) AS s FROM sil_s JOIN fit ON fit.g = sil_s.g GROUP BY sil_s.g),
top AS (SELECT g, count(*) AS n_clusters, max(size) AS size FROM big GROUP BY g)
SELECT n.g AS label, n.n::BIGINT AS n, coalesce(top.n_clusters, 0)::INTEGER AS n_clusters,
       round(coalesce(top.size / n.n, 0.0), 6) AS dominant_share, round(mean.s, 6) AS silhouette
FROM n LEFT JOIN top ON top.g = n.g LEFT JOIN mean ON mean.g = n.g""")
def dominant_cluster(spark, sf_dir):
    """Per label group: density clusters of at least half the group (eps = 1.25),
    their count, the dominant share and the silhouette."""
    _, summary = C.dominant_clusters(_emb(spark, sf_dir), ["label"], "vec_id", "vec", eps=1.25)
    return summary.select("label", "n", F.col("n_clusters").cast("int").alias("n_clusters"),
                          rnd("dominant_share").alias("dominant_share"), rnd("silhouette").alias("silhouette"))


_COSINE_PAIRS = """
cpairs AS MATERIALIZED (SELECT a.g, a.id AS i, b.id AS j,
    CASE WHEN a.id = b.id THEN 0.0 ELSE 1.0 - list_dot_product(a.vec, b.vec)
         / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) END AS d
    FROM pts a JOIN pts b ON b.g = a.g)"""


@query("group_answer_count", f"""WITH
src AS (SELECT source || '/' || lang AS g, source, lang, doc_id AS id, text FROM documents),
{bag_vectors_sql("src", "id", "text", 64, 50)},
pts AS MATERIALIZED (SELECT s.g, s.id, v.vec, true AS own FROM src s JOIN bag_v v ON v.id = s.id
    UNION ALL SELECT g, -1, list(x ORDER BY dim), false FROM (
      SELECT s.g, v.dim, avg(v.x) AS x FROM src s JOIN bag_p v ON v.id = s.id GROUP BY s.g, v.dim) m GROUP BY g),
pairs AS MATERIALIZED (SELECT a.g, a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS d FROM pts a JOIN pts b ON b.g = a.g),
{_COSINE_PAIRS},
n AS (SELECT g, count(*) AS n FROM pts GROUP BY g),
ks AS (SELECT g, k FROM n, range(2, 11) r(k) WHERE n >= 3 AND k <= n - 1),
{lloyd_sql("km", "pts", "ks", SWEEP_ROUNDS)},
{silhouette_sql("se", "km_cl", "pairs")},
{silhouette_sql("sc", "km_cl", "cpairs")},
mc AS (SELECT g, k, avg(s) AS mu FROM sc_s GROUP BY g, k),
cnt AS (SELECT se_s.g, se_s.k, count(*) FILTER (WHERE se_s.s > mc.mu) AS above FROM se_s JOIN mc ON mc.g = se_s.g AND mc.k = se_s.k
        GROUP BY se_s.g, se_s.k),
best AS (SELECT g, CASE WHEN above > 0 THEN k ELSE 1 END AS k FROM cnt
         QUALIFY row_number() OVER (PARTITION BY g ORDER BY above DESC, k) = 1)
SELECT o.source AS chatbot, o.lang AS group_id, coalesce(best.k, 1)::INTEGER AS n_clusters
FROM (SELECT DISTINCT g, source, lang FROM src) o LEFT JOIN best ON best.g = o.g""")
def group_answer_count(spark, sf_dir):
    """Distinct answers per (chatbot = source, group = lang) of documents: hashed
    vectors + the mean row, 50-d projection, k sweep, count rule."""
    from colloquy.plans.consistency import answer_count_per_group

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = answer_count_per_group(docs, ["source", "lang"], "doc_id", "text")
    return out.select(F.col("source").alias("chatbot"), F.col("lang").alias("group_id"),
                      F.col("k").cast("int").alias("n_clusters"))
