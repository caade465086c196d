"""Vector queries over ``embeddings`` (groups = ``label``) and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.functions.vectors import as_double_array, cosine
from colloquy.operators import vectors as V
from colloquy.operators.joins import join_small
from colloquy.queries.sqlparts import TOKENS
from colloquy.sources.tables import table

EV = """e0 AS (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS dim FROM embeddings),
ev AS (SELECT vec_id, label, dim, embedding[dim + 1]::DOUBLE AS x FROM e0)"""


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def _long_out(df, keys, vec_col, name="value"):
    return df.select(*keys, F.posexplode(vec_col).alias("dim", "_v")).select(*keys, "dim", rnd("_v").alias(name))


_COS_SQL = f"""WITH {EV},
m AS (SELECT label, dim, avg(x) AS mu FROM ev GROUP BY label, dim),
c AS (SELECT e.vec_id, e.label, sum(e.x * m.mu) AS dt, sum(e.x * e.x) AS nx, sum(m.mu * m.mu) AS nm
      FROM ev e JOIN m ON m.label = e.label AND m.dim = e.dim GROUP BY e.vec_id, e.label),
s AS (SELECT vec_id, label, CASE WHEN sqrt(nx) * sqrt(nm) = 0 THEN 0.0 ELSE dt / (sqrt(nx) * sqrt(nm)) END AS cos FROM c)"""


def _cos_to_mean(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    means = V.mean_vectors(emb, ["label"], "embedding", "_mean")
    j = join_small(emb, means, on=["label"])
    return j.select("vec_id", "label", cosine("embedding", "_mean").alias("cos"))


@query("cosine_to_main", _COS_SQL + " SELECT vec_id, label, round(cos, 6) AS cos FROM s")
def cosine_to_main(spark, sf_dir):
    """Cosine of every vector to its group's mean vector."""
    return _cos_to_mean(spark, sf_dir).select("vec_id", "label", rnd("cos").alias("cos"))


@query("similar_items", _COS_SQL + " SELECT vec_id, label, round(cos, 6) AS cos FROM s WHERE cos > 0.3::DOUBLE")
def similar_items(spark, sf_dir):
    """Vectors whose cosine to the group's main (mean) vector exceeds 0.3 (strict)."""
    c = _cos_to_mean(spark, sf_dir)
    return c.where(F.col("cos") > 0.3).select("vec_id", "label", rnd("cos").alias("cos"))


@query("mean_vector", f"WITH {EV} SELECT label, dim, round(avg(x), 6) AS value FROM ev GROUP BY label, dim")
def mean_vector(spark, sf_dir):
    m = V.mean_long(_emb(spark, sf_dir), ["label"], "embedding")
    return m.select("label", "dim", rnd("value").alias("value"))


@query("median_vector", f"WITH {EV} SELECT label, dim, round(median(x), 6) AS value FROM ev GROUP BY label, dim")
def median_vector(spark, sf_dir):
    m = V.median_long(_emb(spark, sf_dir), ["label"], "embedding")
    return m.select("label", "dim", rnd("value").alias("value"))


@query("append_mean_row", f"""WITH {EV},
m AS (SELECT label, dim, avg(x) AS x FROM ev GROUP BY label, dim),
u AS (SELECT label, vec_id, false AS is_mean, dim, x FROM ev
      UNION ALL SELECT label, NULL, true, dim, x FROM m)
SELECT label, vec_id, is_mean, round(sqrt(sum(x * x)), 6) AS norm, round(max(x) FILTER (WHERE dim = 0), 6) AS x0
FROM u GROUP BY label, vec_id, is_mean""")
def append_mean_row(spark, sf_dir):
    """Group rows plus a flagged mean row; reported as (norm, first component)."""
    u = V.append_mean_row(_emb(spark, sf_dir), ["label"], "vec_id", "embedding")
    return u.select("label", "vec_id", "is_mean",
                    rnd(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"),
                    rnd(F.element_at("embedding", 1)).alias("x0"))


@query("standardize", f"""WITH {EV},
st AS (SELECT label, dim, avg(x) AS mu, stddev_pop(x) AS sd FROM ev GROUP BY label, dim)
SELECT e.vec_id, e.dim, round((e.x - st.mu) / CASE WHEN st.sd = 0 OR st.sd IS NULL THEN 1.0 ELSE st.sd END, 6) AS z
FROM ev e JOIN st ON st.label = e.label AND st.dim = e.dim""")
def standardize(spark, sf_dir):
    s = V.standardize(_emb(spark, sf_dir), ["label"], "embedding", "z")
    return _long_out(s, ["vec_id"], "z", "z")


def _medoid_sql(center):
    agg = "median(x)" if center == "median" else "avg(x)"
    return f"""WITH {EV},
c AS (SELECT label, dim, {agg} AS cx FROM ev GROUP BY label, dim),
d AS (SELECT e.label, e.vec_id, sum((e.x - c.cx) * (e.x - c.cx)) AS d2
      FROM ev e JOIN c ON c.label = e.label AND c.dim = e.dim GROUP BY e.label, e.vec_id)
SELECT label, vec_id AS medoid_vec_id, round(d2, 6) AS d2 FROM d
QUALIFY row_number() OVER (PARTITION BY label ORDER BY d2, vec_id) = 1"""


@query("medoid_median", _medoid_sql("median"))
def medoid_median(spark, sf_dir):
    m = V.medoid(_emb(spark, sf_dir), ["label"], "vec_id", "embedding", "median")
    return m.select("label", "medoid_vec_id", rnd("d2").alias("d2"))


@query("medoid_mean", _medoid_sql("mean"))
def medoid_mean(spark, sf_dir):
    m = V.medoid(_emb(spark, sf_dir), ["label"], "vec_id", "embedding", "mean")
    return m.select("label", "medoid_vec_id", rnd("d2").alias("d2"))


HASH_SQL = f"""t AS (SELECT doc_id, unnest({TOKENS.format(text='text')}) AS tok FROM documents),
hb AS (SELECT doc_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 64)::INTEGER AS dim, count(*) AS c
       FROM t WHERE tok <> '' GROUP BY doc_id, dim),
hn AS (SELECT doc_id, sqrt(sum(c * c)) AS nn FROM hb GROUP BY doc_id),
hv AS (SELECT hb.doc_id, hb.dim, hb.c / hn.nn AS value FROM hb JOIN hn ON hn.doc_id = hb.doc_id)"""


@query("hash_embed", f"WITH {HASH_SQL} SELECT doc_id, dim, round(value, 6) AS value FROM hv")
def hash_embed(spark, sf_dir):
    """Hashed bag-of-words vectors of all documents (64 buckets), non-zero entries."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = V.hash_embed(docs, "text", 64)
    # *_outer: a plain posexplode makes the optimizer infer size(vec) > 0,
    # which would evaluate the Python UDF a second time inside the filter.
    out = e.select("doc_id", F.posexplode_outer("vec").alias("dim", "value")).where(F.col("value") != 0)
    return out.select("doc_id", "dim", rnd("value").alias("value"))


def _sign_sql(in_dim, out_dim):
    return f"""rm AS (SELECT i, j, (CASE WHEN substr(md5(i::VARCHAR || '_' || j::VARCHAR), 1, 1) < '8'
                THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) / sqrt({out_dim}.0::DOUBLE) AS r
          FROM range({in_dim}) a(i) CROSS JOIN range({out_dim}) b(j))"""


@query("project", f"""WITH {EV}, {_sign_sql(64, 2)}
SELECT ev.vec_id, rm.j AS dim, round(sum(ev.x * rm.r), 6) AS value
FROM ev JOIN rm ON rm.i = ev.dim GROUP BY ev.vec_id, rm.j""")
def project(spark, sf_dir):
    """Random-sign projection of every vector to 2 dimensions."""
    p = V.project(_emb(spark, sf_dir), "embedding", 64, 2, "proj")
    return _long_out(p, ["vec_id"], "proj")


@query("reduced_by_chatbot", f"""WITH {EV}, {_sign_sql(64, 2)},
gm AS (SELECT dim, avg(x) AS x FROM ev GROUP BY dim),
pi AS (SELECT ev.label, ev.vec_id, rm.j, sum(ev.x * rm.r) AS v FROM ev JOIN rm ON rm.i = ev.dim
       GROUP BY ev.label, ev.vec_id, rm.j),
pm AS (SELECT rm.j, sum(gm.x * rm.r) AS v FROM gm JOIN rm ON rm.i = gm.dim GROUP BY rm.j),
lab AS (SELECT DISTINCT label FROM embeddings)
SELECT label, vec_id, false AS is_mean, round(max(v) FILTER (WHERE j = 0), 6) AS comp1,
       round(max(v) FILTER (WHERE j = 1), 6) AS comp2 FROM pi GROUP BY label, vec_id
UNION ALL
SELECT lab.label, NULL, true, round(max(v) FILTER (WHERE j = 0), 6), round(max(v) FILTER (WHERE j = 1), 6)
FROM lab CROSS JOIN pm GROUP BY lab.label""")
def reduced_by_chatbot(spark, sf_dir):
    """Per group (label): its vectors plus the global mean row, projected to 2-D."""
    emb = _emb(spark, sf_dir).select("label", "vec_id", as_double_array("embedding").alias("embedding"))
    gmean = V.mean_vectors(emb.withColumn("_k", F.lit(1)), ["_k"], "embedding", "embedding")
    labels = emb.select("label").distinct().withColumn("_k", F.lit(1))
    mrows = join_small(labels, gmean, on=["_k"]).drop("_k").withColumn("vec_id", F.lit(None).cast("long"))
    items = emb.withColumn("is_mean", F.lit(False))
    u = items.unionByName(mrows.withColumn("is_mean", F.lit(True)))
    p = V.project(u, "embedding", 64, 2, "proj")
    return p.select("label", "vec_id", "is_mean", rnd(F.col("proj")[0]).alias("comp1"),
                    rnd(F.col("proj")[1]).alias("comp2"))


@query("reduce_pca")
def reduce_pca(spark, sf_dir):
    """First two principal components of all vectors (Spark ML; rows-only check)."""
    p = V.pca(_emb(spark, sf_dir), "embedding", 2, "pca")
    return p.select("vec_id", rnd(F.col("pca")[0]).alias("comp1"), rnd(F.col("pca")[1]).alias("comp2"))
