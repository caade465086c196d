"""Agreement queries over rule-made annotators of labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query, rnd
from colloquy.operators import agreement as A
from colloquy.sources.tables import ratings

RATINGS = """r AS (
  SELECT d.source AS tab, l.doc_id AS item_id, x.annotator, x.value FROM labels l JOIN documents d ON d.doc_id = l.doc_id,
  LATERAL (VALUES ('q', 1 + 4 * l.quality + 2 * l.toxic),
                  ('s', 1 + 4 * l.quality + 2 * CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END),
                  ('l', CASE WHEN l.toxic = 1 THEN NULL WHEN d.lang = 'en' THEN 5 ELSE 1 + 4 * l.quality END))
          x(annotator, value)
  WHERE x.value IS NOT NULL)"""


def _alpha_sql(level, annotators):
    ann = ", ".join(f"'{a}'" for a in annotators)
    pair = "(m * m - q)" if level == "nominal" else "2.0 * (m * s2 - s1 * s1)"
    epair = "(n * n - q)" if level == "nominal" else "2.0 * (n * s2 - s1 * s1)"
    return f"""WITH {RATINGS},
c AS (SELECT tab, item_id, value::DOUBLE AS v, count(*)::DOUBLE AS n FROM r WHERE annotator IN ({ann})
      GROUP BY tab, item_id, value),
cm AS (SELECT *, sum(n) OVER (PARTITION BY tab, item_id) AS m FROM c),
cp AS (SELECT * FROM cm WHERE m >= 2),
u AS (SELECT tab, item_id, max(m) AS m, sum(n * n) AS q, sum(n * v) AS s1, sum(n * v * v) AS s2
      FROM cp GROUP BY tab, item_id),
o AS (SELECT sum({pair} / (m - 1)) AS do_, sum(m) AS np FROM u),
vv AS (SELECT v, sum(n) AS nc FROM cp GROUP BY v),
e AS (SELECT sum(nc * nc) AS q, sum(nc * v) AS s1, sum(nc * v * v) AS s2, sum(nc) AS n FROM vv),
e2 AS (SELECT {epair} AS de, n FROM e)
SELECT round(CASE WHEN de = 0 THEN NULL ELSE 1.0 - (n - 1) * do_ / de END, 6) AS alpha, np::BIGINT AS n_pairable
FROM o, e2"""


@query("alpha_nominal", _alpha_sql("nominal", ["q", "l"]))
def alpha_nominal(spark, sf_dir):
    """Krippendorff's alpha, nominal, two annotators; unit = (sheet, item)."""
    r = ratings(spark, sf_dir).where(F.col("annotator").isin("q", "l"))
    a = A.alpha(r, ["tab", "item_id"], "value", "nominal")
    return a.select(rnd("alpha").alias("alpha"), "n_pairable")


@query("alpha_interval", _alpha_sql("interval", ["q", "s", "l"]))
def alpha_interval(spark, sf_dir):
    """Krippendorff's alpha, interval, three annotators, value domain 1..9."""
    a = A.alpha(ratings(spark, sf_dir), ["tab", "item_id"], "value", "interval", value_domain=tuple(range(1, 10)))
    return a.select(rnd("alpha").alias("alpha"), "n_pairable")


@query("observed_agreement", f"""WITH {RATINGS},
w AS (SELECT tab, item_id, max(value) FILTER (WHERE annotator = 'q') AS q, max(value) FILTER (WHERE annotator = 's') AS s,
             max(value) FILTER (WHERE annotator = 'l') AS l FROM r GROUP BY tab, item_id),
p AS (SELECT 'q|s' AS pair, avg(CASE WHEN q = s THEN 1.0 ELSE 0.0 END) FILTER (WHERE q IS NOT NULL AND s IS NOT NULL) AS ao FROM w
      UNION ALL SELECT 'q|l', avg(CASE WHEN q = l THEN 1.0 ELSE 0.0 END) FILTER (WHERE q IS NOT NULL AND l IS NOT NULL) FROM w
      UNION ALL SELECT 's|l', avg(CASE WHEN s = l THEN 1.0 ELSE 0.0 END) FILTER (WHERE s IS NOT NULL AND l IS NOT NULL) FROM w)
SELECT pair, round(ao, 6) AS ao FROM p UNION ALL SELECT 'mean', round(avg(ao), 6) FROM p""")
def observed_agreement(spark, sf_dir):
    """Share of equal ratings per annotator pair (units rated by both), and the mean."""
    o = A.observed_agreement(ratings(spark, sf_dir), ["tab", "item_id"], ["q", "s", "l"])
    return o.select("pair", rnd("ao").alias("ao"))


@query("item_positions", f"""WITH {RATINGS}
SELECT tab, annotator, item_id, (row_number() OVER (PARTITION BY tab, annotator ORDER BY item_id) - 1)::INTEGER AS pos,
       't_' || tab || '_' || ((row_number() OVER (PARTITION BY tab, annotator ORDER BY item_id) - 1)::VARCHAR) AS item_text
FROM r""")
def item_positions(spark, sf_dir):
    """Position of each rated item within (sheet, annotator) and its 't_{tab}_{pos}' text."""
    p = A.item_positions(ratings(spark, sf_dir), "tab", "annotator", "item_id")
    return p.select("tab", "annotator", "item_id", F.col("pos").cast("int").alias("pos"), "item_text")
