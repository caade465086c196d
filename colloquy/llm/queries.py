"""One query per operator over the driver tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    arc_warc, config_packing, decontamination, filter_audit, hash_tree, host_quality, jaccard_join, license_scan, minmax_dedup, token_store, toxicity,
    turn_repair, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "item_ids")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *host_quality.MEASURES, "base_failed", "kept")


def op4_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = arc_warc.to_warc(arc_warc.write_arc(_table(spark, sf_dir, "pages")))
    records = arc_warc.with_referred_pages(arc_warc.stored(arc_warc.read_warc(archives), "warc-records"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return token_store.read(manifest, with_ids=False)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"))


def op9_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shards(_table(spark, sf_dir, "documents"), 40)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = turn_repair.damaged(_table(spark, sf_dir, "conversations"))
    return turn_repair.repair(hurt, present="present").withColumnRenamed("conv", "conv_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_decontamination, op3_host_quality, op4_arc_warc, op5_license_scan, op6_url_filter, op7_token_store,
    op8_jaccard_join, op9_config_packing, op10_hash_tree, op11_turn_repair,
    op12_filter_audit, op13_minmax_dedup)}

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op3_host_quality": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
                  {_WORDS.format(text="text")} AS w FROM documents),
l AS (SELECT rid, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ln FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d) x),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM twice) x GROUP BY rid),
m AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN l ON l.rid = d.rid LEFT JOIN rep ON rep.rid = d.rid),
b AS (SELECT *, n_words < {host_quality.MIN_WORDS}
                OR n_repeat_words * 100 > n_words * {host_quality.MAX_REPEAT_PERCENT} AS base_failed FROM m),
t AS (SELECT *, base_failed OR n_symbols * 2 > n_words OR n_dup_lines > 30 OR n_dup_lines * 20 > n_words
                OR word_chars > n_words * 15 AS failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM t GROUP BY source),
p AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM h),
s AS (SELECT mu, CASE WHEN v = 0 THEN {host_quality.PRIOR_STRENGTH[1]}::DOUBLE
                      ELSE least({host_quality.PRIOR_STRENGTH[1]}::DOUBLE,
                                 greatest({host_quality.PRIOR_STRENGTH[0]}::DOUBLE, mu * (1 - mu) / v - 1)) END AS s FROM p),
bad AS (SELECT source, (f + mu * s) / (n + s) > least({host_quality.MAX_RATE}::DOUBLE,
                   mu + {host_quality.DEVIATIONS}::DOUBLE * sqrt(mu * (1 - mu) / (s + 1))) AS rejected FROM h CROSS JOIN s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (failed OR rejected) AS kept
FROM t JOIN bad ON bad.source IS NOT DISTINCT FROM t.source""",
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="text"))} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
num AS (SELECT s, row_number() OVER () AS i FROM (SELECT DISTINCT s FROM sh) x),
sets AS (SELECT doc_id, list_sort(list(i)) AS ids FROM sh JOIN num USING (s) GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS c, ids, len(ids) AS n FROM sets GROUP BY ids),
inv AS (SELECT c, n, unnest(ids) AS i FROM classes),
links AS (SELECT a.c AS a, b.c AS b FROM inv a JOIN inv b ON a.i = b.i AND a.c <> b.c AND a.n * 10 >= b.n * 8
               AND b.n * 10 >= a.n * 8
          GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c)
SELECT w.doc_id, coalesce(len(sets.ids), 0)::BIGINT AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN sets ON sets.doc_id = w.doc_id LEFT JOIN classes ON classes.ids = sets.ids LEFT JOIN comp ON comp.c = classes.c""",
    "op13_minmax_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="text"))} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
num AS (SELECT s, row_number() OVER () AS i FROM (SELECT DISTINCT s FROM sh) x),
sets AS (SELECT doc_id, list_sort(list(i)) AS ids FROM sh JOIN num USING (s) GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS c, ids, len(ids) AS n FROM sets GROUP BY ids),
inv AS (SELECT c, n, unnest(ids) AS i FROM classes),
links AS (SELECT a.c AS a, b.c AS b FROM inv a JOIN inv b ON a.i = b.i AND a.c <> b.c AND a.n * 100 >= b.n * 85
               AND b.n * 100 >= a.n * 85
          GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c)
SELECT w.doc_id, coalesce(len(sets.ids), 0)::BIGINT AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id,
       coalesce(comp.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sets ON sets.doc_id = w.doc_id LEFT JOIN classes ON classes.ids = sets.ids LEFT JOIN comp ON comp.c = classes.c""",
    "op12_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w FROM documents),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
             [len(w) < {filter_audit.MIN_WORDS}, 100 * len(list_distinct(w)) < {filter_audit.DISTINCT_PERCENT} * len(w),
              100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filter_audit.CAPITALS_PERCENT} * length(text),
              regexp_matches(text, '[#$%&*|]'),
              coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false)] AS fails
      FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, step, ord[step] AS x, ord[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
t AS (SELECT part, ord, step, x, n, good, toxic, fails[x] AS bad, len([y FOR y IN before IF fails[y]]) > 0 AS gone,
             len([y FOR y IN fails IF y]) AS n_bad FROM g, s),
r AS (SELECT part, ord, step, x, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN bad AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN bad AND n_bad = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN bad AND NOT gone THEN n * good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN bad AND NOT gone THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM t GROUP BY part, ord, step, x)
SELECT part, array_to_string([substr('ABCDE', y, 1) FOR y IN ord], '') AS filter_order, step::INTEGER AS step, kept, removed,
       redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r""",
    "op4_arc_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM d""",
}
