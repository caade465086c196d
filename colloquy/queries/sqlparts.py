"""Reusable DuckDB SQL fragments for the oracle side.

They are generated from the same fixed values as the Spark code (keyword
lists, scorer constants), but compute by a different route: tokens are
unnested and joined to a keyword table, then grouped -- where Spark scores
inside the row.
"""

from __future__ import annotations

from colloquy.sources.taxonomy import Taxonomy

TOKENS = r"string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}]+')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def keyword_rows(taxonomy: Taxonomy, with_sublabels: bool = True) -> str:
    rows = []
    for pos, lab in enumerate(taxonomy.labels):
        for w in taxonomy.keywords_of(lab, with_sublabels):
            rows.append(f"({q(lab)}, {pos}, {q(w)})")
    return ", ".join(rows)


def label_rows(labels) -> str:
    return ", ".join(f"({q(lab)}, {i})" for i, lab in enumerate(labels))


def keyword_scores(source: str, id_col: str, text_col: str, taxonomy: Taxonomy,
                   gain: float = 60.0, offset: float = 2.0, prefix: str = "k") -> str:
    """CTEs ``{prefix}_sc(id, label, pos, score)`` and ``{prefix}_top(id, label, score)``."""
    tok = TOKENS.format(text=text_col)
    return f"""
{prefix}_kw(label, pos, tok) AS (VALUES {keyword_rows(taxonomy)}),
{prefix}_lab(label, pos) AS (VALUES {label_rows(taxonomy.labels)}),
{prefix}_toks AS (SELECT {id_col} AS id, unnest({tok}) AS tok FROM {source}),
{prefix}_n AS (SELECT s.{id_col} AS id, count(t.tok) FILTER (WHERE t.tok <> '') AS n
               FROM {source} s LEFT JOIN {prefix}_toks t ON t.id = s.{id_col} GROUP BY s.{id_col}),
{prefix}_hits AS (SELECT t.id, k.label, count(*) AS h FROM {prefix}_toks t JOIN {prefix}_kw k ON t.tok = k.tok
                  GROUP BY t.id, k.label),
{prefix}_sc AS (SELECT n.id, l.label, l.pos,
        1.0::DOUBLE / (1.0::DOUBLE + exp({offset}::DOUBLE - {gain}::DOUBLE * coalesce(h.h, 0)::DOUBLE
                                         / greatest(n.n, 1)::DOUBLE)) AS score
    FROM {prefix}_n n CROSS JOIN {prefix}_lab l
    LEFT JOIN {prefix}_hits h ON h.id = n.id AND h.label = l.label),
{prefix}_top AS (SELECT id, label, score FROM {prefix}_sc
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos DESC) = 1)"""


def sublist_rows(taxonomy: Taxonomy) -> tuple[str, str]:
    kw, lab = [], []
    for parent, subs in taxonomy.sublists.items():
        for pos, s in enumerate(subs):
            lab.append(f"({q(parent)}, {q(s)}, {pos})")
            for w in dict.fromkeys(s.lower().split()):
                kw.append(f"({q(parent)}, {q(s)}, {q(w)})")
    return ", ".join(kw), ", ".join(lab)


def sublist_scores(prefix: str, gain: float = 60.0, offset: float = 2.0, taxonomy: Taxonomy | None = None) -> str:
    """CTE ``{prefix}_stop(id, label, score)``: best label of the winner's sublist.

    Needs the CTEs of :func:`keyword_scores` with the same prefix.
    """
    kw, lab = sublist_rows(taxonomy)
    if not lab:
        return f"{prefix}_stop AS (SELECT NULL::BIGINT AS id, NULL::VARCHAR AS label, NULL::DOUBLE AS score WHERE false)"
    return f"""
{prefix}_skw(parent, label, tok) AS (VALUES {kw}),
{prefix}_slab(parent, label, pos) AS (VALUES {lab}),
{prefix}_shits AS (SELECT t.id, k.parent, k.label, count(*) AS h FROM {prefix}_toks t
                   JOIN {prefix}_skw k ON t.tok = k.tok GROUP BY t.id, k.parent, k.label),
{prefix}_ssc AS (SELECT w.id, s.label, s.pos,
        1.0::DOUBLE / (1.0::DOUBLE + exp({offset}::DOUBLE - {gain}::DOUBLE * coalesce(h.h, 0)::DOUBLE
                                         / greatest(n.n, 1)::DOUBLE)) AS score
    FROM {prefix}_top w JOIN {prefix}_slab s ON s.parent = w.label JOIN {prefix}_n n ON n.id = w.id
    LEFT JOIN {prefix}_shits h ON h.id = w.id AND h.parent = s.parent AND h.label = s.label),
{prefix}_stop AS (SELECT id, label, score FROM {prefix}_ssc
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos DESC) = 1)"""


def cascade_sql(source: str, id_col: str, text_col: str, levels, flat=(), keep: str = "", pre: str = "") -> str:
    """Full wide annotation: per level topic/subtopic (+ scores), per flat list topic (+ score)."""
    ctes, cols, joins = [], [], []
    for i, tax in enumerate(levels, start=1):
        p = f"l{i}"
        ctes.append(keyword_scores(source, id_col, text_col, tax, prefix=p))
        ctes.append(sublist_scores(p, taxonomy=tax))
        joins.append(f"LEFT JOIN {p}_top ON {p}_top.id = s.{id_col} LEFT JOIN {p}_stop ON {p}_stop.id = s.{id_col}")
        cols += [f"{p}_top.label AS TOPIC_IS_{i}", f"round({p}_top.score, 6) AS TOPIC_IS_SCORE_{i}",
                 f"coalesce({p}_stop.label, {p}_top.label) AS SUBTOPIC_IS_{i}",
                 f"round(coalesce({p}_stop.score, 0.0), 6) AS SUBTOPIC_IS_SCORE_{i}"]
    for tax in flat:
        p = f"f_{tax.name}"
        base = f"TOPIC_{tax.name.upper()}_IS"
        ctes.append(keyword_scores(source, id_col, text_col, tax, prefix=p))
        joins.append(f"LEFT JOIN {p}_top ON {p}_top.id = s.{id_col}")
        cols += [f"{p}_top.label AS {base}", f"round({p}_top.score, 6) AS {base}_SCORE"]
    return ("WITH " + (pre + "," if pre else "") + ",".join(ctes) + f"\nSELECT {keep}s.{id_col}, " + ", ".join(cols)
            + f" FROM {source} s " + " ".join(joins))


def unit_vectors_sql(prefix: str, source: str, key: str, text: str) -> str:
    """CTE ``{prefix}_v(key, v)``: hashed token counts of unit length in 64 buckets, as a list."""
    p = prefix
    return f"""{p}_t AS (SELECT {key}, unnest({TOKENS.format(text=text)}) AS tok FROM {source}),
{p}_b AS (SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM {p}_t WHERE tok <> '' GROUP BY ALL),
{p}_n AS (SELECT {key}, sqrt(sum(c * c)) AS nn FROM {p}_b GROUP BY {key}),
{p}_v AS MATERIALIZED (SELECT s.{key}, list(coalesce(b.c / n.nn, 0.0) ORDER BY d.dim) AS v FROM (SELECT DISTINCT {key} FROM {source}) s
    CROSS JOIN range(64) d(dim) LEFT JOIN {p}_b b ON b.{key} = s.{key} AND b.b = d.dim LEFT JOIN {p}_n n ON n.{key} = s.{key} GROUP BY s.{key})"""


def bag_vectors_sql(source: str, id_col: str, text_col: str, dim: int, reduced: int, prefix: str = "bag") -> str:
    """Hashed, normalised and sign-projected vectors: ``{prefix}_p(id, dim, x)`` and ``{prefix}_v(id, vec)``."""
    p = prefix
    return f"""
{p}_t AS (SELECT {id_col} AS id, unnest({TOKENS.format(text=text_col)}) AS tok FROM {source}),
{p}_b AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS c FROM {p}_t
          WHERE tok <> '' GROUP BY ALL),
{p}_n AS (SELECT id, sqrt(sum(c * c)) AS nn FROM {p}_b GROUP BY id),
{p}_r AS (SELECT b, dim, CASE WHEN substr(md5(b::VARCHAR || '_' || dim::VARCHAR), 1, 1) < '8' THEN 1.0 ELSE -1.0 END
                 / sqrt({reduced}::DOUBLE) AS r FROM range(0, {dim}) x(b), range(0, {reduced}) y(dim)),
{p}_h AS (SELECT h.id, r.dim, sum(h.c / n.nn * r.r) AS x FROM {p}_b h JOIN {p}_n n ON n.id = h.id
          JOIN {p}_r r ON r.b = h.b GROUP BY h.id, r.dim),
{p}_p AS MATERIALIZED (SELECT s.{id_col} AS id, d.dim, coalesce(h.x, 0.0) AS x FROM {source} s
          CROSS JOIN range(0, {reduced}) d(dim) LEFT JOIN {p}_h h ON h.id = s.{id_col} AND h.dim = d.dim),
{p}_v AS MATERIALIZED (SELECT id, list(x ORDER BY dim) AS vec FROM {p}_p GROUP BY id)"""


def lloyd_sql(prefix: str, points: str, ks: str, rounds: int) -> str:
    """K-means from the first different vectors, unrolled: CTE ``{prefix}_cl(g, k, id, c)``.

    ``points`` is (g, id, vec, own): only own rows seed, the lowest ids first; ``ks`` is (g, k).
    ``rounds`` must be at least what the data needs until no assignment changes.
    """
    p = prefix
    ctes = [f"""
{p}_v AS (SELECT g, vec, min(id) AS id FROM {points} WHERE own GROUP BY g, vec),
{p}_f AS (SELECT g, vec, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS c FROM {p}_v QUALIFY c < 10),
{p}_c0 AS MATERIALIZED (SELECT f.g, ks.k, f.c, f.vec AS center FROM {p}_f f JOIN {ks} ks ON ks.g = f.g WHERE f.c < ks.k)"""]
    for i in range(rounds + 1):
        ctes.append(f"""
{p}_d{i} AS (SELECT p.g, p.id, c.k, c.c, list_distance(p.vec, c.center) ** 2 AS d2
             FROM {points} p JOIN {p}_c{i} c ON c.g = p.g),
{p}_l{i} AS (SELECT *, min(d2) OVER (PARTITION BY g, k, id) AS least FROM {p}_d{i}),
{p}_a{i} AS MATERIALIZED (SELECT g, k, id, min(c) AS c FROM {p}_l{i} WHERE d2 <= least + 1e-9 * (1.0 + least)
                          GROUP BY g, k, id)""")
        if i < rounds:
            ctes.append(f"""
{p}_x{i} AS (SELECT a.g, a.k, a.c, unnest(range(1, len(p.vec) + 1)) AS dim, unnest(p.vec) AS x
             FROM {p}_a{i} a JOIN {points} p ON p.g = a.g AND p.id = a.id),
{p}_y{i} AS (SELECT g, k, c, dim, avg(x) AS x FROM {p}_x{i} GROUP BY g, k, c, dim),
{p}_m{i} AS (SELECT g, k, c, list(x ORDER BY dim) AS center FROM {p}_y{i} GROUP BY g, k, c),
{p}_c{i + 1} AS MATERIALIZED (SELECT c.g, c.k, c.c, coalesce(m.center, c.center) AS center FROM {p}_c{i} c
                              LEFT JOIN {p}_m{i} m ON m.g = c.g AND m.k = c.k AND m.c = c.c)""")
    ctes.append(f"\n{p}_cl AS (SELECT * FROM {p}_a{rounds})")
    return ",".join(ctes)


def silhouette_sql(prefix: str, clusters: str, pairs: str) -> str:
    """Samples ``{prefix}_s(g, k, id, s)`` of ``clusters`` (g, k, id, c) from ``pairs`` (g, i, j, d)."""
    p = prefix
    return f"""
{p}_m AS (SELECT a.g, a.k, a.id, a.c AS own, b.c, sum(d.d) AS s, count(*) AS n FROM {clusters} a
          JOIN {pairs} d ON d.g = a.g AND d.i = a.id JOIN {clusters} b ON b.g = a.g AND b.k = a.k AND b.id = d.j
          GROUP BY a.g, a.k, a.id, a.c, b.c),
{p}_ab AS (SELECT g, k, id, max(n) FILTER (WHERE c = own) AS size,
                  max(CASE WHEN n <= 1 THEN 0.0 ELSE s / (n - 1) END) FILTER (WHERE c = own) AS a,
                  min(s / n) FILTER (WHERE c <> own) AS b FROM {p}_m GROUP BY g, k, id),
{p}_s AS (SELECT g, k, id, CASE WHEN b IS NULL THEN NULL WHEN size <= 1 OR greatest(a, b) = 0 THEN 0.0
                                ELSE (b - a) / greatest(a, b) END AS s FROM {p}_ab)"""


def typical_answers_sql(bag: str, group: str, id_col: str, answer: str, rounds: int) -> str:
    """CTE ``typical(g, cluster, id, answer)``: 64 buckets, two dimensions, best k, scaled clusters, median medoid."""
    return f"""
src AS MATERIALIZED (SELECT {group} AS g, {id_col} AS id, {answer} AS answer, count(*) OVER (PARTITION BY {group}) AS n
                     FROM {bag}),
few AS (SELECT g, 0 AS cluster, min(id) AS id, min(answer) AS answer FROM src WHERE n <= 1 GROUP BY g),
many AS MATERIALIZED (SELECT * FROM src WHERE n > 1),
{bag_vectors_sql("many", "id", "answer", 64, 2)},
pts AS MATERIALIZED (SELECT s.g, s.id, v.vec, true AS own FROM many s JOIN bag_v v ON v.id = s.id
    UNION ALL SELECT g, -1, list(x ORDER BY dim), false FROM (
      SELECT s.g, v.dim, avg(v.x) AS x FROM many s JOIN bag_p v ON v.id = s.id GROUP BY s.g, v.dim) m GROUP BY g),
pairs AS MATERIALIZED (SELECT a.g, a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS d FROM pts a JOIN pts b ON b.g = a.g),
n AS (SELECT g, count(*) AS n FROM pts GROUP BY g),
ks AS (SELECT g, k FROM n, range(2, 11) r(k) WHERE n >= 3 AND k <= n - 1),
{lloyd_sql("km", "pts", "ks", rounds)},
{silhouette_sql("se", "km_cl", "pairs")},
mean AS (SELECT g, k, avg(s) AS s FROM se_s GROUP BY g, k),
bestk AS MATERIALIZED (SELECT g, k FROM mean WHERE s IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(s, 9) DESC, k) = 1),
dims AS (SELECT g, id, own, unnest([1, 2]) AS dim, unnest(vec) AS x FROM pts),
stats AS (SELECT g, dim, avg(x) AS mu, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS sd
          FROM dims GROUP BY g, dim),
scaled AS MATERIALIZED (SELECT d.g, d.id, list((d.x - t.mu) / t.sd ORDER BY d.dim) AS vec, d.own FROM dims d
          JOIN stats t ON t.g = d.g AND t.dim = d.dim GROUP BY d.g, d.id, d.own),
{lloyd_sql("fx", "scaled", "bestk", rounds)},
kept AS (SELECT c.g, c.c AS cluster, c.id, s.vec FROM fx_cl c JOIN scaled s ON s.g = c.g AND s.id = c.id WHERE s.own
         UNION ALL SELECT g, 0, id, vec FROM pts WHERE own AND g NOT IN (SELECT g FROM bestk)),
mids AS (SELECT g, cluster, [median(vec[1]), median(vec[2])] AS mid FROM kept GROUP BY g, cluster),
medoids AS (SELECT k.g, k.cluster, k.id FROM kept k JOIN mids m ON m.g = k.g AND m.cluster = k.cluster
            QUALIFY row_number() OVER (PARTITION BY k.g, k.cluster
                                       ORDER BY round(list_distance(k.vec, m.mid) ** 2, 9), k.id) = 1),
typical AS (SELECT m.g, m.cluster, m.id, s.answer FROM medoids m JOIN src s ON s.g = m.g AND s.id = m.id
            UNION ALL SELECT * FROM few)"""
