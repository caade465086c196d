"""Inter-annotator agreement over long (unit, annotator, value) ratings.

Krippendorff's alpha is computed from value counts only, never from rating
pairs: with n_uc = ratings of value c in unit u and m_u = ratings in u
(units with m_u >= 2 are pairable),

    observed  sum_u 1/(m_u-1) sum_{c,k} n_uc n_uk d(c,k)
    expected  1/(n-1) sum_{c,k} n_c n_k d(c,k),      alpha = 1 - observed/expected

and for both distances the double sums collapse to per-unit moments:
nominal  sum_{c,k} n_c n_k [c != k] = m^2 - sum_c n_c^2,
interval sum_{c,k} n_c n_k (c-k)^2 = 2 (m sum_c n_c c^2 - (sum_c n_c c)^2).
So alpha is two grouped aggregations with partial aggregation; no self-join,
no cross product, and a hot unit costs one counter per value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratings_as_int(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Annotation values as integers (``try_cast``: unparsable -> null, then dropped)."""
    return (df.withColumn(value_col, F.expr(f"try_cast(`{value_col}` AS INT)"))
            .where(F.col(value_col).isNotNull()))


def wide_to_long(sheet: DataFrame, id_col: str, annotators: list[str], tab: str | None = None) -> DataFrame:
    """One column per annotator -> long (tab, item_id, annotator, value); missing ratings dropped."""
    cols = [F.struct(F.lit(a).alias("annotator"), F.col(f"`{a}`").cast("string").alias("value")) for a in annotators]
    out = sheet.select(F.lit(tab).alias("tab"), F.col(id_col).alias("item_id"), F.inline(F.array(*cols)))
    return ratings_as_int(out.where(F.col("value").isNotNull()))


def _pair_sum(m, q, s1, s2, level):
    if level == "nominal":
        return m * m - q
    if level == "interval":
        return F.lit(2.0) * (m * s2 - s1 * s1)
    raise ValueError("level must be 'nominal' or 'interval'")


def alpha(ratings: DataFrame, unit_cols: list[str], value_col: str = "value", level: str = "nominal",
          group_cols: list[str] | None = None, value_domain: tuple | None = None) -> DataFrame:
    """Krippendorff's alpha per group (one row per group; null when undefined).

    ``value_domain`` (interval data) lists the allowed values; a rating outside
    it makes the result null for its group (flag ``out_of_domain``).
    """
    g = list(group_cols or [])
    whole = not g
    r = ratings.where(F.col(value_col).isNotNull())
    if whole:  # one group: a constant key keeps every step a keyed aggregation / join
        g = ["_all"]
        r = r.withColumn("_all", F.lit(0))
    v = F.col(value_col).cast("double")
    counts = r.groupBy(*g, *unit_cols, v.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy(*g, *unit_cols)  # rows per unit = distinct values in it (bounded)
    counts = counts.withColumn("m", F.sum("n").over(w)).where(F.col("m") >= 2)
    units = counts.groupBy(*g, *unit_cols).agg(
        F.first("m").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q"),
        F.sum(F.col("n") * F.col("v")).alias("s1"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("s2"))
    obs = units.groupBy(*g).agg(
        F.sum(_pair_sum(F.col("m"), F.col("q"), F.col("s1"), F.col("s2"), level) / (F.col("m") - 1)).alias("do"),
        F.sum("m").alias("n_pairable"))
    vals = counts.groupBy(*g, "v").agg(F.sum("n").alias("nc"))
    checks = [F.sum(F.col("nc") * F.col("nc")).alias("q"), F.sum(F.col("nc") * F.col("v")).alias("s1"),
              F.sum(F.col("nc") * F.col("v") * F.col("v")).alias("s2"), F.sum("nc").alias("n")]
    if value_domain is not None:
        dom = F.array(*[F.lit(float(x)) for x in value_domain])
        checks.append(F.max(F.when(~F.array_contains(dom, F.col("v")), 1).otherwise(0)).alias("out_of_domain"))
    exp = vals.groupBy(*g).agg(*checks)
    exp = exp.withColumn("de", _pair_sum(F.col("n"), F.col("q"), F.col("s1"), F.col("s2"), level))
    # both sides hold one row a group: stacked and folded, which needs no join (and no product without groups)
    both = obs.unionByName(exp.drop("q", "s1", "s2"), allowMissingColumns=True)
    j = both.groupBy(*g).agg(*[F.max(c).alias(c) for c in both.columns if c not in g])
    a = F.when(F.col("de") == 0, F.lit(None).cast("double")).otherwise(
        F.lit(1.0) - (F.col("n") - 1) * F.col("do") / F.col("de"))
    if value_domain is not None:
        a = F.when(F.col("out_of_domain") == 1, F.lit(None).cast("double")).otherwise(a)
    out = j.select(*g, a.alias("alpha"), F.col("n_pairable").cast("long").alias("n_pairable"))
    return out.drop("_all") if whole else out


def observed_agreement(ratings: DataFrame, unit_cols: list[str], annotators: list[str],
                       annotator_col: str = "annotator", value_col: str = "value") -> DataFrame:
    """Per annotator pair: share of units rated by both where both agree; plus the mean.

    Ratings are pivoted to one column per annotator (the annotator list is a
    parameter), then every pair is one conditional sum: a single aggregation.
    """
    wide = (ratings.groupBy(*unit_cols).pivot(annotator_col, annotators)
            .agg(F.first(value_col)))
    aggs = []
    pairs = [(a, b) for i, a in enumerate(annotators) for b in annotators[i + 1:]]
    for a, b in pairs:
        both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        aggs += [F.sum(F.when(both & (F.col(f"`{a}`") == F.col(f"`{b}`")), 1).otherwise(0)).alias(f"eq_{a}_{b}"),
                 F.sum(F.when(both, 1).otherwise(0)).alias(f"n_{a}_{b}")]
    row = wide.agg(*aggs)
    cols = [F.struct(F.lit(f"{a}|{b}").alias("pair"),
                     F.when(F.col(f"n_{a}_{b}") == 0, F.lit(None).cast("double"))
                     .otherwise(F.col(f"eq_{a}_{b}") / F.col(f"n_{a}_{b}")).alias("ao"))
            for a, b in pairs]
    per_pair = row.select(F.inline(F.array(*cols)))
    mean = per_pair.agg(F.lit("mean").alias("pair"), F.avg("ao").alias("ao"))
    return per_pair.unionByName(mean)


def agreement_report(ratings: DataFrame, unit_cols: list[str], annotators: list[str], value_domain: tuple,
                     annotator_col: str = "annotator", value_col: str = "value") -> DataFrame:
    """(measure, value): nominal alpha, interval alpha and the mean observed agreement."""
    def row(name, df, col):
        return df.select(F.lit(name).alias("measure"), F.col(col).alias("value"))

    observed = observed_agreement(ratings, unit_cols, annotators, annotator_col, value_col)
    return (row("nominal", alpha(ratings, unit_cols, value_col), "alpha")
            .unionByName(row("interval", alpha(ratings, unit_cols, value_col, "interval", value_domain=value_domain), "alpha"))
            .unionByName(row("observed", observed.where(F.col("pair") == "mean"), "ao")))


def item_positions(ratings: DataFrame, tab_col: str, annotator_col: str, order_col: str) -> DataFrame:
    """Reference-compatible item text 't_{tab}_{pos}': position among the rows one
    annotator rated in a sheet (kept as an option; the default key is the row id).
    Positions come from the range-partitioned index, not a per-sheet window."""
    from colloquy.operators.positions import positional_index

    return positional_index(ratings, [tab_col, annotator_col], [order_col], "pos").withColumn(
        "item_text", F.concat_ws("_", F.lit("t"), F.col(tab_col).cast("string"), F.col("pos").cast("string")))
