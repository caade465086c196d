"""Label cleaning, remapping, thresholding and integer encoding.

All rules are column expressions (map-only, no shuffle) except the code
table, which is a distinct over the (small) label set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import capitalize_first
from colloquy.operators.joins import join_small
from colloquy.operators.positions import positional_index
from colloquy.sources.taxonomy import LEVEL_RENAME

OTHER = "Other"

# ---------------------------------------------------------------------------
# The ordered replace rules applied to label text.
# ---------------------------------------------------------------------------
PREDICTED_RULES_BEFORE_SCORE = [
    ("Nan", "Other"),
    ("Teacher", "Education/academic"),
    ("Climate conditions", "Weather"),
    ("Newspaper", "News"),
]
MERGE_RULES = [
    ("Art", "Other"),
    ("Politics", "Other"),
    ("Videogames", "Other"),
    ("Science", "Other"),
    ("Education/academic", "Other"),
    ("News", "Other"),
]
PREDICTION_CASE_RULES = [("media", "Media")]
LOW_SCORE = 0.1
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fill_missing(col, value: str = OTHER) -> Column:
    return F.coalesce(_c(col), F.lit(value))


def replace_chain(col, rules, mode: str = "label") -> Column:
    """Apply ordered (old, new) rules.

    ``mode="substring"`` replaces every occurrence of ``old`` inside the text
    (so 'Newspaper' can become 'Otherpaper'); ``mode="label"`` (default)
    rewrites only whole labels, following the chain to its end.
    """
    c = _c(col)
    if mode == "substring":
        for old, new in rules:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c
    if mode != "label":
        raise ValueError("mode must be 'label' or 'substring'")
    net = {}
    for old, _ in rules:
        cur = old
        for o, n in rules:
            if cur == o:
                cur = n
        net[old] = cur
    # rules later in the list can also rewrite a label produced earlier
    if not net:
        return c
    m = F.create_map(*[x for k, v in net.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), c)


def low_score_other(label, score, limit: float = LOW_SCORE, other: str = OTHER) -> Column:
    """Label becomes ``other`` when its score is below ``limit`` (strict)."""
    return F.when(_c(score) < limit, F.lit(other)).otherwise(_c(label))


def threshold_relabel(label, score, threshold: float, other: str = OTHER) -> Column:
    """Keep the label only when score > threshold (strict); a NaN score passes no threshold."""
    return F.when(nan_to_null(score) > threshold, _c(label)).otherwise(F.lit(other))


def nan_to_null(col) -> Column:
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def best_of_levels(df: DataFrame, threshold: float = 0.6, prefix: str = "best_",
                   levels=("first", "second", "third"), excluded_third: str = "Photography",
                   other: str = OTHER) -> Column:
    """Arg-max over the level scores (ties -> earliest level), kept when >= threshold.

    A level-3 winner equal to ``excluded_third`` becomes ``other``. NaN scores
    count as missing.
    """
    scores = [nan_to_null(f"{prefix}{lv}_level_score") for lv in levels]
    topics = [F.col(f"{prefix}{lv}_level_topic") for lv in levels]
    m = F.greatest(*scores)
    out = F.lit(other)
    # build the CASE from the last level backwards so the first level wins ties
    for i in reversed(range(len(levels))):
        pick = topics[i]
        if i == len(levels) - 1 and excluded_third is not None:
            pick = F.when(topics[i] == excluded_third, F.lit(other)).otherwise(topics[i])
        out = F.when((scores[i] == m) & (m >= threshold), pick).otherwise(out)
    return out


def level_rename(col, mapping: dict = LEVEL_RENAME) -> Column:
    """Rename level labels (teacher -> education, ...); others keep their name."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    c = _c(col)
    return F.coalesce(F.try_element_at(m, c), c)


def clean_predicted(df: DataFrame, label: str = "topic", score: str = "topic_score",
                    mode: str = "substring") -> DataFrame:
    """Predicted-label cleaning: capitalize, fill, rules, low score -> Other, merges."""
    c = capitalize_first(label)
    c = fill_missing(c)
    c = replace_chain(c, PREDICTED_RULES_BEFORE_SCORE, mode)
    c = low_score_other(c, nan_to_null(score))
    c = replace_chain(c, MERGE_RULES, mode)
    return df.withColumn(label, c)


def clean_tagged(df: DataFrame, label: str = "topic", mode: str = "substring") -> DataFrame:
    """Human-tag cleaning: capitalize, fill, merges."""
    c = replace_chain(fill_missing(capitalize_first(label)), MERGE_RULES, mode)
    return df.withColumn(label, c)


def label_codes(df: DataFrame, label: str = "topic") -> DataFrame:
    """(label, code): distinct labels in sorted order, code 0..n-1 (ranked by range partitions)."""
    labels = df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    coded = positional_index(labels.withColumn("_all", F.lit(0)), ["_all"], ["label"], "code")
    return coded.select("label", F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, codes: DataFrame, label: str = "topic", out: str = "topic_encoded") -> DataFrame:
    """Attach the code of each label; unknown labels get a null code."""
    c = codes.select(F.col("label").alias(label), F.col("code").alias(out))
    return join_small(df, c, on=[label], how="left")
