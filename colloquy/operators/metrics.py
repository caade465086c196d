"""Classification metrics over (truth, prediction) rows, grouped and exact.

Everything is one aggregation: each row contributes a "truth" tick to its
true label and a "predicted" tick to its predicted label, so the per-label
counts (support, predicted, true positives) come out of a single partial
aggregate and shuffle only #groups x #labels rows. Division by zero yields 0
(``zero_division=0``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div0(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion(df: DataFrame, truth: str, pred: str, group_cols=()) -> DataFrame:
    """Counts per (group, true label, predicted label)."""
    return (df.groupBy(*group_cols, F.col(truth).alias("true_label"), F.col(pred).alias("pred_label"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_counts(df: DataFrame, truth: str, pred: str, group_cols=(), labels=(),
                 weight: str | None = None) -> DataFrame:
    """(group..., label, n_true, n_pred, tp) for every label that occurs.

    ``labels`` are names, or columns of label names, that every group lists,
    with zeros where nothing counts for them. ``weight`` is a column of row
    counts (input that is counted already). An empty table gives no rows.
    """
    if weight is None:  # counted first, so that the labels are listed on few rows
        df = df.groupBy(*group_cols, truth, pred).agg(F.count(F.lit(1)).alias("_n"))
        weight = "_n"
    n, zero = F.col(weight), F.lit(0).cast("long")

    def tick(label, t, p, tp):
        return F.struct(label.alias("label"), t.alias("t"), p.alias("p"), tp.alias("tp"))

    hit = F.when(F.col(truth).eqNullSafe(F.col(pred)), n).otherwise(zero)
    listed = [x if isinstance(x, Column) else F.lit(x) for x in labels]
    ticks = F.array(tick(F.col(truth), n, zero, hit), tick(F.col(pred), zero, n, zero),
                    *[tick(x, zero, zero, zero) for x in listed])
    return (df.select(*[F.col(g) for g in group_cols], F.inline(ticks)).groupBy(*group_cols, "label")
            .agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum("tp").alias("tp")))


def per_class_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label (zero_division = 0)."""
    return (counts
            .withColumn("precision", _div0(F.col("tp"), F.col("n_pred")))
            .withColumn("recall", _div0(F.col("tp"), F.col("n_true")))
            .withColumn("f1", _div0(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")))
            .withColumnRenamed("n_true", "support"))


def f1_averages(prf: DataFrame, group_cols=(), support: bool = False) -> DataFrame:
    """Weighted (by support), micro and macro F1 per group; the group's support as well if asked for."""
    agg = prf.groupBy(*group_cols).agg(
        F.sum(F.col("f1") * F.col("support")).alias("_wf"), F.sum("support").alias("_s"),
        F.sum("tp").alias("_tp"), F.sum("n_pred").alias("_p"), F.avg("f1").alias("f1_macro"),
    )
    fp_fn = (F.col("_p") - F.col("_tp")) + (F.col("_s") - F.col("_tp"))
    return agg.select(
        *group_cols, *([F.col("_s").cast("long").alias("support")] if support else []),
        _div0(F.col("_wf"), F.col("_s")).alias("f1_weighted"),
        _div0(F.col("_tp"), F.col("_tp") + fp_fn * F.lit(0.5)).alias("f1_micro"),
        F.col("f1_macro"),
    )


def classification_report(prf: DataFrame, group_cols=()) -> DataFrame:
    """Per-label rows plus 'accuracy', 'macro avg' and 'weighted avg' rows."""
    per = prf.select(*group_cols, F.col("label").alias("row"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    g = prf.groupBy(*group_cols)
    macro = g.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                  F.sum("support").cast("long").alias("support"))
    weighted = g.agg(
        F.lit("weighted avg").alias("row"),
        _div0(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
        _div0(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
        _div0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"),
        F.sum("support").cast("long").alias("support"))
    acc = g.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                _div0(F.sum("tp"), F.sum("support")).alias("f1"),
                F.sum("support").cast("long").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def metric_bundle(prf: DataFrame, codes: DataFrame) -> DataFrame:
    """Per-label rows with the label's code, then the weighted, micro and macro F1, as one table."""
    per = prf.join(codes, on="label", how="left").select(
        F.col("label").alias("row"), "code", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    names = ("f1_weighted", "f1_micro", "f1_macro")
    averages = f1_averages(prf, support=True).unpivot(["support"], list(names), "row", "f1")
    return per.unionByName(averages, allowMissingColumns=True)


def absent_labels(df: DataFrame, truth: str, pred: str, labels: DataFrame) -> DataFrame:
    """Labels of the list that occur in neither column (anti join)."""
    present = df.select(F.col(truth).alias("label")).union(df.select(F.col(pred).alias("label"))).distinct()
    return labels.join(present, on="label", how="left_anti")


def pad_absent(df: DataFrame, truth: str, pred: str, labels, first_label) -> DataFrame:
    """Reference-compatible option: one fake row (truth=first, pred=absent) per absent label.

    ``labels`` is a list of names or a DataFrame (label).
    """
    if not isinstance(labels, DataFrame):
        labels = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    fake = absent_labels(df, truth, pred, labels)
    return df.select(truth, pred).unionByName(fake.select(F.lit(first_label).alias(truth), F.col("label").alias(pred)))


def relabel_by_threshold(label, score, threshold, other: str = "Other"):
    """Keep the label when score > threshold (strict), else ``other``; NaN passes no threshold."""
    return F.when(~F.isnan(score) & (score > threshold), label).otherwise(F.lit(other))


def threshold_sweep(scored: DataFrame, truth: str, label: str, score: str,
                    tenths=range(2, 10), other: str = "Other", labels=None) -> DataFrame:
    """Per-threshold, per-label precision / recall / F1 for all thresholds at once.

    Thresholds are exact tenths ``t / 10`` (no accumulated float noise). Rows
    are counted once by (truth, label, number of thresholds passed); only
    these few counts are expanded to the thresholds. Every truth label, the
    labels in ``labels`` and ``other`` appear at every threshold, and without
    ``labels`` every predicted one as well. An empty table gives zeros.
    """
    tenths = sorted(tenths)
    value = F.col(score)
    passed = [F.when(~F.isnan(value) & (value > F.lit(t / 10.0)), 1).otherwise(0) for t in tenths]
    counted = scored.groupBy(F.col(truth).alias("_truth"), F.col(label).alias("_label"),
                             sum(passed[1:], passed[0]).alias("_passed")).agg(F.count(F.lit(1)).alias("_n"))
    nothing = scored.sparkSession.createDataFrame([(other, other, 0, 0)], counted.schema)  # lists the labels, adds no row
    counted = counted.unionByName(nothing)
    steps = F.array(*[F.struct(F.lit(t / 10.0).alias("threshold"), F.lit(i).alias("_i")) for i, t in enumerate(tenths)])
    rows = counted.select("*", F.inline(steps)).withColumn(
        "_pred", F.when(F.col("_passed") > F.col("_i"), F.col("_label")).otherwise(F.lit(other)))
    listed = [other, F.col("_label")] if labels is None else sorted({*labels, other})
    return per_class_prf(class_counts(rows, "_truth", "_pred", ["threshold"], listed, "_n"))


def pivot_metric(prf: DataFrame, metric: str, tenths=range(2, 10)) -> DataFrame:
    """One row per label, one column per threshold (named like '0.2')."""
    names = [f"{t / 10.0}" for t in tenths]
    keyed = prf.withColumn("_th", F.format_number(F.col("threshold"), 1))
    return keyed.groupBy("label").pivot("_th", names).agg(F.first(metric))


def transpose(df: DataFrame, header_col: str, value_cols: list[str], row_name: str = "row", headers=None) -> DataFrame:
    """Rows become columns: values of ``header_col`` name the new columns.

    Implemented as unpivot + pivot. Without ``headers`` Spark's pivot looks
    the values up itself, within its own ``spark.sql.pivotMaxValues``.
    """
    long = df.unpivot([header_col], [F.col(f"`{c}`") for c in value_cols], row_name, "_v")
    return long.groupBy(row_name).pivot(header_col, headers).agg(F.first("_v"))
