"""Label evaluation plans: score, relabel by threshold, measure.

Flagship: "which language does each document have, and how good is that per
threshold?" -- documents -> keyword scorer over a 4-label table -> top-1 ->
8 thresholds at once -> per-class precision / recall / F1 against the
documents' own ``lang``. One scan, one in-row scoring pass, one small
aggregation; nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import metrics
from colloquy.operators.scoring import KeywordScorer, top1
from colloquy.sources.taxonomy import LANGUAGES, Taxonomy

# Own choice: the scorer's two constants for the language taxonomy.
LANG_SCORER = KeywordScorer(gain=60.0, offset=2.0)


def language_predictions(documents: DataFrame, taxonomy: Taxonomy = LANGUAGES,
                         scorer: KeywordScorer = LANG_SCORER) -> DataFrame:
    """(doc_id, truth, label, score): top-1 language and its score per document."""
    docs = documents.select("doc_id", "text", F.col("lang").alias("truth"))
    return top1(docs, "text", taxonomy, scorer).drop("text")


def language_sweep(documents: DataFrame, tenths=range(2, 10)) -> DataFrame:
    pred = language_predictions(documents)
    return metrics.threshold_sweep(pred, "truth", "label", "score", tenths=tenths, labels=LANGUAGES.labels)


def report_at(documents: DataFrame, threshold_tenths: int = 9) -> DataFrame:
    """Classification report at one threshold (default 0.9)."""
    prf = language_sweep(documents, tenths=[threshold_tenths])
    return metrics.classification_report(prf, group_cols=["threshold"])
