"""Zero-shot style label scoring, top-1 choice and topic -> subtopic cascades.

Scorer contract: for every (text, label) pair a scorer yields two logits,
``contradiction`` and ``entailment``; the label's score is the two-way softmax
``exp(e) / (exp(c) + exp(e))``. Labels are scored independently, so scores of
one list do not sum to 1. Top-1 ties go to the label later in the list.

Two execution paths:

* in-row (default keyword scorer): every text is tokenised once, the tokens
  are looked up in one literal keyword -> label-ids map, and all scores of all
  taxonomies are computed inside the row. No join, no shuffle, no Python.
* long form (any scorer, e.g. a model behind ``predict_batch_udf``): texts are
  exploded into (text, label) pairs, scored, and reduced with ``max_by``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import hypothesis as hypothesis_col
from colloquy.functions.text import tokens as tokens_col
from colloquy.functions.vectors import entailment_score
from colloquy.sources.taxonomy import HYPOTHESIS_TEMPLATE, Taxonomy


@dataclass(frozen=True)
class KeywordScorer:
    """Default scorer: evidence share of a label's keywords among the tokens.

    entailment = gain * hits / tokens, contradiction = offset, so a text with
    no evidence scores 1 / (1 + e^offset) and a text full of evidence -> 1.
    """

    gain: float = 60.0
    offset: float = 2.0
    with_sublabels: bool = True

    def logits(self, hits: Column, ntok: Column) -> tuple[Column, Column]:
        e = F.lit(self.gain) * hits.cast("double") / F.greatest(ntok, F.lit(1)).cast("double")
        return F.lit(self.offset), e

    def score(self, hits: Column, ntok: Column) -> Column:
        c, e = self.logits(hits, ntok)
        return entailment_score(c, e)

    # long-form path -----------------------------------------------------
    def prepare(self, df: DataFrame, taxonomy: Taxonomy, text_col: str = "text") -> DataFrame:
        """Add what ``score_pairs`` needs of a text, so that it is read once and not per label:
        ``_ntok``, its number of tokens, and ``_evidence``, those that are a keyword of some label."""
        space = LabelSpace([taxonomy], self)
        df = df.withColumn("_toks", tokens_col(text_col))
        known = F.filter("_toks", lambda t: F.size(space.lookup(t)) > 0)
        return df.withColumn("_ntok", F.size("_toks")).withColumn("_evidence", known).drop("_toks")

    def score_pairs(self, pairs: DataFrame, taxonomy: Taxonomy, text_col: str = "text",
                    label_col: str = "label") -> DataFrame:
        """Add ``contradiction``/``entailment`` to (text, label) pair rows, of prepared texts or plain ones."""
        kw = {lab: taxonomy.keywords_of(lab, self.with_sublabels) for lab in taxonomy.labels}
        kw_map = F.create_map(*[x for lab, words in kw.items()
                                for x in (F.lit(lab), F.array(*[F.lit(w) for w in words]))])
        words = F.coalesce(F.try_element_at(kw_map, F.col(label_col)), F.array().cast("array<string>"))
        if "_evidence" not in pairs.columns:
            pairs = pairs.withColumn("_evidence", tokens_col(text_col)).withColumn("_ntok", F.size("_evidence"))
        pairs = pairs.withColumn("_words", words)
        flags = F.zip_with("_evidence", F.array_repeat(F.col("_words"), F.size("_evidence")), lambda t, w: F.array_contains(w, t))
        hits = F.size(F.filter(flags, lambda b: b))
        c, e = self.logits(hits, F.col("_ntok"))
        pairs = pairs.withColumn("contradiction", c.cast("double")).withColumn("entailment", e)
        return pairs.drop("_evidence", "_ntok", "_words")


class ModelScorer:
    """Wrap a user model as a pair scorer through ``predict_batch_udf``.

    ``make_predict_fn`` is called once per Python worker and must return a
    function ``(texts: np.ndarray, hypotheses: np.ndarray) -> dict`` with
    arrays ``contradiction`` and ``entailment``. Batches travel by Arrow.
    """

    def __init__(self, make_predict_fn, batch_size: int = 64):
        from pyspark.ml.functions import predict_batch_udf

        self._udf = predict_batch_udf(
            make_predict_fn,
            return_type=T.StructType([T.StructField("contradiction", T.DoubleType()),
                                      T.StructField("entailment", T.DoubleType())]),
            batch_size=batch_size,
        )

    def score_pairs(self, pairs: DataFrame, taxonomy: Taxonomy | None = None,
                    text_col: str = "text", label_col: str = "label") -> DataFrame:
        out = pairs.withColumn("_logits", self._udf(F.col(text_col), F.col("hypothesis")))
        return (out.withColumn("contradiction", F.col("_logits.contradiction"))
                .withColumn("entailment", F.col("_logits.entailment")).drop("_logits"))


# ---------------------------------------------------------------------------
# long form
# ---------------------------------------------------------------------------

def label_array(labels) -> Column:
    return F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(i).alias("pos"))
                     for i, lab in enumerate(labels)])


def text_label_pairs(df: DataFrame, taxonomy: Taxonomy, template: str = HYPOTHESIS_TEMPLATE,
                     keep: list[str] | None = None) -> DataFrame:
    """Every row with every label of the list, plus the hypothesis sentence.

    The label list is a literal array exploded inside the row (no join).
    """
    keep = keep if keep is not None else df.columns
    out = df.select(*keep, F.inline(label_array(taxonomy.labels)))
    return out.withColumn("hypothesis", hypothesis_col(template, F.col("label")))


def pair_scores(scored_pairs: DataFrame) -> DataFrame:
    """Two-way softmax of the logits into ``score``."""
    return scored_pairs.withColumn("score", entailment_score("contradiction", "entailment"))


def rank_labels(scored: DataFrame, id_cols: list[str]) -> DataFrame:
    """Labels of each text by score, best first; ties -> later label first."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*id_cols).orderBy(F.col("score").desc(), F.col("pos").desc())
    return scored.withColumn("rank", F.row_number().over(w))


def top1_long(scored: DataFrame, id_cols: list[str]) -> DataFrame:
    """Best label per text: ``max_by`` over (score, pos), one row per id."""
    best = F.max_by(F.struct("label", "score"), F.struct("score", "pos"))
    return (scored.groupBy(*id_cols).agg(best.alias("_b"))
            .select(*id_cols, F.col("_b.label").alias("label"), F.col("_b.score").alias("score")))


# ---------------------------------------------------------------------------
# in-row
# ---------------------------------------------------------------------------

class LabelSpace:
    """Global label ids for a set of taxonomies (top lists and sublists)."""

    def __init__(self, taxonomies, scorer: KeywordScorer):
        self.scorer = scorer
        self.entries: list[tuple[str, str | None, str, int, list[str]]] = []
        self.gid: dict[tuple[str, str | None, str], int] = {}
        for tax in taxonomies:
            for i, lab in enumerate(tax.labels):
                self._add(tax.name, None, lab, i, tax.keywords_of(lab, scorer.with_sublabels))
            for parent, subs in tax.sublists.items():
                for i, lab in enumerate(subs):
                    self._add(tax.name, parent, lab, i, lab.lower().split())
        self.taxonomies = {t.name: t for t in taxonomies}

    def _add(self, tax, parent, label, pos, words):
        key = (tax, parent, label)
        if key in self.gid:
            return
        self.gid[key] = len(self.entries)
        self.entries.append((tax, parent, label, pos, list(dict.fromkeys(words))))

    def keyword_map(self) -> Column:
        """Literal map: token length -> (keyword -> label ids).

        Spark looks map keys up by a linear scan, so keywords are split by
        length first: a token is compared with the few keywords of its own
        length instead of all of them.
        """
        by_word: dict[str, list[int]] = {}
        for g, (_, _, _, _, words) in enumerate(self.entries):
            for w in words:
                by_word.setdefault(w, []).append(g)
        by_len: dict[int, list[str]] = {}
        for w in sorted(by_word):
            by_len.setdefault(len(w), []).append(w)
        lens = sorted(by_len)
        inner = [F.map_from_arrays(F.array(*[F.lit(w) for w in by_len[n]]),
                                   F.array(*[F.array(*[F.lit(g) for g in by_word[w]]) for w in by_len[n]]))
                 for n in lens]
        return F.map_from_arrays(F.array(*[F.lit(n) for n in lens]), F.array(*inner))

    def lookup(self, token: Column) -> Column:
        """Label ids a token is evidence for (empty array when none)."""
        inner = F.try_element_at(self.keyword_map(), F.length(token))
        return F.coalesce(F.try_element_at(inner, token), F.array().cast("array<int>"))

    def add_scores(self, df: DataFrame, text_col: str) -> DataFrame:
        """Add ``_scores``: array of every label's score, indexed by label id.

        Heavy expressions (tokens, matched ids) are materialised as columns and
        only passed *as arguments* to higher-order functions, never referenced
        inside a lambda body, so the optimizer cannot inline them into a
        per-label loop: each text is tokenised and looked up exactly once.
        """
        n = len(self.entries)
        df = df.withColumn("_toks", tokens_col(text_col))
        df = (df.withColumn("_ntok", F.size("_toks"))
              .withColumn("_hit_ids", F.flatten(F.transform("_toks", self.lookup))))
        # only the labels that were hit are counted; the others are 0
        df = df.withColumn("_labels", F.array_distinct("_hit_ids"))
        times = F.zip_with("_labels", F.array_repeat(F.col("_hit_ids"), F.size("_labels")),
                           lambda g, hits: F.size(F.filter(hits, lambda x: x == g)))
        df = df.withColumn("_counts", F.map_from_arrays("_labels", times))
        facts = F.array_repeat(F.struct(F.col("_counts").alias("c"), F.col("_ntok").alias("m")), n)
        scores = F.zip_with(F.sequence(F.lit(0), F.lit(n - 1)), facts,
                            lambda g, f: self.scorer.score(F.coalesce(F.try_element_at(f["c"], g), F.lit(0)), f["m"]))
        return df.withColumn("_scores", scores).drop("_toks", "_hit_ids", "_ntok", "_labels", "_counts")

    def _score_of(self, g) -> Column:
        return F.element_at(F.col("_scores"), g + 1)

    def best_of(self, tax_name: str) -> Column:
        """struct(score, pos, label) of the best top-level label of a list."""
        tax = self.taxonomies[tax_name]
        cands = [F.struct(self._score_of(F.lit(self.gid[(tax_name, None, lab)])).alias("score"),
                          F.lit(i).alias("pos"), F.lit(lab).alias("label"))
                 for i, lab in enumerate(tax.labels)]
        return F.array_max(F.array(*cands))

    def best_sub(self, tax_name: str, parent: Column) -> Column:
        """Best label of the winner's sublist; null when the winner has none."""
        tax = self.taxonomies[tax_name]
        pairs = []
        for p, subs in tax.sublists.items():
            arr = F.array(*[F.struct(F.lit(self.gid[(tax_name, p, s)]).alias("gid"), F.lit(i).alias("pos"),
                                     F.lit(s).alias("label")) for i, s in enumerate(subs)])
            pairs.extend([F.lit(p), arr])
        if not pairs:
            return F.lit(None).cast("struct<score:double,pos:int,label:string>")
        sub_map = F.create_map(*pairs)
        subs = F.try_element_at(sub_map, parent)
        scored = F.transform(subs, lambda s: F.struct(
            F.element_at(F.col("_scores"), s["gid"] + 1).alias("score"), s["pos"].alias("pos"),
            s["label"].alias("label")))
        return F.array_max(scored)


def top1(df: DataFrame, text_col: str, taxonomy: Taxonomy, scorer: KeywordScorer | None = None,
         label_col: str = "label", score_col: str = "score") -> DataFrame:
    """Best label of one list for every row (in-row path)."""
    space = LabelSpace([taxonomy], scorer or KeywordScorer())
    out = space.add_scores(df, text_col).withColumn("_best", space.best_of(taxonomy.name))
    return (out.withColumn(label_col, F.col("_best.label"))
            .withColumn(score_col, F.col("_best.score")).drop("_best", "_scores"))


def all_label_scores(df: DataFrame, id_cols: list[str], text_col: str, taxonomy: Taxonomy,
                     scorer: KeywordScorer | None = None) -> DataFrame:
    """Long (id, label, pos, score) rows for one list, computed in-row then inlined."""
    space = LabelSpace([taxonomy], scorer or KeywordScorer())
    out = space.add_scores(df.select(*id_cols, text_col), text_col)
    arr = F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(i).alias("pos"),
                             space._score_of(F.lit(space.gid[(taxonomy.name, None, lab)])).alias("score"))
                    for i, lab in enumerate(taxonomy.labels)])
    return out.select(*id_cols, F.inline(arr))


def cascade(df: DataFrame, text_col: str, levels, flat=(), scorer: KeywordScorer | None = None,
            names: dict | None = None) -> DataFrame:
    """Topic and subtopic per level, plus flat lists, as result columns.

    For every level the best label is chosen; the winner's sublist (if any) is
    scored and its best label becomes the subtopic, else the subtopic falls
    back to the topic itself with score 0. ``names`` maps
    (level_index, kind) -> column name; by default the wide annotation names.
    """
    space = LabelSpace([*levels, *flat], scorer or KeywordScorer())
    out = space.add_scores(df, text_col)
    cols = []
    for i, tax in enumerate(levels, start=1):
        best = space.best_of(tax.name)
        out = out.withColumn(f"_t{i}", best)
        sub = space.best_sub(tax.name, F.col(f"_t{i}.label"))
        out = out.withColumn(f"_s{i}", sub)
        cols += [
            F.col(f"_t{i}.label").alias(f"TOPIC_IS_{i}"),
            F.col(f"_t{i}.score").alias(f"TOPIC_IS_SCORE_{i}"),
            F.coalesce(F.col(f"_s{i}.label"), F.col(f"_t{i}.label")).alias(f"SUBTOPIC_IS_{i}"),
            F.coalesce(F.col(f"_s{i}.score"), F.lit(0.0)).alias(f"SUBTOPIC_IS_SCORE_{i}"),
        ]
    flat_names = names or {}
    for tax in flat:
        base = flat_names.get(tax.name, f"TOPIC_{tax.name.upper()}_IS")
        out = out.withColumn(f"_f_{tax.name}", space.best_of(tax.name))
        cols += [F.col(f"_f_{tax.name}.label").alias(base),
                 F.col(f"_f_{tax.name}.score").alias(f"{base}_SCORE")]
    keep = [c for c in df.columns]
    return out.select(*keep, *cols)


def target_vs_other(df: DataFrame, text_col: str, taxonomy: Taxonomy, target: str,
                    scorer: KeywordScorer | None = None) -> DataFrame:
    """Score (target, 'other') per row and keep the target's own score.

    Adds ``zs_topic`` (always the target) and ``zs_score``, whatever the
    target's rank among the two labels.
    """
    space = LabelSpace([taxonomy], scorer or KeywordScorer())
    out = space.add_scores(df, text_col)
    g = space.gid[(taxonomy.name, None, target)]
    return (out.withColumn("zs_topic", F.lit(target))
            .withColumn("zs_score", space._score_of(F.lit(g))).drop("_scores"))


def filter_score(df: DataFrame, threshold: float = 0.7, score_col: str = "zs_score") -> DataFrame:
    """Rows whose score is strictly above the threshold; a NaN score is not."""
    return df.where(~F.isnan(score_col) & (F.col(score_col) > threshold))
