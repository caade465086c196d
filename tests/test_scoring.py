import numpy as np

from colloquy.operators import scoring as S
from colloquy.sources.taxonomy import LANGUAGES, TOPIC_LEVEL1, Taxonomy
from colloquy.streaming.annotate import annotate

TAX = Taxonomy("t", ("alpha", "beta", "gamma"), {"alpha": ["one", "two"], "beta": ["three"]})


def test_top1_tie_goes_to_later_label(spark):
    df = spark.createDataFrame([(1, "nothing relevant"), (2, "alpha beta"), (3, "beta beta alpha")], "id long, text string")
    out = {r.id: r.label for r in S.top1(df, "text", TAX).collect()}
    assert out == {1: "gamma", 2: "beta", 3: "beta"}


def test_sublabel_words_count_as_evidence_for_parent(spark):
    df = spark.createDataFrame([(1, "one two three")], "id long, text string")
    r = S.top1(df, "text", TAX).first()
    assert r.label == "alpha"


def test_long_form_equals_in_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["the cat and the dog", "le chat et la souris", "der Hund und die Katze", "", None, "el perro y los gatos"])],
        "id long, text string")
    a = {r.id: (r.label, round(r.score, 12)) for r in S.top1(df, "text", LANGUAGES).collect()}
    pairs = S.text_label_pairs(df, LANGUAGES)
    scored = S.pair_scores(S.KeywordScorer().score_pairs(pairs, LANGUAGES))
    b = {r.id: (r.label, round(r.score, 12)) for r in S.top1_long(scored, ["id"]).collect()}
    assert a == b
    assert a[0][0] == "en" and a[1][0] == "fr" and a[2][0] == "de" and a[5][0] == "es"
    assert a[3][0] == "es" and abs(a[3][1] - 1 / (1 + np.exp(2.0))) < 1e-12


def test_cascade_fallback_without_sublist(spark):
    df = spark.createDataFrame([(1, "animals animals"), (2, "football match"), (3, "xyz")], "id long, text string")
    out = {r.id: r for r in S.cascade(df, "text", [TOPIC_LEVEL1]).collect()}
    assert out[1].TOPIC_IS_1 == "animals" and out[1].SUBTOPIC_IS_1 == "animals" and out[1].SUBTOPIC_IS_SCORE_1 == 0.0
    assert out[2].TOPIC_IS_1 == "sports" and out[2].SUBTOPIC_IS_1 == "football"
    # no evidence anywhere: last label wins, its sublist's last label wins
    assert out[3].TOPIC_IS_1 == "videogames" and out[3].SUBTOPIC_IS_1 == "wii"


def test_wide_annotation_has_16_columns_and_keeps_input(spark):
    df = spark.createDataFrame([(1, "a", "some text")], "id long, extra string, DIAL string")
    out = annotate(df, "DIAL")
    assert out.columns[:3] == ["id", "extra", "DIAL"] and len(out.columns) == 3 + 16


def test_entailment_score_has_no_overflow(spark):
    from pyspark.sql import functions as F

    from colloquy.functions.vectors import entailment_score

    df = spark.createDataFrame([(1000.0, -1000.0), (-1000.0, 1000.0), (0.0, 0.0)], "c double, e double")
    out = [r[0] for r in df.select(entailment_score(F.col("c"), F.col("e"))).collect()]
    assert out == [0.0, 1.0, 0.5]


def test_target_vs_other_keeps_target_score(spark):
    tax = Taxonomy("tv", ("en", "other"), {}, {"en": ["the"], "other": ["other"]})
    df = spark.createDataFrame([(1, "other other other the")], "id long, q string")
    r = S.target_vs_other(df, "q", tax, "en").first()
    assert r.zs_topic == "en" and abs(r.zs_score - 1 / (1 + np.exp(2.0 - 60 * 0.25))) < 1e-12


def test_model_scorer_plugs_into_long_form(spark):
    def make():
        def predict(texts, hyps):
            e = np.array([float(len(h)) if "beta" in h else 0.0 for h in hyps])
            return {"contradiction": np.zeros(len(texts)), "entailment": e}
        return predict

    df = spark.createDataFrame([(1, "whatever")], "id long, text string")
    pairs = S.text_label_pairs(df, TAX)
    scored = S.pair_scores(S.ModelScorer(make, batch_size=8).score_pairs(pairs))
    assert S.top1_long(scored, ["id"]).first().label == "beta"
