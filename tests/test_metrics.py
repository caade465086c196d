import pytest

from colloquy.operators import metrics as M


def _pairs(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("a", "a")]
    return spark.createDataFrame(rows, "truth string, pred string")


def test_per_class_against_hand_counts(spark):
    prf = M.per_class_prf(M.class_counts(_pairs(spark), "truth", "pred", labels=["a", "b", "c", "d"]))
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in prf.collect()}
    assert got["a"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3))
    assert got["b"] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert got["c"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert got["d"] == (0.0, 0.0, 0.0, 0)


def test_averages(spark):
    prf = M.per_class_prf(M.class_counts(_pairs(spark), "truth", "pred"))
    r = M.f1_averages(prf).first()
    f1 = {"a": 2 / 3, "b": 0.8, "c": 2 / 3}
    assert r.f1_macro == pytest.approx(sum(f1.values()) / 3)
    assert r.f1_weighted == pytest.approx((3 * f1["a"] + 2 * f1["b"] + 2 * f1["c"]) / 7)
    assert r.f1_micro == pytest.approx(5 / 7)


def test_report_rows(spark):
    prf = M.per_class_prf(M.class_counts(_pairs(spark), "truth", "pred"))
    rows = {r.row: r for r in M.classification_report(prf).collect()}
    assert set(rows) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert rows["accuracy"].f1 == pytest.approx(5 / 7) and rows["accuracy"].support == 7


def test_sweep_threshold_strict_and_complete(spark):
    df = spark.createDataFrame([("x", "x", 0.2), ("x", "x", 0.25), ("y", "y", 0.9)], "truth string, label string, score double")
    prf = M.threshold_sweep(df, "truth", "label", "score", tenths=[2, 9])
    got = {(r.threshold, r.label): (r.tp, r.n_pred, r.support) for r in prf.collect()}
    assert got[(0.2, "x")] == (1, 1, 2)  # 0.2 is not > 0.2
    assert got[(0.9, "y")] == (0, 0, 1)  # 0.9 is not > 0.9
    assert got[(0.9, "Other")] == (0, 3, 0)
    assert len(got) == 2 * 3


def test_pivot_and_transpose(spark):
    df = spark.createDataFrame([("x", "x", 0.5), ("y", "x", 0.95)], "truth string, label string, score double")
    prf = M.threshold_sweep(df, "truth", "label", "score")
    piv = M.pivot_metric(prf, "f1")
    assert piv.columns == ["label"] + [f"{t / 10.0}" for t in range(2, 10)]
    t = M.transpose(piv, "label", [c for c in piv.columns if c != "label"])
    assert t.count() == 8 and set(t.columns) == {"row", "Other", "x", "y"}


def test_absent_labels(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "label string")
    out = sorted(r.label for r in M.absent_labels(_pairs(spark), "truth", "pred", labels).collect())
    assert out == ["d"]
    padded = M.pad_absent(_pairs(spark), "truth", "pred", ["a", "b", "c", "d"], "a")
    assert padded.count() == 8


def test_sweep_of_an_empty_table_lists_the_labels(spark):
    df = spark.createDataFrame([], "truth string, label string, score double")
    got = M.threshold_sweep(df, "truth", "label", "score", tenths=[2, 9], labels=["a", "b"]).collect()
    assert sorted((r.threshold, r.label) for r in got) == [(t, x) for t in (0.2, 0.9) for x in ("Other", "a", "b")]
    assert {(r.support, r.n_pred, r.f1) for r in got} == {(0, 0, 0.0)}
