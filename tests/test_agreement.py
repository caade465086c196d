import pytest

from colloquy.operators import agreement as A

# Krippendorff's published reliability example: 4 coders x 12 units, '.' = missing.
EXAMPLE = """A 1 2 3 3 2 1 4 1 2 . . .
B 1 2 3 3 2 2 4 1 2 5 . 3
C . 3 3 3 2 3 4 2 2 5 1 .
D 1 2 3 3 2 4 4 1 2 5 1 ."""


def _ratings(spark):
    rows = []
    for line in EXAMPLE.splitlines():
        coder, *vals = line.split()
        for unit, v in enumerate(vals, start=1):
            if v != ".":
                rows.append(("sheet", unit, coder, int(v)))
    return spark.createDataFrame(rows, "tab string, item_id long, annotator string, value int")


def test_alpha_known_answers(spark):
    r = _ratings(spark)
    nominal = A.alpha(r, ["tab", "item_id"], "value", "nominal").first().alpha
    interval = A.alpha(r, ["tab", "item_id"], "value", "interval", value_domain=tuple(range(1, 10))).first().alpha
    assert nominal == pytest.approx(0.743, abs=5e-4)
    assert interval == pytest.approx(0.849, abs=5e-4)


def test_alpha_out_of_domain_and_all_equal(spark):
    r = spark.createDataFrame([("s", 1, "A", 3), ("s", 1, "B", 3), ("s", 2, "A", 3), ("s", 2, "B", 3), ("s", 3, "A", 7)],
                              "tab string, item_id long, annotator string, value int")
    assert A.alpha(r, ["tab", "item_id"]).first().alpha is None  # no disagreement possible
    bad = r.union(spark.createDataFrame([("s", 3, "B", 12)], r.schema))
    assert A.alpha(bad, ["tab", "item_id"], level="interval", value_domain=tuple(range(1, 10))).first().alpha is None


def test_alpha_per_group(spark):
    r = _ratings(spark)
    two = r.union(r.selectExpr("'other' AS tab", "item_id", "annotator", "value"))
    out = A.alpha(two, ["item_id"], group_cols=["tab"]).collect()
    assert len(out) == 2 and all(x.alpha == pytest.approx(0.743, abs=5e-4) for x in out)


def test_observed_agreement(spark):
    r = spark.createDataFrame([(1, "A", 1), (1, "B", 1), (2, "A", 1), (2, "B", 2), (3, "A", 5), (3, "C", 5)],
                              "item_id long, annotator string, value int")
    out = {x.pair: x.ao for x in A.observed_agreement(r, ["item_id"], ["A", "B", "C"]).collect()}
    assert out["A|B"] == 0.5 and out["A|C"] == 1.0 and out["B|C"] is None
    assert out["mean"] == pytest.approx(0.75)


def test_wide_sheet_to_long_int_ratings(spark):
    sheet = spark.createDataFrame([(1, "3", None), (2, "x", "7"), (None, "1", "1")], "Id int, A string, B string")
    long = A.wide_to_long(sheet.where("Id IS NOT NULL"), "Id", ["A", "B"], tab="bot")
    got = sorted((r.item_id, r.annotator, r.value) for r in long.collect())
    assert got == [(1, "A", 3), (2, "B", 7)]
