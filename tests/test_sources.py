import os
import tempfile

from pyspark.sql import types as T

from colloquy.sources import io


def test_csv_index_col_and_multiline_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="colloquy-csv-", dir="/tmp")
    df = spark.createDataFrame([(0, 'line one\nline "two"', "en"), (1, "plain, with comma", "fr")],
                               "idx long, text string, lang string")
    io.write_csv(df, os.path.join(d, "out"), partition_by=["lang"])
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("text", T.StringType())])
    back = io.read_csv(spark, os.path.join(d, "out"), schema, index_col="idx")
    got = sorted((r.row_id, r.text, r.lang) for r in back.collect())
    assert got == [(0, 'line one\nline "two"', "en"), (1, "plain, with comma", "fr")]


def test_read_tagged_sheets(spark):
    d = tempfile.mkdtemp(prefix="colloquy-sheets-", dir="/tmp")
    for tab, rows in {"bot_a": [(1, "x")], "bot_b": [(1, "y"), (2, "z")]}.items():
        spark.createDataFrame(rows, "Id long, Answer string").write.parquet(os.path.join(d, tab))
    u = io.read_tagged(spark, {t: os.path.join(d, t) for t in ("bot_a", "bot_b")})
    assert sorted((r.tab, r.Id, r.Answer) for r in u.collect()) == [("bot_a", 1, "x"), ("bot_b", 1, "y"), ("bot_b", 2, "z")]
    assert io.preview(u, ["tab", "Id"], 2).count() == 2
    assert io.row_range(u, "Id", 2, 2).count() == 1
