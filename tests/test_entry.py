import duckdb
import pytest

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"threshold", "label", "precision", "recall", "f1", "support"} <= set(df.columns)


def test_every_oracle_has_a_query():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


FAST = ["turn_pairs", "question_answer_pairs", "label_replace_chain", "best_of_levels", "mean_vector",
        "alpha_interval", "language_top1", "topic_subtopic_cascade", "answer_bag", "silhouette_cosine"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_at_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry_mod.queries()[name](spark, SF)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    res = con.sql(entry_mod.oracle_sql()[name])
    cols = res.columns
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(str(r[i]) for i in idx) for r in res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert got == want
