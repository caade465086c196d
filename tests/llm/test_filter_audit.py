"""Filter audit against plain counting, order by order."""
import random
import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from colloquy.llm import filter_audit as A
from colloquy.llm import queries


def _brute(docs, labels):
    """Rows (doc_id, text, part) and (doc_id, quality, toxic), counted by the contract."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    fails = []
    for i, t, p in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((i, p, {f for f, x in bad.items() if x}))
    out = {}
    for p in {p for _, _, p in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        mine = [(i, f) for i, q, f in fails if q == p]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(removed)
                out[p, "".join(order), step] = [
                    len(left), len(removed), sum(x in f for _, f in mine) - len(removed), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
        for (q, order, step), row in out.items():
            if q == p:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _got(df):
    rows = df.select("part", "filter_order", "step", *A.FIELDS, "shapley").collect()
    assert len({tuple(r)[:3] for r in rows}) == len(rows)
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def test_odd_rows_match_plain_counting(spark, monkeypatch):
    rng = random.Random(8)
    words = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", " \n\t", "ABC def", words, words + " #", words.upper(), "a b " * 150, "x" * 300_000, " word joined " * 120, words + "\x1c" * 5]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "b", "", None, "ü"])) for _ in range(400)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns(
        {c: F.lit("x") for c in ("part", "mask", "digest", "good", "toxic", "id")}).repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = _brute(docs, labels)
    assert _got(A.audit(df, marks)) == want
    monkeypatch.setattr(A, "MAX_PARTS", 2)  # sums of a part given several times
    assert _got(A.audit(df, marks)) == want
    assert A.audit(df.where("false"), marks).count() == 0
    plain = _got(A.audit(df, marks.where("false")))
    assert all(v[4] == v[5] == 0 for v in plain.values())


def test_fields_do_not_overflow():
    big = (1 << 63) + 5
    counts = A.unpack(sum(A.packed(m, m % 2 == 0, m % 3 == 0) * (big if m == 31 else 1) for m in range(32)))
    order, steps = A.orders(), counts[:, :, A.FIELDS.index("removed")]
    for o, row in zip(order, steps):
        assert [int(x) for x in row] == [(big if s == 0 else 0) + (16 >> s) - (s == 0) for s in range(5)], o
    assert counts[:, :, 0].max() == 16 and len(order) == 120


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols = ["part", "filter_order", "step", *A.FIELDS, "shapley"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE['op12_filter_audit']})").fetchall()
    df = queries.op12_filter_audit(spark, sf)
    assert _got(df) == {r[:3]: r[3:] for r in want} and len(want) % 600 == 0
