"""Min-max dedup against brute force over all pairs."""
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import minmax_dedup as M
from colloquy.llm import queries

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return frozenset([" ".join(w)] if 0 < len(w) < 3 else [tuple(w[i:i + 3]) for i in range(len(w) - 2)])


def _brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, sorted."""
    sets = [_set(t) for _, t in rows]
    by_shingle, near = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for places in by_shingle.values():
        for k, i in enumerate(places):
            for j in places[:k]:
                near[j, i] = near.get((j, i), 0) + 1
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for (i, j), o in near.items():
        if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
            up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    out = [(d, len(s), ids.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def _texts(rng):
    """Groups of near copies on both sides of the threshold, chains, short texts, copies."""
    words = [a + b for a in "bcdfghklm" for b in ("a", "e", "i", "o", "u", "ar", "en", "is")]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "One\ttwo", "one two three", "x" * 100_000, "word " * 3000]
    for n in (9, 20, 60, 200, 9000):
        base = say(n)
        texts += [" ".join(base)] * 3
        for _ in range(12):  # drift, so that links form chains
            base = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                base[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(base).title() if rng.random() < 0.3 else " ".join(base))
    one = say(40)
    texts += [" ".join(one[:k] + ["changed"] + one[k + 1:]) for k in range(40) for _ in range(2)]
    return texts


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = _texts(rng)
    rows = [(rng.choice([None, i, i, i, i, i, i // 2]), t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("n", "node", "text_hash", "kept", "token")}).repartition(6)
    assert _got(M.components(df)) == _brute(rows)
    # small segments, split hubs, and all left to the rest round
    for name, value in (("SEGMENT", 64), ("HUB_MEMBERS", 3), ("STAR_ROUNDS", 0)):
        monkeypatch.setattr(M, name, value)
    assert _got(M.components(df)) == _brute(rows)
    assert M.components(df.where("false")).count() == 0
    strings = M.components(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert strings.count() == len(rows)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(queries.op13_minmax_dedup(spark, sf)) == _brute(rows)


def test_both_ends_estimate_without_bias_and_with_less_variance():
    rng = np.random.default_rng(3)
    errors, single = [], []
    for _ in range(6000):
        h = rng.integers(0, 2 ** 64 - 1, 8, dtype=np.uint64)
        same = [x == y for x, y in zip(M.signature(h[:7]), M.signature(h[1:]))]  # 6 of 8
        errors.append(np.concatenate(same).mean() - 6 / 8)
        single.append(same[0].mean() - 6 / 8)
    assert abs(np.mean(errors)) < 0.003
    # two ends of a permutation are drawn without replacement: less variance than two permutations
    assert np.var(errors) < 0.46 * np.var(single)
    assert (1 - 0.85 ** 4) ** M.BANDS < 3e-8
