"""The label model, the classifier and the hash tree, worked out anew by plain loops."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from colloquy.llm import hash_tree as H
from colloquy.llm import queries
from colloquy.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def test_posterior_of_the_label_model_by_enumeration():
    rng = np.random.default_rng(8)
    n = 600
    y = rng.random(n) < 0.4
    vote = lambda p, a: np.where(rng.random(n) < a, 0, np.where(rng.random(n) < p, 1, -1) * np.where(y, 1, -1))
    first = vote(0.85, 0.2)
    v = np.column_stack([first, np.where(rng.random(n) < 0.8, first, vote(0.6, 0.1)), vote(0.7, 0.5), vote(0.9, 0.6)])
    label = np.where(rng.random(n) < 0.9, 1, -1) * np.where(y, 1, -1)
    m = T.LabelModel(label_accuracy=0.9, rounds=1)
    q = m.fit(v, label)
    # the first round starts from the labels alone; tables are weighted counts with the same smoothing
    start = [0.9 if x > 0 else 0.1 for x in label]
    weight = [[1 - s, s] for s in start]
    for k in range(n):
        odds = 1.0
        for c in (0, 1):
            share = (sum(label > 0) + 1) / (n + 2)
            p = share if c else 1 - share
            for j, parent in enumerate(m.parent):
                single = Counter()
                for i in range(n):
                    single[v[i, j]] += weight[i][c]
                single = {x: single[x] + m.smoothing for x in (-1, 0, 1)}
                total = sum(single.values())
                single = {x: w / total for x, w in single.items()}
                if parent < 0:
                    p *= single[v[k, j]]
                    continue
                pair = {x: 4 * m.smoothing * single[x] for x in (-1, 0, 1)}
                for i in range(n):
                    if v[i, parent] == v[k, parent]:
                        pair[v[i, j]] += weight[i][c]
                p *= pair[v[k, j]] / sum(pair.values())
            odds = odds * p if c else odds / p
        odds *= (0.9 / 0.1) ** label[k]
        assert abs(odds / (1 + odds) - q[k]) < 1e-9
        if k == 25:  # each takes a few thousand steps
            break
    assert m.parent.count(-1) >= 1 and any(p >= 0 for p in m.parent)
    tied = {j if p < 0 else (min(j, p), max(j, p)) for j, p in enumerate(m.parent)}
    assert (0, 1) in tied  # the voter that follows the first one


def test_classifier_reaches_the_minimum():
    rng = np.random.default_rng(9)
    rows = [sorted(set(rng.integers(0, 12, rng.integers(0, 6)).tolist())) for _ in range(300)]
    truth = rng.normal(size=12)
    target = np.array([1 / (1 + math.exp(-(sum(truth[i] for i in r) - 0.3))) for r in rows])
    w, b = T.train_linear(rows, target, 12, l2=1.0)
    X = np.zeros((300, 12))
    for i, r in enumerate(rows):
        X[i, r] = 1
    p, c = np.zeros(12), 0.0
    for _ in range(50):  # Newton's method on the same loss
        s = 1 / (1 + np.exp(-(X @ p + c)))
        Z = np.column_stack([X, np.ones(300)])
        grad = Z.T @ (s - target) + np.append(p, 0.0)
        step = np.linalg.solve(Z.T @ (Z * (s * (1 - s))[:, None]) + np.diag([1.0] * 12 + [1e-9]), grad)
        p, c = p - step[:12], c - step[12]
    assert np.allclose(w, p, atol=2e-2) and abs(b - c) < 2e-2


def test_each_text_is_scored_by_itself_and_held_out_rows_play_no_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    model = T.fit(docs, labels)
    lexicon = T._Lexicon(model.entries)
    for i, t in texts.items():
        alone = float(T._score_texts([t], lexicon, model)[0])
        assert abs(got[i]["score"] - alone) < 1e-9 and got[i]["predicted"] == int(alone >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    turned = labels.where(T.held_out()).selectExpr("doc_id", "quality", "1 - toxic AS toxic")
    again = T.fit(docs, labels.where(~T.held_out()).unionByName(turned))
    assert np.array_equal(model.weights, again.weights) and model.intercept == again.intercept


def _shard(key, leaves):
    """Down the tree by the smallest draw."""
    draw = lambda node, weight: -math.log((int(hashlib.md5(f"{key}/{node}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13) / weight
    for level in ("region", "rack", "shard"):
        children = defaultdict(list)
        for x in leaves:
            children[f"s{x.shard}" if level == "shard" else getattr(x, level)].append(x)
        if len(children) > 1:
            best = min(sorted(children), key=lambda n: draw(n, sum(x.weight for x in children[n])))
            leaves = children[best]
        else:
            leaves = next(iter(children.values()))
    return leaves[0].shard


def test_shards_by_recomputed_draws(spark):
    rows = queries.op10_hash_tree(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    now, grown = H.layout(40), H.layout(41, planned=40)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r["shard"] == _shard(r["doc_id"], now) and r["grown_shard"] == _shard(r["doc_id"], grown)
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
