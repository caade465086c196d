"""Small cases for the operators that look at a document by itself."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontamination as D
from colloquy.llm import host_quality as Q
from colloquy.llm import jaccard_join as J
from colloquy.llm import license_scan as L
from colloquy.llm import toxicity as T
from colloquy.llm import url_filter as U

ODD = [None, "", "   \n\t ", "a", "word " * 5000, "Ünïcödé ​text", "x" * 200_000]


def _docs(spark, texts, **extra):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def _repeat_brute(words, w=8):
    runs = [tuple(words[i:i + w]) for i in range(len(words) - w + 1)]
    return len({j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + w)})


def test_repeated_windows_match_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        assert Q._repeated(words) == _repeat_brute(words)


def test_quality_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in Q.judge(_docs(spark, [*ODD, "good " + " ".join(map(str, range(40)))], n_words=7, host=1)).collect()}
    assert len(got) == 8 and got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert got[4]["n_words"] == 5000 and got[4]["n_repeat_words"] == 5000 and got[4]["base_failed"]
    assert not got[7]["base_failed"]
    assert Q.judge(_docs(spark, [])).count() == 0


def test_bad_host_is_rejected_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(50))
    rows = [(i, "spam", "bad") for i in range(95)] + [(100 + i, good, "bad") for i in range(5)]
    rows += [(200 + i, good, f"ok{i % 20}") for i in range(200)] + [(500, good, "tiny"), (501, "spam", "tiny"), (502, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(df).collect()}
    assert not any(kept[100 + i] for i in range(5)) and all(kept[200 + i] for i in range(200))
    assert kept[500] and not kept[501] and kept[502]
    assert sorted(r["doc_id"] for r in Q.keep_good(df).collect()) == sorted(k for k, v in kept.items() if v)


def test_each_rule_drops_its_own_document_of_a_good_host(spark):
    good = " ".join(f"w{i}" for i in range(50))
    junk = {1: "spam", 2: "a b c d e f g h " * 10, 3: good + " " + "$%&" * 20, 4: good + "\nsame line" * 5,
            5: " ".join("x" * 16 + str(i) for i in range(10, 40))}
    failed = {i: [k for k, f in zip(("short", "repeats", "symbols", "lines", "long_words"), _failures(t)) if f]
              for i, t in junk.items()}
    assert failed == {1: ["short"], 2: ["repeats"], 3: ["symbols"], 4: ["lines"], 5: ["long_words"]}
    rows = [(i, t, "host") for i, t in junk.items()] + [(100 + i, good, "host") for i in range(50)]
    kept = Q.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [100 + i for i in range(50)]


def _failures(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, dup = len(words), len(lines) - len(set(lines))
    return (n < 20, _repeat_brute(words) > 0.3 * n, sum(c in "#*$%&|<>" for c in text) > n / 2, dup > 30 or dup > n / 20,
            len("".join(words)) > 15 * n)


def test_license_phrases_priority_and_containment():
    text = "Licensed under the GNU Lesser General Public License, version 3. CC BY-NC 4.0; MIT\nlicense! amit license"
    n, base, first, last, base_labels, labels, score, spans = L.scan_text(text)
    assert n == 19 and base == 2 and (first, last) == (10, 15) and base_labels == "cc-by,mit"
    assert labels == "cc-by,cc-by-nc,lgpl,mit" and 0.9 < score <= 1
    assert len(spans) == 4  # the name with "version" reaches further than the sentence; what lies inside either is suppressed
    assert sum(len(v) for v in L.signatures().values()) > 300


def test_every_license_signature_finds_its_own_phrasing():
    said = [(label, p.replace("@", name)) for label, _, names in L.FAMILIES for name in names for p, _, _ in L.PHRASINGS]
    assert len(said) + sum(map(len, L.RULES.values())) == sum(len(v) for v in L.signatures().values())
    assert [x for x in said if x[0] not in L.scan_text(x[1])[5].split(",")] == []
    assert L.scan_text("Licensed under the Expat License")[5:7] == ("mit", 0.97)


def test_license_scan_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in L.scan(_docs(spark, ODD, labels="x", score=1)).collect()}
    assert got[0]["n_words"] == 0 and got[0]["labels"] == "" and got[0]["first_word"] is None and got[4]["n_words"] == 5000
    assert L.scan(_docs(spark, [])).count() == 0


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://a.NET/x", "https://www.example.net/en/1?q", "http://example.com/de/", "http://x.org/fr/a#b",
            "http://notexample.com/de/", "http://net", "http://casino-win.example.org/casino/play", "http://library.example.org/articles/1",
            "a://b://c.net/"]
    rows = [(i, u, 5.0) for i, u in enumerate([*urls, urls[3]])]
    df = spark.createDataFrame(rows, "page_id long, url string, score double")
    got = {r["page_id"]: r for r in U.judge(df).collect()}
    assert [got[i]["rule"] for i in range(13)] == [None, None, None, "net/", "example.net/en/", "example.com/de/", "org/fr/", None, None,
                                                   None, None, None, "net/"]
    assert got[0]["host"] == "" and got[0]["verdict"] == "allow" and got[4]["path"] == "/en/1" and got[11]["host"] == "b:"
    assert got[9]["verdict"] == "block" and got[10]["verdict"] == "allow"
    assert "Python" not in U.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert U.judge(df.where("false")).count() == 0
    long = U.judge(spark.createDataFrame([(1, "http://a.example.org/" + "x1/" * 3_000), (2, "http://" + "casino" * 1_000 + ".biz/")],
                                         "page_id long, url string"))
    assert [len(r["path"]) for r in long.orderBy("page_id").collect()] == [9_001, 1]


def test_url_model_on_hosts_it_has_not_seen(spark):
    def recall_and_precision(model, rows):
        held = spark.createDataFrame(rows, "host string, path string, label double")
        got = [(r["s"] >= U.THRESHOLD, r["label"] == 1.0) for r in held.select(
            U.score(F.col("host"), F.col("path"), *model).alias("s"), "label").collect()]
        right = sum(s and x for s, x in got)
        return right / sum(x for _, x in got), right / sum(s for s, _ in got)

    hosts = U.labelled_hosts()
    unseen = {h for h, _ in hosts if zlib.crc32(h.encode()) % 5 == 0}  # all rows of a host on one side
    model = U.train(spark, U.labelled_table([x for x in hosts if x[0] not in unseen]))
    recall, precision = recall_and_precision(model, U.labelled_table([x for x in hosts if x[0] in unseen]))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)
    # addresses that are in no table
    bad = ["www.casino.org", "onlinebetting.eu", "xxxmovies.tv", "freetorrents.cc", "nudegirls.com", "viagra-online.ru", "pokerstars.eu", "m.slots.lv",
           "sexchat.nl", "bestcasinos.co.uk", "hdporn.net", "buy-cialis.info"]
    good = ["museum.example.org", "bettercare.org", "www.heidelberg.de", "cityofboston.gov", "lapoesia.es", "uni-essen.de", "sciencedaily.com",
            "essexlibraries.co.uk", "cookingwithfriends.com", "alphabeta.io", "radiofrance.fr", "parks.canada.ca"]
    model = U.train(spark)
    recall, precision = recall_and_precision(model, [(h, "/", 1.0) for h in bad] + [(h, "/", 0.0) for h in good])
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)
    assert model[1] < 0


def _sellers(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for c in t:
        cur = [0]
        for i, x in enumerate(p, 1):
            cur.append(min(prev[i - 1] + (x != c), prev[i] + 1, cur[-1] + 1))
        prev, best = cur, min(best, cur[-1])
    return best


def test_myers_matches_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert D.myers_distance(p, t) == _sellers(p, t)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice("aeiou") for _ in range(n))
    items = [(i, say(25)) for i in range(8)] + [(8, None), (9, ""), (10, "tiny one"), (None, say(20))]
    texts = list(ODD) + [say(60) for _ in range(10)]
    for i, t in items[:8]:
        broken = list(t)
        for k in range(i):  # 0 to 7 edits
            broken[10 + 13 * k] = "#" if k % 2 else ""
        texts.append(say(20) + " " + "".join(broken).upper() + "! " + say(10))
    texts.append("here is a tiny one indeed")
    texts.append("here is a stiny one indeed")
    got = {r["doc_id"]: r for r in D.matches(_docs(spark, texts, hits="x"), spark.createDataFrame(items, "item_id long, text string"),
                                             block_chars=300).collect()}
    for d, t in enumerate(texts):
        want = set()
        for i, x in items:
            x, n = D.normal(x), D.normal(t)
            k = int(len(x) * D.MAX_ERROR_RATE)
            if x and ((k and _sellers(x, n[:3000]) <= k) or (not k and f" {x} " in f" {n} ")):
                want.add(i)
        assert set(got[d]["item_ids"]) == want and got[d]["contaminated"] == bool(want)
    none = D.remove(_docs(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(texts) and none.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_many_benchmark_blocks_take_one_pass_each(spark):
    items = [" ".join(w + n for n in "one two three four five six seven".split()) for w in "abcdef"]
    texts = [None, "nothing here", items[5] + " and " + items[0], items[3], items[3], " ".join(items)]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1)
    whole, parts = D.matches(docs, bench), D.matches(docs, bench, block_chars=60)
    seen = sorted((r["doc_id"], r["contaminated"], r["n_items"], r["item_ids"]) for r in parts.collect())
    assert seen == sorted((r["doc_id"], r["contaminated"], r["n_items"], r["item_ids"]) for r in whole.collect())
    assert sorted(x[2] for x in seen) == [0, 0, 1, 1, 2, 6] and parts.dtypes == whole.dtypes
    assert "ArrowEvalPython" not in parts._jdf.queryExecution().executedPlan().toString()  # the passes are over


def test_label_model_finds_accuracies_and_ignores_a_copy():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    right = lambda p: np.where(rng.random(4000) < p, 1, -1) * np.where(y, 1, -1)
    good, fair = right(0.95), right(0.75)
    bad = right(0.5)
    votes = np.column_stack([good, fair, bad, bad, bad, bad])  # three voters copy a useless one
    m = T.LabelModel(label_accuracy=0.9)
    q = m.fit(votes, np.where(rng.random(4000) < 0.9, 1, -1) * np.where(y, 1, -1))
    acc = m.accuracies(votes, q)
    assert acc[0] > 0.9 > acc[1] > 0.65 and abs(acc[2] - 0.5) < 0.06
    assert ((q > 0.5) == y).mean() > 0.93


def test_toxicity_learns_held_out_words_and_handles_odd_rows(spark):
    rng = random.Random(5)
    plain = [a + b for a in "ba co du fi ga lo me nu".split() for b in "ran tel vis mon kar pel".split()]
    bad = ["zorkle", "zorklish", "zorkling", "grimbo", "grimbolt"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "zorkle grimbo zorkling")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = T.fit(docs, lab)
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == int(i % 6 == 0) for i in held]) > 0.97
    assert got[None]["predicted"] == 1 and got[10_000]["predicted"] == 0 and 0 <= got[10_000]["score"] <= 1
    kept = T.keep_harmless(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    empty = T.fit(docs, lab.where("false"))
    assert T.score(docs.where("false"), empty).count() == 0


def test_training_sample_has_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(200)]
                                 + [(2, "one other text of its own"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 40)], "doc_id long, toxic int").where(~T.held_out())
    assert 1 in [r["doc_id"] for r in labels.collect()]
    assert T.training_rows(docs, labels).count() <= 3


@pytest.mark.parametrize("i", [0, 1, 2])
def test_whole_texts_count(i):
    text = "fine " * 50_000 + ["zero", "MIT License", "Apache   License"][i]
    assert L.scan_text(text)[1] == (i > 0)


def test_items_with_null_and_repeated_ids_are_each_reported(spark):
    items = [(None, "the quick brown fox jumps over the lazy dog"), (None, "pack my box with five dozen liquor jugs now"),
             ("b", "sphinx of black quartz judge my vow today"), ("b", "how vexingly quick daft zebras jump at night")]
    text = " -- ".join(t for _, t in items)
    docs = spark.createDataFrame([(1, text), (1, text), (2, items[2][1]), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    for block_chars in (1 << 20, 50):  # one block, and one for each item
        got = sorted((r["doc_id"], r["item_ids"], r["n_items"]) for r in D.matches(docs, bench, block_chars=block_chars).collect())
        assert got == [(1, [None, None, "b", "b"], 4)] * 2 + [(2, ["b"], 1), (3, [], 0)]


def test_filters_keep_columns_with_the_names_they_use(spark):
    good = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, good, "h", 1, 2, 3, 4, 5, 6)], "doc_id long, text string, source string, hits long, measures long, "
                               "row long, rejected_host long, gone_id long, __hits long")
    for out in (D.remove(df, spark.createDataFrame([(1, "not in there at all, not at all")], "item_id long, text string")), Q.keep_good(df),
                J.keep_one(df), J.keep_one(df.union(df))):
        assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [tuple(df.first())]


def test_one_bad_host_among_twenty(spark):
    good, junk = " ".join(f"w{i}" for i in range(50)), "$ % & " * 20
    rows = [(h * 100 + i, junk if i < (40 if h == 7 else 10) else good, f"h{h}") for h in range(20) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rejected = {r["host"] for r in Q.host_rates(Q.judge(df).select("host", *Q.MEASURES)).where("host_rejected").collect()}
    assert rejected == {"h7"}
    want = sorted(d for d, t, h in rows if t == good and h != "h7")
    assert sorted(r["doc_id"] for r in Q.judge(df).where("kept").collect()) == want
    assert sorted(r["doc_id"] for r in Q.keep_good(df).collect()) == want


def test_words_and_pieces_are_told_apart_by_more_than_a_polynomial(spark):
    import public_tokenizers

    from colloquy.llm.tokens import PieceEncoder, tokenizer_json

    word = "a"
    while len(word) < 1 << 14:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, t) for i, t in enumerate(x[:n] for n in (1024, 2048, 16384) for x in (word, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] for r in J.components(docs).collect())
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = PieceEncoder(tokenizer_json(public_tokenizers.path(name)))
        for got, (_, t) in zip(e.encode_many([t for _, t in rows]), rows):
            assert got.tolist() == e._tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_of_one_hash_are_compared(monkeypatch):
    import public_tokenizers

    from colloquy.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda raw, a, b: (b - a).astype(np.uint64))  # all pieces of a size collide
    e = tokens.PieceEncoder(tokens.tokenizer_json(public_tokenizers.path("word_bpe_49k.json")))
    for texts in (["international understanding"], ["understandable internationals"], ["one two", "six ten"]):
        texts = [t.replace("one two", "some such thing like that").replace("six ten", "fashionable unfashionable") for t in texts]
        assert [x.tolist() for x in e.encode_many(texts)] == [e._tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
