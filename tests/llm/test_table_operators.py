"""Archives, token files, joins, packing and sharding against brute force."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import arc_warc as A
from colloquy.llm import config_packing as P
from colloquy.llm import hash_tree as H
from colloquy.llm import jaccard_join as J
from colloquy.llm import token_store as S
from colloquy.llm.tokens import PieceEncoder, tokenizer_json

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "  \n", "a", "one two three", "x" * 3000, "É​ ß\x00\x1c ok", "end <|endoftext|> of"]


def _docs(spark, texts, **extra):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab '\n\t .,1é<|ß 　́ΣÀ×") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    whole = Tokenizer.from_file(path)
    got = PieceEncoder(tokenizer_json(path)).encode_many(texts)
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark):
    texts = ODD + [f"some words number {i} and more of them" for i in range(200)]
    docs = _docs(spark, texts, start=1).unionByName(spark.createDataFrame([(3, "repeated id", 1), (None, "no id", 1)],
                                                                          "doc_id long, text string, start int"))
    manifest = S.write(docs, WORD, end_id=2)
    rows = sorted(S.read(manifest).collect(), key=lambda r: r["start"])
    tok = Tokenizer.from_file(WORD)
    want = sorted([(d, t) for d, t, _ in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (d, t) in zip(rows, want):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (d, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    one = S.TokenFile(manifest.first()["path"])
    assert one.ids(0).tolist()[-1] == 2 and len(rows) == len(want)
    # single documents, by ranges of the file
    for path in [r["path"] for r in manifest.collect()]:
        whole = S.TokenFile(path)
        for k, doc_id in enumerate(whole.doc_ids):
            got = S.document(path, doc_id)
            assert any(np.array_equal(x, whole.ids(k)) for x in got) and len(got) == whole.doc_ids.count(doc_id)
        assert S.document(path, -5) == []
    assert S.read(S.write(docs.where("false"), WORD, end_id=2)).count() == 0


def _page_rows():
    same = "<p>" + "x" * 200 + "</p>"
    return [(5, "http://a.org/ b", same), (2, "http://b.org/", same), (9, None, same), (7, "http://c.org", None), (8, "", ""),
            (1, "http://d.org", "short"), (3, "http://e.org", "short"), (None, "http://f.org", same), (2, "http://b.org/", same),
            (4, "dns:x", "WARC/1.1\r\n\r\nHTTP/1.1\n" * 9), (6, "http://g.org/é", "é" * 60)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(_page_rows(), "page_id long, url string, html string").withColumn("refers_to", F.lit(1))
    arcs = A.write_arc(df)
    records = A.with_referred_pages(A.read_warc(A.to_warc(arcs), with_payload=True).cache())
    got = records.collect()
    assert len(got) == 11
    payload = sorted((r["page_id"] or -1, bytes(r["payload"])) for r in got if r["record_type"] == "response")
    assert (4, ("WARC/1.1\r\n\r\nHTTP/1.1\n" * 9).encode()) in payload and (6, ("é" * 60).encode()) in payload
    same = [r for r in got if r["payload_bytes"] == 207]
    assert len(same) == 5 and sorted(r["record_type"] for r in same) == ["response"] + ["revisit"] * 4
    assert {r["refers_to"] for r in same if r["record_type"] == "revisit"} == {2}
    assert all(r["payload_digest"] == hashlib.sha256(b"short").hexdigest() and r["record_type"] == "response"
               for r in got if r["page_id"] in (1, 3))
    assert {r["target_uri"] for r in got if r["page_id"] in (9, 5)} == {None, "http://a.org/%20b"}
    assert A.read_warc(A.to_warc(A.write_arc(df.where("false")))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_wrong_lengths(version):
    whole = A.arc_version_block(version, "n.arc") + b"\n" + A.arc_record(version, "n.arc", 0, "http://a/", b"a\nb\n") + b"\n\n"
    r = next(A.parse_arc(whole))
    assert r.body == b"a\nb\n" and r.fields["URL"] == "http://a/" and len(r.fields) == (5 if version == 1 else 10)
    with pytest.raises(ValueError):
        list(A.parse_arc(whole.replace(b" 4\na\nb", b" 400\na\nb")))


def _brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
        w = [x for x in w if x]
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in sets]


def test_jaccard_components_match_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(25)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \n ", "One two", "one TWO", "one two three"]
    for b in base:
        for _ in range(rng.randint(1, 9)):
            c = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    texts += [" ".join([*shared, *(rng.choice(words) for _ in range(k))]) for k in range(0, 30, 2) for _ in range(2)]
    rng.shuffle(texts)
    got = sorted(map(tuple, J.components(_docs(spark, texts, n=1, node="x")).collect()))
    assert got == _brute_components(texts)
    kept = J.keep_one(_docs(spark, texts, n=1).unionByName(_docs(spark, texts[:20], n=1)))
    assert kept.columns == ["doc_id", "text", "n"]
    blank = {i for i, n, _ in got if not n}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, n, c in got if i == c}
    assert kept.where(~F.col("doc_id").isin(list(blank))).count() == sum(i == c for i, n, c in got if n)
    assert J.components(_docs(spark, [])).count() == 0


def test_jaccard_null_ids_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, long), (7, long + " x"), (4, "other text " * 9), (4, long), (None, None)], "doc_id long, text string")
    got = sorted(((r[0], r[2]) for r in J.components(df).collect()), key=str)
    assert got == sorted([(None, 4), (7, 4), (4, 4), (4, 4), (None, None)], key=str)


def test_packing_places_every_token_once(spark):
    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([3, 10, 40, 90, 300]))) for _ in range(120)]
    got = P.pack_documents(_docs(spark, texts, length=1, rank=2), BYTE, end_id=0, capacity=64).collect()
    tok = Tokenizer.from_file(BYTE)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        rows = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in rows] == P.cut(len(ids), 64)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in rows)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    rooms = []  # few short pieces, so the total is no bound here: first fit, longest first, is the measure
    for length in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= length), None)
        if k is None:
            rooms.append(64 - length)
        else:
            rooms[k] -= length
    assert len(by_seq) <= len(rooms)
    assert P.pack_documents(_docs(spark, []), BYTE, end_id=0).count() == 0


def test_packer_is_near_the_bound():
    rng = random.Random(9)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, int(rng.lognormvariate(6, 1)) + 1)] += 1
    plan = P.pack(dict(counts), 2048)
    used = defaultdict(int)
    for c, k in plan:
        assert sum(c) <= 2048
        for length in c:
            used[length] += k
    assert dict(used) == dict(counts)
    assert sum(k for _, k in plan) <= 1.005 * sum(a * b for a, b in counts.items()) / 2048 + 1


def test_sharding_law_slots_and_odd_rows(spark):
    texts = ODD + ["same"] * 400
    df = _docs(spark, texts, shard=1).unionByName(spark.createDataFrame([(None, "x", 1), (3, "again", 1)],
                                                                        "doc_id long, text string, shard int"))
    got = H.shards(df, 40).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got) and any(r["grown_shard"] == 40 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None and r["doc_id"] < len(ODD) and r["doc_id"] != 3:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    assert H.shards(df.where("false"), 40).count() == 0


def test_weights_move_rows_only_into_the_heavier_subtree(spark):
    light, heavy = H.layout(16), H.layout(16, weights={3: 2.0})
    df = spark.range(4000).select(H.shard_of(F.col("id"), light).alias("a"), H.shard_of(F.col("id"), heavy).alias("b"))
    moved = df.where("a != b").collect()
    assert moved and all(r["b"] // 8 == 0 for r in moved)  # region of shard 3
    counts = {r["a"]: r["count"] for r in df.groupBy("a").count().collect()}
    assert min(counts.values()) > 150 and max(counts.values()) < 350
