"""The pipeline's stages and its result on planted documents, against plain versions."""
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from colloquy.llm import toxicity as T

SF = "/root/testdata/sf0.001"
_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, measures int, part string"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    out = pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() == before


def test_registered(spark):
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def _planted():
    """(documents, labels, benchmark, {kind: ids})."""
    rng = random.Random(12)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    slurs = ["grobnik", "wazzlor", "skrunt", "fleebo"]
    kinds, docs = {}, []

    def add(kind, text):
        kinds.setdefault(kind, []).append(len(docs))
        docs.append(text)

    for _ in range(220):
        add("clean", say(rng.randint(40, 200)))
    for _ in range(60):
        text = say(rng.randint(40, 120)).split()
        for _ in range(len(text) // 8):
            text.insert(rng.randrange(len(text)), rng.choice(slurs))
        add("toxic", " ".join(text))
    add("junk", None)
    add("junk", "")
    add("junk", "too short")
    add("junk", "same eight words that are said over again " * 12)
    add("junk", say(60) + " $$$ %%% &&&" * 12)
    add("junk", "\n".join(["the same line"] * 5 + [say(40)]))
    benchmark = [say(40) for _ in range(6)]
    for i, item in enumerate(benchmark):
        broken = list(item)
        for k in range(i):
            broken[11 + 17 * k] = "#"
        add("leak", say(50) + " " + "".join(broken) + " " + say(30))
    for i in range(12):
        base = docs[i].split()
        if i % 2:
            base[-1] = "changed"
        add("copy", " ".join(base))
    ids = {k: [100 + i for i in v] for k, v in kinds.items()}
    rows = [(100 + i, t, "en", f"s{i % 4}", 0, "x", 1, "y") for i, t in enumerate(docs)]
    labels = [(100 + i, 1, int(i in kinds["toxic"])) for i in range(len(docs)) if i % 7]
    return rows, labels, list(enumerate(benchmark)), ids


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def _pieces(docs):
    """(doc_id, piece, start, length, crc) by plain encode."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return sorted(out)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rows, labels, benchmark, ids = _planted()
    spark.createDataFrame(rows, _SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, ids


def test_planted_documents_stage_by_stage(spark, planted):
    folder, rows, ids = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r[0]: r[1] for r in rows}
    stages = dict(pipeline.STAGES)

    def kept(df):
        assert df.columns == columns
        out = df.collect()
        assert all(r["text"] == texts[r["doc_id"]] and r["hits"] == "x" and r["part"] == "y" for r in out)
        return {r["doc_id"] for r in out}

    everything = set(texts)
    assert kept(stages["quality_rules"](spark, docs, folder)) == everything - set(ids["junk"])
    docs = docs.where(~F.col("doc_id").isin(ids["junk"]))
    calm = kept(stages["toxicity"](spark, docs, folder))
    model = T.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert calm == {r["doc_id"] for r in T.score(docs, model).collect() if r["score"] < 0.5}
    assert calm == everything - set(ids["junk"]) - set(ids["toxic"])
    docs = docs.where(~F.col("doc_id").isin(ids["toxic"]))
    # copies: components by brute force
    sets, first = {i: _shingles(texts[i]) for i in sorted(calm)}, {}
    for i, s in sets.items():
        near = [j for j in first if 100 * len(s & sets[j]) >= 80 * len(s | sets[j])]
        low = min([i, *(first[j] for j in near)])
        for j in [k for k in first if first[k] in {first[x] for x in near}]:
            first[j] = low
        first[i] = low
    single = {i for i in first if first[i] == i}
    assert calm - single == set(ids["copy"])
    assert kept(stages["jaccard_join"](spark, docs, folder)) == single
    docs = docs.where(F.col("doc_id").isin(sorted(single)))
    assert kept(stages["decontamination"](spark, docs, folder)) == single - set(ids["leak"])


def test_planted_documents_through_run(spark, planted):
    folder, rows, ids = planted
    out = pipeline.run(spark, folder).collect()
    left = [(r[0], r[1]) for r in rows if r[0] in set(ids["clean"])]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == _pieces(left)
    places = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places.get(r["sequence_id"], 0)
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 2048
    assert len(places) <= -(-sum(places.values()) // 2048) + 2


def test_stages_on_empty_and_odd_tables(spark, planted):
    folder, rows, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "x" * 100_000, None, None, 1, None, None, None),
                                 (1, "x" * 100_000, None, None, 1, None, None, None)], _SCHEMA)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns, name
    assert pipeline.STAGES[-1][1](spark, odd, folder).count() >= 3
