"""Audit of how filters interact: what each filter removes in every order of application.

Each document has a mask of the filters it fails. What becomes of a document
at each step of each order depends on the mask alone, so every mask is mapped
to one wide integer: it has a 64-bit field for each (order, step, outcome),
120 orders x 5 steps = 600 steps of a table, and a field is 1 where a document with that mask has
that outcome. The integer of a group of documents is the sum of their
integers. Tasks count masks by part and multiply, so a task gives one integer
per part; these are added up by part, first within salts, and unpacked at the end.
A field counts documents, so it cannot overflow into the next below 2**64 rows.

Outcomes of a step with filter X: ``kept`` (no filter so far fails),
``removed`` (fails X and none before), ``redundant`` (fails X, removed before),
``unique_fails`` (fails X only), and, of those removed, ``good_lost`` and
``toxic_lost``. ``shapley`` is the sum of X's removals over all orders.

Filters (words are maximal runs of ``[^\\x20\\x09-\\x0D]``):

* A: under 200 words,
* B: fewer distinct words (case counts) than half of the words,
* C: more than 2 % of the code points are A-Z,
* D: holds one of ``#$%&*|``,
* E: identical to the text of any smaller id, table-wide.

E compares 128-bit digests: the smallest id of each text that occurs twice is
found by an aggregation that combines before the shuffle and joined back to
narrow rows (digest, id, mask); AQE splits the rows of a text that is most of them.

Defined results: a null text is empty (no words: it fails A, and E if a
smaller id has none either); a null part is the empty string; a document is
good or toxic if any of its label rows says so, repeated label rows count
once; documents without labels are neither; repeated rows are counted each, and rows under one
id never make each other fail E; a null id is not smaller than any other, has no smaller one
and no labels; an empty table gives an empty table. Ids may be of any type that has an order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, batches, pick, stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SALTS = 16
MAX_PARTS = 256  # parts that a task counts before it gives their sums

_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_FIELD_BYTES = 8


def orders() -> list[tuple[int, ...]]:
    return list(permutations(range(len(FILTERS))))


def mask_of(text: str | None) -> tuple[int, bytes]:
    """(bits of the failed filters A to D, digest) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()  # at the same ASCII white space
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    failed = (n < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * n,
              100 * capitals > CAPITALS_PERCENT * len(text or ""), len(raw.translate(None, _MARKS)) < len(raw))
    return sum(f << i for i, f in enumerate(failed)), hashlib.blake2b(raw, digest_size=16).digest()


@lru_cache(None)
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The integer whose 64-bit fields hold the outcomes of a document at all steps of all orders."""
    fields = []
    for order in orders():
        gone = False
        for f in order:
            fails = bool(mask >> f & 1)
            removed = fails and not gone
            redundant = fails and gone
            gone |= fails
            fields += [not gone, removed, redundant, mask == 1 << f, removed and good, removed and toxic]
    return int.from_bytes(np.array(fields, dtype="<u8").tobytes(), "little")


def unpack(total: int) -> np.ndarray:
    """Counts by (order, step, field)."""
    shape = (len(orders()), len(FILTERS), len(FIELDS))
    return np.frombuffer(total.to_bytes(int(np.prod(shape)) * _FIELD_BYTES, "little"), dtype="<u8").reshape(shape)


def masked(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: doc_id, part, mask (bit i: fails filter i of A to E)."""
    docs = pick(documents, doc_id=id_col, text=text_col, part=F.coalesce(documents[part_col].cast("string"), F.lit("")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(it):
        for b in batches(it):
            masks, digests = zip(*map(mask_of, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "part", "mask", "digest"])

    rows = stored(arrow_map(docs, measure, f"doc_id {kind}, part string, mask int, digest binary"), "masks")
    firsts = rows.where("doc_id IS NOT NULL").groupBy(F.col("digest").alias("d")).agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = stored(firsts, "first-ids")
    copied = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return rows.join(firsts, rows["digest"] == firsts["d"], "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(copied, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def _partial_sums(it):
    """Count masks by part, then give a packed integer for each part."""
    counts: dict[str, Counter] = {}

    def given():
        parts = list(counts)
        sums = [sum(packed(*key) * n for key, n in counts[p].items()) for p in parts]
        raws = [s.to_bytes((s.bit_length() + 7) // 8, "little") for s in sums]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(raws, pa.binary())], ["part", "total"])

    for b in it:
        for part, *key in zip(*(b.column(c).to_pylist() for c in ("part", "mask", "good", "toxic"))):
            if part not in counts and len(counts) >= MAX_PARTS:
                yield given()
            counts.setdefault(part, Counter())[tuple(key)] += 1
    if counts:
        yield given()


def _added(it):
    """Add up integers that stand one part after another."""
    part, total = None, 0

    def given():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.string()),
                                           pa.array([total.to_bytes((total.bit_length() + 7) // 8, "little")], pa.binary())],
                                          ["part", "total"])

    for b in it:
        for p, raw in zip(b.column("part").to_pylist(), b.column("total").to_pylist()):
            if part is not None and p != part:
                yield given()
                total = 0
            part, total = p, total + int.from_bytes(raw, "little")
    if part is not None:
        yield given()


def _rows(it):
    names = [tuple(FILTERS[f] for f in order) for order in orders()]
    shape = len(names), len(FILTERS)
    which = np.array(orders())
    order_name = np.repeat(["".join(n) for n in names], shape[1])
    steps = np.tile(np.arange(1, shape[1] + 1), shape[0])
    for b in it:
        for part, raw in zip(b.column("part").to_pylist(), b.column("total").to_pylist()):
            counts = unpack(int.from_bytes(raw, "little")).astype(np.int64)
            removed = np.zeros(len(FILTERS), dtype=np.int64)
            np.add.at(removed, which, counts[:, :, FIELDS.index("removed")])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * steps.size, pa.string()), pa.array(order_name.tolist(), pa.string()), pa.array(steps, pa.int32()),
                 *(pa.array(counts[:, :, i].reshape(-1)) for i in range(len(FIELDS))), pa.array(removed[which].reshape(-1))],
                ["part", "filter_order", "step", *FIELDS, "shapley"])


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per part, order and step: the counts of ``FIELDS`` and ``shapley``."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    docs = masked(documents, id_col, text_col, part_col)
    with_marks = docs.join(marks, docs["doc_id"] == marks["id"], "left").select(
        "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    sums = stored(arrow_map(with_marks, _partial_sums, "part string, total binary"), "part-sums")
    salted = sums.withColumn("salt", F.pmod(F.xxhash64("total"), F.lit(SALTS))).repartition("part", "salt")
    once = arrow_map(salted.sortWithinPartitions("part").select("part", "total"), _added, "part string, total binary")
    total = arrow_map(once.repartition("part").sortWithinPartitions("part"), _added, "part string, total binary")
    counts = ", ".join(f"{c} long" for c in (*FIELDS, "shapley"))
    return arrow_map(total, _rows, f"part string, filter_order string, step int, {counts}")
