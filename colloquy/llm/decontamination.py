"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of m characters with an error budget of k edits is split into
k + 1 pieces: a passage within k edits of the item leaves at least one piece
untouched. All pieces of a block of items form one Aho-Corasick automaton; a
document's text runs through it once, and each exact piece hit names a place
where the item may stand. The place, k characters wider on both sides, is
verified with Myers' bit-parallel distance (any alignment within the window),
so no passage within the budget is missed and none beyond it is reported.

Texts and items are compared lower-cased, with every run of characters that
are neither letters nor digits as one space. k is ``max_error_rate`` of the
item's length, rounded down. A passage must begin and end at word ends when
k is 0, which concerns items of under 20 characters.

The benchmark is the query set: items are handed to the tasks in blocks of at
most ``BLOCK_CHARS`` characters, one pass over the documents per block. With
more than one block the documents are numbered and written once; each pass
writes the hits it found by number and gives its block back before the next,
so driver and workers hold one block's items and automaton at a time.

Item ids may be of any type; they are carried, never compared with each other
but to sort a document's hits: nulls first, then by id and distance.

Defined results: null and empty items match nothing; items of equal text and
items under one id (null or repeated) are all reported, each by itself; null and empty documents match nothing; repeated rows are judged
each; an empty benchmark leaves every document clean.
"""

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import pick, ship_package, stored, unused

MAX_ERROR_RATE = 0.05
BLOCK_CHARS = 4 << 20

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(start, piece) of k + 1 pieces of nearly equal length."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers_distance(pattern: str, text: str) -> int:
    """Smallest edit distance between the pattern and any stretch of the text.

    One bit per character of the pattern in Python's long integers: the
    vertical differences of a column of the table are two bit vectors, and a
    text character moves them on with a few additions and shifts.
    """
    m = len(pattern)
    if not m:
        return 0
    mask, last = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up) & mask
        minus = up & diagonal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        # free start in the text: a zero is shifted into the first row
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up = minus | ~(diagonal | plus) & mask
        down = plus & diagonal
        best = min(best, score)
    return best


class Matcher:
    """Finds the items of a block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], max_error_rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * max_error_rate)) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for start, piece in pieces(t, k):
                found.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.found = bool(found)

    def _stands(self, text: str, start: int, n: int) -> bool:
        """With no errors allowed: the item itself, as whole words."""
        _, item, _ = self.items[n]
        end = start + len(item)
        return (start >= 0 and text.startswith(item, start) and (start == 0 or text[start - 1] == " ")
                and (end == len(text) or text[end] == " "))

    def match(self, text: str) -> list[tuple]:
        """(item id, distance) of the items in a text, one for each, by id (nulls first) and distance."""
        if not text or not self.found:
            return []
        places: dict[int, set[int]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for n, start in uses:
                places.setdefault(n, set()).add(end + 1 - length - start)
        out: list[tuple] = []
        for n, starts in places.items():
            identity, item, k = self.items[n]
            if k == 0:
                if any(self._stands(text, s, n) for s in starts):
                    out.append((identity, 0))
                continue
            best = k + 1
            for a, b in _windows(sorted(starts), len(item), k, len(text)):
                if item in text[a:b]:
                    best = 0
                    break
                best = min(best, myers_distance(item, text[a:b]))
            if best <= k:
                out.append((identity, best))
        return sorted(out, key=_by_id)


def _by_id(hit: tuple) -> tuple:
    identity, distance = hit
    return (False, distance) if identity is None else (True, identity, distance)


def _windows(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold the item wherever it may start, joined where they overlap."""
    a = b = -1
    for s in starts:
        lo, hi = max(0, s - k), min(n, s + m + k)
        if lo > b:
            if b >= 0:
                yield a, b
            a, b = lo, hi
        b = max(b, hi)
    if b >= 0:
        yield a, b


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalised, in blocks of bounded size."""
    block, size = [], 0
    for identity, text in pick(benchmark, i=id_col, t=text_col).toLocalIterator():
        text = normal(text)
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((identity, text))
        size += len(text)
    yield block


def _hits_type(benchmark: DataFrame, id_col: str = "item_id") -> str:
    return f"array<struct<item_id: {benchmark.schema[id_col].dataType.simpleString()}, distance: long>>"


def matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            max_error_rate: float = MAX_ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, ``contaminated``, ``n_items``, ``item_ids`` and the items with their distances."""
    docs = pick(documents, doc_id=id_col, text=text_col)
    found = with_hits(docs, benchmark, "text", "hits", max_error_rate, block_chars)
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
                        F.col("hits.item_id").alias("item_ids"), "hits")


def with_hits(documents: DataFrame, benchmark: DataFrame, text_col: str, out: str,
              max_error_rate: float = MAX_ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with a column of the benchmark items they hold."""
    spark = documents.sparkSession
    ship_package(spark)
    rest, kind = blocks(benchmark, block_chars=block_chars), _hits_type(benchmark)  # each bounded by block_chars
    row, block, hits = unused(documents, "row", "block", "hits")
    items, after = next(rest), next(rest, None)
    if after is None:
        return documents.withColumn(out, _finder(spark.sparkContext.broadcast(items), kind, max_error_rate)(F.col(text_col)))
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    passes = []
    while items is not None:
        sent = spark.sparkContext.broadcast(items)
        found = numbered.select(row, F.lit(len(passes)).alias(block),
                                _finder(sent, kind, max_error_rate)(F.col(text_col)).alias(hits))
        passes.append(stored(found.where(F.size(hits) > 0), "block-hits"))
        sent.destroy()
        items, after = after, next(rest, None)
    merged = reduce(DataFrame.unionAll, passes).groupBy(row).agg(
        F.array_sort(F.flatten(F.collect_list(hits))).alias(out))
    return numbered.join(merged, row, "left").drop(row).withColumn(
        out, F.coalesce(out, F.array().cast(kind)))


def _finder(sent, kind: str, max_error_rate: float):
    @F.pandas_udf(kind)
    def find(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, max_error_rate)
        for texts in it:
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in matcher.match(normal(t))] for t in texts])

    return find


def remove(documents: DataFrame, benchmark: DataFrame, text_col: str = "text",
           max_error_rate: float = MAX_ERROR_RATE) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    hits, = unused(documents, "hits")
    found = with_hits(documents, benchmark, text_col, hits, max_error_rate)
    return found.where(F.size(hits) == 0).drop(hits)
