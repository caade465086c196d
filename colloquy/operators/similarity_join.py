"""Exact cosine join of sparse vectors above a bar.

Vectors are rows (key, term, w) of unit length per key. Terms are numbered and
every vector is packed into a row. Rows are dealt to a bounded number of parts,
every pair of parts is one task (see ``blocks``), so a row is copied to as many tasks as there are parts and
only pairs that reach the bar leave a task. Inside a task, terms that many rows
hold are multiplied as a dense matrix, the others term by term where both rows hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import tokens
from colloquy.operators.blocks import deal, part_pairs, sides
from colloquy.session import ship_package, stored

LIST_BLOCK = 500  # rows of a tile
DENSE_SHARE = 0.03  # terms that so many of a task's rows hold are columns of a dense matrix
CELLS = 4_000_000  # products held at a time
PLACES = 9  # decimals to which a product is compared with the bar


def term_vectors(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term, w): term counts of each text, of unit length; a text without terms has no rows."""
    counts = df.select(key, F.explode(tokens(text_col)).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    size = Window.partitionBy(key)  # the distinct terms of one text
    return counts.select(key, "term", (F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(size))).alias("w"))


def _numbers(lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all entries of a column of lists."""
    arr = lists.combine_chunks()
    return np.repeat(np.arange(len(arr)), arr.value_lengths().to_numpy()), arr.flatten().to_numpy()


def _similar(low: float):
    def fn(key: tuple, table: pa.Table) -> pa.Table:
        two = sides(key, table, ["_row"])
        if not two:
            two = [table.slice(0, 0)]
        rows, terms, w = [], [], []
        for t in two:
            r, x = _numbers(t["_terms"])
            rows.append(r), terms.append(x), w.append(_numbers(t["_ws"])[1])
        n, m = len(two[0]), len(two[-1])
        every, held = np.unique(np.concatenate(terms), return_counts=True)
        often = every[held >= DENSE_SHARE * (len(table) if len(two) > 1 else n)]

        def split(r, x, v, size):
            place = np.searchsorted(often, x)
            frequent = (place < len(often)) & (often[np.minimum(place, len(often) - 1)] == x) if len(often) else np.zeros(len(x), bool)
            dense = np.zeros((size, len(often)))
            np.add.at(dense, (r[frequent], place[frequent]), v[frequent])
            return dense, r[~frequent], x[~frequent], v[~frequent]

        parts = [split(r, x, v, len(t)) for r, x, v, t in zip(rows, terms, w, two)]
        (left, lr, lx, lw), (right, rr, rx, rw) = parts[0], parts[-1]
        order = np.argsort(rx, kind="stable")
        rr, rx, rw = rr[order], rx[order], rw[order]
        right = np.ascontiguousarray(right.T)
        step = max(1, min(512, CELLS // max(m, 1)))
        out = []
        for at in range(0, n, step):
            to = min(at + step, n)
            S = left[at:to] @ right
            a, b = np.searchsorted(lr, (at, to))
            start, end = np.searchsorted(rx, lx[a:b], "left"), np.searchsorted(rx, lx[a:b], "right")
            met = end - start
            for x, y in _pieces(met, CELLS):
                some = met[x:y]
                inner = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(start[x:y], some)
                cell = np.repeat((lr[a + x:a + y] - at) * m, some) + rr[inner]
                np.add.at(S.reshape(-1), cell, np.repeat(lw[a + x:a + y], some) * rw[inner])
            i, j = np.nonzero(S >= low)
            if len(two) == 1:
                i, j = i[i + at < j], j[i + at < j]
            out.append((i + at, j, S[i, j]))
        i, j, s = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))
        ids = [t["_id"].combine_chunks() for t in two]
        return pa.table([ids[0].take(pa.array(i)), ids[-1].take(pa.array(j)), pa.array(s, pa.float64())], names=["x", "y", "similarity"])
    return fn


def _pieces(sizes: np.ndarray, most: int):
    """Bounds of runs of sizes that come to about ``most``."""
    if len(sizes):
        cut = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)])


def cosine_pairs(vectors: DataFrame, key: str, bar: float) -> DataFrame:
    """(key_a, key_b, similarity) of all pairs key_a < key_b with a cosine of ``bar`` or more."""
    ship_package(vectors.sparkSession)
    vecs = stored(vectors.select(F.col(key).alias("k"), "term", "w").where("k IS NOT NULL"), "vectors")
    terms = stored(vecs.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    rows = vecs.join(terms, "term").groupBy(F.col("k").alias("_id")).agg(F.collect_list(F.struct("t", "w")).alias("_e"))
    rows = stored(rows.select("_id", F.lit(0).alias("_g"), F.col("_e.t").alias("_terms"), F.col("_e.w").alias("_ws"),
                              F.monotonically_increasing_id().alias("_row")), "rows")
    kind = rows.schema["_id"].dataType.simpleString()
    pairs = part_pairs(*deal(rows, ["_g"], LIST_BLOCK), ["_g"]).groupBy("_g", "_a", "_b").applyInArrow(
        _similar(bar - 1e-6), f"x {kind}, y {kind}, similarity double")  # room for rounding
    return pairs.where(F.round("similarity", PLACES) >= bar).select(
        F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "similarity")
