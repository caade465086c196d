"""All pairs of points within each group, dealt to few tasks that each hold a bounded part of it.

A group's points are hashed by id into tiles of about ``tile`` points, and the
tiles into parts. Every unordered pair of parts is one task; a point is copied
to as many tasks as its group has parts, ``PARTS`` at most until a part would
exceed ``PART_POINTS``, so what is shuffled grows with the points and not with
their square. Inside a task distances are made in blocks of ``ROWS`` x ``COLUMNS``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.joins import join_small

PARTS = 16
PART_POINTS = 65_536
TASKS = 8  # a core
ROWS, COLUMNS = 512, 1024


def deal(points: DataFrame, keys: list[str], tile: int, even: bool = False) -> tuple[DataFrame, int]:
    """Points (keys..., _id, ...) with their ``_tile``, ``_part`` and number of parts ``_parts``; pairs of parts in all.

    Equal ids share a tile. Groups with a null key are left out. ``even``: a group has only as many parts as
    make its tasks no longer than an even share of all the work, so the points of many groups are copied less.
    """
    n = F.count(F.lit(1))
    sizes = points.groupBy(*keys).agg(F.ceil(n / F.lit(tile)).cast("int").alias("_m"), n.alias("_n"))
    least = F.ceil(F.col("_n") / F.lit(PART_POINTS))
    most = F.greatest(F.lit(PARTS), least).cast("int")
    if even:
        sizes = sizes.persist()
        share = (sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 1.0) / TASKS / points.sparkSession.sparkContext.defaultParallelism
        most = F.least(most, F.greatest(least, F.ceil(F.col("_n") / F.lit(share ** 0.5))).cast("int"))
    sizes = sizes.select(*keys, "_m", F.least("_m", most).alias("_parts")).persist()
    pairs = sizes.agg(F.sum(F.col("_parts") * (F.col("_parts") + 1) / 2)).first()[0]
    dealt = join_small(points, sizes, on=keys, small_rows=sizes.count())
    dealt = dealt.withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_m")).cast("int"))
    return dealt.withColumn("_part", F.pmod("_tile", "_parts")).drop("_m"), int(pairs or 0)


def part_pairs(dealt: DataFrame, pairs: int, keys: list[str]) -> DataFrame:
    """Dealt points copied to every unordered pair (``_a`` <= ``_b``) of parts that theirs is part of.

    The number of tasks follows the pairs, not the bytes: a pair is much work for its size.
    """
    cores = dealt.sparkSession.sparkContext.defaultParallelism  # the copies are made by all of them, however few files hold the points
    copies = dealt.repartition(cores).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    copies = copies.withColumn("_a", F.least("_part", "_other")).withColumn("_b", F.greatest("_part", "_other"))
    return copies.drop("_other").repartition(max(1, min(TASKS * cores, 2 * pairs)), *keys, "_a", "_b")


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix; other lengths are an error."""
    arr = vectors.combine_chunks()
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1).astype(np.float64, copy=False)


def tiled(n: int, step: int):
    """Bounds of the runs of ``step`` rows among n."""
    return ((at, min(at + step, n)) for at in range(0, n, step))


def blocks(left: int, right: int, rows: int = ROWS, columns: int = COLUMNS):
    """Slices of rows and columns that cover a left x right matrix, ascending."""
    for i, to in tiled(left, rows):
        for j, end in tiled(right, columns):
            yield slice(i, to), slice(j, end)


def codes(values: pa.Array) -> np.ndarray:
    """A number for each different value, -1 for null; values of any type."""
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class Smallest:
    """The k smallest (value, id) of every row, found in blocks of values.

    Blocks of a row come in ascending order of id, so a later value must be smaller than the
    k-th so far: ``limit`` of a block's rows is the bound up to which its values are looked at.
    """

    NONE = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int, most: float = np.inf):
        self.k, self.most = k, most
        self.value, self.id = np.full((n, k), np.inf), np.full((n, k), self.NONE)

    def last(self, rows: slice) -> np.ndarray:
        """The k-th value so far; infinite where fewer were found."""
        return self.value[rows, -1]

    def take(self, rows: slice, block: np.ndarray, limit: np.ndarray, slack: float, exact, ids: np.ndarray, turned: bool = False) -> None:
        """Look at a block (rows x ids, or ids x rows if ``turned``) whose values are right to within ``slack``.

        ``exact(i, j)`` gives the final values of some of its places.
        """
        k, axis = self.k, 0 if turned else 1
        bound = lambda x: x[None, :] if turned else x[:, None]
        near = block <= bound(limit)
        n = np.count_nonzero(near)
        if n > 4 * k * len(limit) and block.shape[axis] > k:
            kth = np.partition(block, k - 1, axis=axis).take(k - 1, axis=axis)
            near = block <= bound(np.minimum(limit, kth + slack))
        elif not n:
            return
        i, j = np.nonzero(near)
        value = exact(i, j)
        row, other = (j, ids[i]) if turned else (i, ids[j])
        kept = value <= self.most
        row, value, other = row[kept], value[kept], other[kept]
        some, at = np.unique(row, return_inverse=True)
        where = some + rows.start
        at = np.concatenate([np.repeat(np.arange(len(some)), k), at])
        value = np.concatenate([self.value[where].reshape(-1), value])
        other = np.concatenate([self.id[where].reshape(-1), other])
        order = np.lexsort((other, value, at))
        first = np.searchsorted(at[order], np.arange(len(some)))
        best = order[(first[:, None] + np.arange(k)).reshape(-1)]
        self.value[where], self.id[where] = value[best].reshape(-1, k), other[best].reshape(-1, k)


def sides(key: tuple, table: pa.Table, order: list[str]) -> list[pa.Table]:
    """The rows of both parts of a pair, sorted; one side for a part with itself, none if one is empty."""
    table = table.sort_by([(c, "ascending") for c in order])
    part = table["_part"].to_numpy()
    two = [table.filter(pa.array(part == p)) for p in dict.fromkeys(x.as_py() for x in key[-2:])]
    return two if all(len(x) for x in two) else []
