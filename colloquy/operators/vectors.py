"""Vector aggregates and transforms over (group, item, vector) rows.

Per-dimension statistics are computed in long form (``posexplode`` then a
grouped aggregate with partial aggregation), so a hot group is summed across
all tasks before its single small result row is shuffled. Per-group results
(<= dim values each) are folded back into arrays and joined to the items with
``join_small`` (broadcast only under a counted row bound).
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import spaced_tokens
from colloquy.functions.text import tokens as tokens_col
from colloquy.functions.vectors import as_double_array, sq_dist
from colloquy.operators.joins import join_small
from colloquy.session import stored


def explode_dims(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """(keys..., dim, x) rows; x as double."""
    return df.select(*keys, F.posexplode(as_double_array(vec_col)).alias("dim", "x"))


def fold_dims(long: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Long (keys, dim, value) -> (keys, out array<double>) in dim order."""
    agg = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", value))).alias("_a"))
    return agg.select(*keys, F.transform("_a", lambda s: s[value]).alias(out))


def mean_long(df: DataFrame, group_cols: list[str], vec_col: str) -> DataFrame:
    """Element-wise mean per group as (group, dim, value)."""
    return (explode_dims(df, group_cols, vec_col).groupBy(*group_cols, "dim")
            .agg(F.avg("x").alias("value")))


BINS = 1024
FEW_VALUES = 100_000  # rows of a key that are counted value by value


def exact_median(df: DataFrame, keys: list[str], value_col: str, few: int = FEW_VALUES, bins: int = BINS,
                 out: str = "value") -> DataFrame:
    """Exact median per key (mean of the two middle values), by counted passes.

    A key's rows between ``lo`` and ``hi`` hold both middle ranks. While they
    are more than ``few``, a pass counts them in ``bins`` equal ranges, with
    the smallest and largest value of each, and goes on with the ranges that the ranks fall into; the state of a
    pass is a row per key and bin. The last pass counts the values that are
    left. If the ranks part between two bins, they are the largest value of one and the smallest of the other.
    Infinite values have bins of their own.
    Null and NaN are left out. A rank that is not found is an error.
    """
    x = F.col(value_col).cast("double")
    base = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    state = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    state = stored(state.select(*keys, "_lo", "_hi", F.floor((F.col("_n") + 1) / 2).alias("_r1"), (F.floor(F.col("_n") / 2) + 1).alias("_r2"),
                                F.col("_n").alias("_inside"), F.lit(0).cast("long").alias("_below"),
                                F.lit(None).cast("double").alias("_median")), "ranks")
    names = [F.struct(*(F.col(k) for k in keys)).alias("_key")]
    base = base.select(*names, "_x")
    state = state.select(*names, "_lo", "_hi", "_r1", "_r2", "_inside", "_below", "_median")
    found = []
    while True:
        wide = (F.col("_inside") > few) & (F.col("_lo") < F.col("_hi")) & F.col("_median").isNull()
        found.append(state.where(~wide))
        state = state.where(wide)
        if state.isEmpty():
            break
        state = stored(_narrowed(base, state, bins), "ranks")
    done = reduce(DataFrame.unionByName, found)
    parted = done.where("_median IS NOT NULL").select("_key.*", F.col("_median").alias(out))
    done = done.where("_median IS NULL")
    values = join_small(base, done, on=["_key"]).where(F.col("_x").between(F.col("_lo"), F.col("_hi"))).groupBy("_key", "_x").agg(
        F.count(F.lit(1)).alias("_c"), *(F.first(c).alias(c) for c in ("_below", "_r1", "_r2")))
    upto = Window.partitionBy("_key").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("_cum", F.col("_below") + F.sum("_c").over(upto))
    pick = [F.min(F.when(F.col("_cum") >= F.col(r), F.col("_x"))) for r in ("_r1", "_r2")]
    agg = values.groupBy("_key").agg(*(p.alias(f"_m{i}") for i, p in enumerate(pick)))
    middle = (F.col("_m0") + F.col("_m1")) / 2
    return agg.select("_key.*", F.when(middle.isNull(), F.raise_error(F.lit("a middle rank was not found")).cast("double"))
                      .otherwise(middle).alias(out)).unionByName(parted)


def _narrowed(base: DataFrame, state: DataFrame, bins: int) -> DataFrame:
    """The state with each key's bounds moved to the bins that its middle ranks fall into."""
    low, high, infinite = F.col("_lo"), F.col("_hi"), F.lit(float("inf"))
    inner = join_small(base, state, on=["_key"]).where(F.col("_x").between(low, high))
    # infinite bounds: the finite range is not known yet, so they are only split off
    spread = (F.col("_x") / 2 - low / 2) / (high / 2 - low / 2) * bins
    rank = F.when(F.col("_x") == -infinite, F.lit(-1)).when(F.col("_x") == infinite, F.lit(bins + 1)).when(
        (low == -infinite) | (high == infinite), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor(spread))).cast("int")
    counts = inner.groupBy("_key", rank.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
        *(F.first(c).alias(c) for c in ("_below", "_r1", "_r2")))
    upto = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per bin
    counts = counts.withColumn("_cum", F.col("_below") + F.sum("_c").over(upto))
    holds = [(F.col("_cum") >= F.col(r)) & (F.col("_cum") - F.col("_c") < F.col(r)) for r in ("_r1", "_r2")]
    hit = counts.where(holds[0] | holds[1])
    return hit.groupBy("_key").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.first("_r1").alias("_r1"), F.first("_r2").alias("_r2"),
                                   F.sum("_c").alias("_inside"), F.min(F.col("_cum") - F.col("_c")).alias("_below"),
                                   F.when(F.count(F.lit(1)) == 2, (F.min("_hi") + F.max("_lo")) / 2).alias("_median"))


def median_long(df: DataFrame, group_cols: list[str], vec_col: str) -> DataFrame:
    """Element-wise exact median per group (mean of the two middle values)."""
    return exact_median(explode_dims(df, group_cols, vec_col), [*group_cols, "dim"], "x")


def mean_vectors(df: DataFrame, group_cols: list[str], vec_col: str, out: str = "mean_vec") -> DataFrame:
    return fold_dims(mean_long(df, group_cols, vec_col), group_cols, "value", out)


def median_vectors(df: DataFrame, group_cols: list[str], vec_col: str, out: str = "median_vec") -> DataFrame:
    return fold_dims(median_long(df, group_cols, vec_col), group_cols, "value", out)


def center_vectors(df: DataFrame, group_cols: list[str], vec_col: str, center: str = "median",
                   out: str = "center") -> DataFrame:
    if center == "median":
        return median_vectors(df, group_cols, vec_col, out)
    if center == "mean":
        return mean_vectors(df, group_cols, vec_col, out)
    raise ValueError("center must be 'median' or 'mean'")


def append_mean_row(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str,
                    flag: str = "is_mean") -> DataFrame:
    """The group's rows plus one row holding the group's mean vector (id null)."""
    means = mean_vectors(df, group_cols, vec_col, vec_col)
    items = df.select(*group_cols, id_col, as_double_array(vec_col).alias(vec_col)).withColumn(flag, F.lit(False))
    mrows = means.select(*group_cols, F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), vec_col,
                         F.lit(True).alias(flag))
    return items.unionByName(mrows)


def standardize(df: DataFrame, group_cols: list[str], vec_col: str, out: str | None = None) -> DataFrame:
    """(x - mean) / population std per group and dimension; zero std -> 1."""
    out = out or vec_col
    long = explode_dims(df, group_cols, vec_col).groupBy(*group_cols, "dim").agg(
        F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    long = long.withColumn("sd", F.when((F.col("sd") == 0) | F.col("sd").isNull(), F.lit(1.0)).otherwise(F.col("sd")))
    stats = (long.groupBy(*group_cols)
             .agg(F.array_sort(F.collect_list(F.struct("dim", "mu", "sd"))).alias("_st")))
    j = join_small(df, stats, on=group_cols, how="inner")
    z = F.zip_with(as_double_array(vec_col), F.col("_st"), lambda x, s: (x - s["mu"]) / s["sd"])
    return j.withColumn(out, z).drop("_st")


def medoid(df: DataFrame, group_cols: list[str], id_col: str, vec_col: str, center: str = "median") -> DataFrame:
    """Per group: the member closest (squared Euclidean) to the group centre.

    Ties (squared distances equal to 9 decimals) go to the smallest id. Returns (group..., medoid id, d2).
    """
    centers = center_vectors(df, group_cols, vec_col, center, "_center")
    j = join_small(df.select(*group_cols, id_col, vec_col), centers, on=group_cols)
    j = j.withColumn("_d2", sq_dist(vec_col, "_center"))
    best = F.min_by(F.struct(F.col(id_col).alias("id"), F.col("_d2").alias("d2")), F.struct(F.round("_d2", 9).alias("d2"), id_col))
    return j.groupBy(*group_cols).agg(best.alias("_b")).select(
        *group_cols, F.col("_b.id").alias(f"medoid_{id_col}"), F.col("_b.d2").alias("d2"))


# ---------------------------------------------------------------------------
# hashed bag-of-words embedding
# ---------------------------------------------------------------------------

def token_buckets(text_col: str, dim: int) -> Column:
    """Bucket of every token: first 8 hex digits of md5(token) as a number, mod dim."""
    return F.transform(tokens_col(text_col), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


def _unit_counts(buckets: pa.ListArray, dim: int, rows: int = 256) -> pa.ListArray:
    """Counts of the buckets of every row, of unit length, made for some rows at a time."""
    ends, flat = buckets.offsets.to_numpy(), buckets.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(buckets), dim), dtype=np.float64)
    for at in range(0, len(buckets), rows):
        some = ends[at:at + rows + 1]
        row = np.repeat(np.arange(len(some) - 1, dtype=np.int64) * dim, np.diff(some))
        counts = np.bincount(row + flat[some[0]:some[-1]], minlength=(len(some) - 1) * dim).reshape(-1, dim)
        norms = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
        out[at:at + rows] = counts / np.where(norms == 0, 1.0, norms)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * dim), pa.array(out.reshape(-1)))


def _buckets(texts: pa.Array, dim: int) -> pa.ListArray:
    """``token_buckets`` of texts whose tokens are parted by blanks; a token is hashed once for all texts."""
    lists = pc.split_pattern(texts, " ")
    words = lists.values.dictionary_encode()
    number = np.array([int.from_bytes(hashlib.md5(w).digest()[:4], "big") % dim if w else -1
                       for w in words.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int32)
    flat = number[words.indices.to_numpy()]
    before = np.concatenate([[0], np.cumsum(flat >= 0)])  # texts may begin or end with a blank
    return pa.ListArray.from_arrays(pa.array(before[lists.offsets.to_numpy()].astype(np.int32)), pa.array(flat[flat >= 0]))


def _bincount_udf(dim: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def bincount(texts: pa.Array) -> pa.Array:
        return _unit_counts(_buckets(texts, dim), dim)

    return bincount


def hash_embed(df: DataFrame, text_col: str, dim: int = 64, out: str = "vec") -> DataFrame:
    """L2-normalised hashed token counts per text (an embedder without weights).

    The JVM parts the tokens, as ``tokens`` does; Python hashes every different token of an Arrow batch
    once, as ``token_buckets`` does, and one vectorised ``bincount`` for some texts at a time builds the vectors.
    Explode the result with ``posexplode_outer``: the plain generator makes
    the optimizer add a size filter that re-runs the UDF.
    """
    return df.withColumn(out, _bincount_udf(dim)(spaced_tokens(text_col)))


# ---------------------------------------------------------------------------
# random-sign projection
# ---------------------------------------------------------------------------

def sign_matrix(in_dim: int, out_dim: int) -> list[list[float]]:
    """R[j][i] = +-1/sqrt(out_dim); the sign is from md5('i_j') (first hex digit < 8 -> +)."""
    scale = 1.0 / math.sqrt(out_dim)
    return [[(scale if hashlib.md5(f"{i}_{j}".encode()).hexdigest()[0] < "8" else -scale)
             for i in range(in_dim)] for j in range(out_dim)]


def _projected(vectors: pa.ListArray, R: np.ndarray, rows: int = 256) -> pa.ListArray:
    """Products of R with vectors, summed in the order of the dimensions; nulls for a vector that lacks or exceeds any of them."""
    out_dim, in_dim = R.shape
    lengths, flat = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), vectors.flatten()
    row = np.repeat(np.arange(len(vectors)), lengths)
    bad = lengths != in_dim
    bad[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    X = flat.filter(pa.array(~bad[row])).to_numpy(zero_copy_only=False).reshape(-1, in_dim)
    made = np.zeros((len(X), out_dim))
    for at in range(0, len(X), rows):
        for i in range(in_dim):
            made[at:at + rows] += X[at:at + rows, i, None] * R[:, i]
    out = np.zeros((len(vectors), out_dim))
    out[~bad] = made
    values = pa.array(out.reshape(-1), mask=np.repeat(bad, out_dim))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * np.int32(out_dim)), values)


def project(df: DataFrame, vec_col: str, in_dim: int, out_dim: int = 2, out: str = "proj") -> DataFrame:
    """Linear random-sign projection (the matrix goes along with the function)."""
    R = np.array(sign_matrix(in_dim, out_dim))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def projected(vectors: pa.Array) -> pa.Array:
        return _projected(vectors, R)

    return df.withColumn(out, projected(as_double_array(vec_col)))


def pca(df: DataFrame, vec_col: str, k: int = 2, out: str = "pca") -> DataFrame:
    """Principal components with Spark ML (distributed covariance)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(as_double_array(vec_col)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
