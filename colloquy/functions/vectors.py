"""Dense-vector column functions over ``array<double>`` (or float) columns.

Spark 4.1 has no built-in vector similarity, so these are higher-order
functions over arrays; they stay inside the JVM and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def sq_dist(a, b) -> Column:
    diffs = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def euclid(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def normalize(a) -> Column:
    """Unit-length copy; the zero vector stays zero.

    The norm is handed to the lambda as an argument (``array_repeat``) so it
    is computed once per row, not once per element.
    """
    arr = as_double_array(a)
    n = norm(arr)
    return F.zip_with(arr, F.array_repeat(n, F.size(arr)),
                      lambda x, m: F.when(m == 0, F.lit(0.0)).otherwise(x / m))


def entailment_score(contradiction, entailment) -> Column:
    """exp(e) / (exp(c) + exp(e)) written as 1 / (1 + exp(c - e)): no overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(contradiction) - _c(entailment)))
