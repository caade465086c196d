"""Quality rules with host verdicts.

Every document is measured by counting rules; the failures of all documents
of a host (here the ``source`` column) are aggregated, the host's failure rate
is shrunk towards the rate of all hosts with an empirical beta prior, and the
verdict on the host is joined back to its documents. A small host with one bad
page is thus not condemned, a large host that mostly fails is.

Rules (a document fails one or more):

* ``short``: fewer than 20 words,
* ``repeats``: more than 30 % of its words lie in 8-word windows that occur
  twice or more in the text,
* ``symbols``: more symbols ``#*$%&|<>`` than one for every two words,
* ``lines``: more than 30 lines that repeat an earlier line, or one for every
  20 words,
* ``long_words``: more than 15 code points a word on average.

A document that fails any rule is not kept; ``base_failed`` says that it fails
``short`` or ``repeats``. All five count against the host, and of a rejected
host nothing is kept.

Prior: over the hosts, the mean m and variance v of the failure rates (each
host counts once) give strength s = m (1 - m) / v - 1, held within 1 .. 50
(50 where all hosts fail alike); the shrunk rate of a host with f failures
in n documents is (f + m s) / (n + s). The prior's deviation is
sqrt(m (1 - m) / (s + 1)). A host is rejected when its shrunk rate lies more
than ``deviations`` = 3 of them above m, or over ``max_rate`` = 0.6, where most
of what it holds is junk whatever the other hosts are like. The bound of 50
on the strength keeps the deviation at a seventh of sqrt(m (1 - m)) at least,
so hosts that differ by chance only are never far out.

Defined results: a null or empty text has no words, so it fails ``short``;
null hosts form one host of their own; repeated rows are measured each; an
empty table gives an empty table.
"""

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import any_of, arrow_map, batches, pick, ship_package, stored, unused

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_RATE = 0.6
DEVIATIONS = 3.0
PRIOR_STRENGTH = (1.0, 50.0)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; exact, by doubling.

    Equal pairs of words get equal numbers, then equal pairs of pairs, so
    after three steps equal numbers mean equal runs of eight words.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    size = 1
    while size < window:
        pairs = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        size *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:n]))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(map(len, _SYMBOLS.findall(text))), len(lines) - len(set(lines)),
            _repeated(words))


def _measure_batches(it):
    for b in batches(it):
        rows = [measure(t) for t in b.column("text").to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *cols], ["doc_id", "host", *MEASURES])


def rules(col=F.col) -> dict[str, Column]:
    """Failure of each rule as a boolean column over the measures."""
    n = col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
        "symbols": col("n_symbols") * 2 > n,
        "lines": (col("n_dup_lines") > 30) | (col("n_dup_lines") * 20 > n),
        "long_words": col("word_chars") > n * 15,
    }


def host_rates(measured: DataFrame, max_rate: float = MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """Per host: documents, failures of each rule, failing documents, shrunk rate, verdict.

    The sums combine before the shuffle, so a hot host is one row a task.
    """
    tests = rules()
    counts = [F.sum(c.cast("long")).alias(f"n_{k}") for k, c in tests.items()]
    hosts = stored(measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *counts, F.sum(any_of(list(tests.values())).cast("long")).alias("n_failing")),
        "hosts")
    rate = F.col("n_failing") / F.col("n_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row
    low, high = PRIOR_STRENGTH
    m = m if m is not None else 0.0
    s = min(high, max(low, m * (1 - m) / v - 1)) if v else high
    shrunk = (F.col("n_failing") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s))
    bar = min(max_rate, m + deviations * math.sqrt(m * (1 - m) / (s + 1)))
    return hosts.withColumn("rate", shrunk).withColumn("host_rejected", F.col("rate") > F.lit(bar))


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_rate: float = MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per document: its id, host, measures, ``base_failed``, ``host_rate`` and ``kept``."""
    narrow = pick(documents, doc_id=id_col, host=host_col, text=text_col)
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, host " \
             f"{narrow.schema['host'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = stored(arrow_map(narrow, _measure_batches, schema), "measures")
    hosts = host_rates(measured, max_rate, deviations).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"),
                                                  "host_rejected")
    tests = rules()
    out = measured.join(hosts, measured["host"].eqNullSafe(hosts["_host"]), "left")
    return out.select("doc_id", "host", *MEASURES, (tests["short"] | tests["repeats"]).alias("base_failed"),
                      "host_rate", (~any_of([*tests.values(), F.col("host_rejected")])).alias("kept"))


def keep_good(documents: DataFrame, text_col: str = "text", host_col: str = "source",
              max_rate: float = MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """The documents, with all their columns, that neither fail a rule themselves nor have a rejected host.

    Texts are measured once: the measured documents are written and read twice.
    """
    ship_package(documents.sparkSession)

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES))

    m, gone = unused(documents, "measures", "rejected_host")
    measured = stored(documents.withColumn(m, measures(F.col(text_col))), "measured")
    hosts = host_rates(measured.select(F.col(host_col).alias("host"), f"{m}.*"), max_rate, deviations)
    bad = stored(hosts.where("host_rejected").select(F.col("host").alias(gone)), "rejected-hosts")
    kept = measured.where(~any_of(list(rules(lambda c: F.col(f"{m}.{c}")).values())))
    return kept.join(bad, kept[host_col].eqNullSafe(bad[gone]), "left_anti").drop(m)
