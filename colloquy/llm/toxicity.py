"""Toxicity by weak supervision.

Many weak voters look at a text: slices of a lexicon that is induced from the
labelled training rows (words and word beginnings that stand far more often in
rows marked toxic), slices of a fixed lexicon, and patterns (insults near a
second person, shouting, runs of exclamation marks, density of hits ...). Each
votes for, against or abstains. A generative label model explains the votes:
a hidden class, for every voter its accuracy in either class, and, since voters
are correlated, a dependency tree over them (each voter also depends on one
other, chosen by conditional mutual information). The recorded label is one
more voter. It is fitted by expectation maximisation, and its posterior
probabilities are the targets on which a linear classifier (logistic
regression over lexicon hits and hit counts) is trained. Texts are scored by the
classifier alone.

Model fitting uses a bounded sample of labelled rows (``SAMPLE_ROWS``, the
smallest by a hash of the id), each distinct text once. Only text is an input;
ids, languages, sources and labels are none. Scoring reads every whole text.

Defined results: null and empty texts have no hits and get the score of a
text without hits; ids that repeat in the labels count with their mean label,
null labels and ids not at all; without usable labels the fixed lexicon and
the patterns vote alone; repeated rows are scored each; an empty table gives an
empty table.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, batches, pick, ship_package, stored
from colloquy.llm.jaccard_join import shingle_sets

#: Bounds of the fit: labelled rows, lexicon entries.
SAMPLE_ROWS, LEXICON = 16_000, 2000
#: An entry's smoothed odds of standing in toxic against other rows. Its
#: log-likelihood ratio against standing in both alike must also be too large to
#: come by chance among as many terms (those that stand in ``OFTEN`` rows or more).
MIN_ODDS, OFTEN = 12.0, 3
#: The recorded label is right this often.
LABEL_ACCURACY = 0.97
PREFIXES = (4, 5, 6, 7, 8)
WORD_SLICES, PREFIX_SLICES = 8, 6
THRESHOLD = 0.5

#: The lexicon that needs no labels, in three voters.
INSULTS = {
    "persons": "idiot moron loser clown scum jerk imbecile fool bastard pig freak liar coward retard",
    "judgements": "stupid pathetic worthless disgusting trash garbage ugly dumb useless filthy vile",
    "hostility": "hate kill shut damn hell curse destroy",
}
_FIXED = {k: frozenset(v.split()) for k, v in INSULTS.items()}
_ALL_FIXED = _FIXED["persons"] | _FIXED["judgements"]

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}")
_MASKED = re.compile(r"\b[a-z]+[@$*0-9]+[a-z]+\b")
_SECOND = re.compile(r"\b(?:you|your|du|dein|tu|ton|vous|usted|eres)\b\W+(?:\w+\W+){0,3}?(?:" + "|".join(sorted(_ALL_FIXED)) + r")\b")
#: Steps of hit counts and of hits per word that are features of the classifier.
COUNTS, DENSITIES = (1, 2, 3, 5, 10), (0.001, 0.003, 0.01, 0.03)


class Model(NamedTuple):
    entries: dict[str, int]  # "w:word" or "p:beginning" -> feature
    weights: np.ndarray
    intercept: float


class _Lexicon:
    def __init__(self, entries: dict[str, int]):
        self.words = {k[2:]: i for k, i in entries.items() if k[0] == "w"}
        self.by_size = [(n, {k[2:]: i for k, i in entries.items() if k[0] == "p" and len(k) == n + 2}) for n in PREFIXES]
        self.size = len(entries)

    def look(self, text: str | None) -> tuple[list[int], int, int, set[str], str]:
        """(entries present, occurrences of words that hit, words, distinct words that hit, lower-cased text)."""
        lowered = text.lower() if text else ""
        words = _WORD.findall(lowered)
        present, hit = set(), set()
        for w in set(words):
            if w in self.words:
                present.add(self.words[w])
                hit.add(w)
            for n, known in self.by_size:
                if w[:n] in known and len(w) >= n:
                    present.add(known[w[:n]])
                    hit.add(w)
        times = sum(1 for w in words if w in hit) if hit else 0
        return sorted(present), times, len(words), hit, lowered

    def features(self, present: list[int], times: int, n_words: int) -> list[int]:
        """Indices of the classifier's binary features."""
        at = self.size
        steps = [at + i for i, c in enumerate(COUNTS) if times >= c]
        steps += [at + len(COUNTS) + i for i, d in enumerate(DENSITIES) if n_words and times / n_words >= d]
        return [*present, *steps]


def n_features(entries: int) -> int:
    return entries + len(COUNTS) + len(DENSITIES)


VOTERS = ([f"words{i}" for i in range(WORD_SLICES)] + [f"beginnings{i}" for i in range(PREFIX_SLICES)]
          + [*INSULTS, "no_hit", "one_hit", "many_hits", "dense", "second_person", "shouting", "exclaiming", "masked"])


def votes(text: str | None, lexicon: _Lexicon, slices: dict[int, int], seen=None) -> list[int]:
    """One vote per voter: 1 toxic, -1 not, 0 abstains."""
    present, times, n, hit, lowered = seen or lexicon.look(text)
    out = [0] * (WORD_SLICES + PREFIX_SLICES)
    for i in present:
        out[slices[i]] = 1
    all_words = set(_WORD.findall(lowered))
    fixed = {k: words & all_words for k, words in _FIXED.items()}
    letters = sum(map(str.isalpha, text)) if text else 0
    upper = sum(map(str.isupper, text)) if text else 0
    out += [int(bool(fixed[k])) for k in INSULTS]
    out += [-1 if not hit else 0, -1 if len(hit) == 1 else 0, int(len(hit) >= 3),
            (int(times / n >= 0.01) if times else -1) if n else 0, int(bool(_SECOND.search(lowered))),
            int(letters >= 40 and 2 * upper > letters), int(bool(_SHOUT.search(lowered))), int(bool(_MASKED.search(lowered)))]
    return out


# ---------------------------------------------------------------------------
# label model
# ---------------------------------------------------------------------------

class LabelModel:
    """Hidden class with a dependency tree over three-valued voters, fitted by EM.

    Recorded labels, where given, are one more voter: independent of the others
    given the class, and of a stated accuracy, which ties the hidden class to them.
    """

    def __init__(self, rounds: int = 30, smoothing: float = 0.5, label_accuracy: float = LABEL_ACCURACY):
        self.rounds, self.smoothing, self.label_accuracy = rounds, smoothing, label_accuracy

    def _joint(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Weighted counts (class, voter, vote, voter, vote) from one-hot votes."""
        n, m = v.shape
        hot = np.zeros((n, m * 3))
        hot[np.arange(n)[:, None], np.arange(m) * 3 + v + 1] = 1
        return np.stack([(hot * w[:, None]).T @ hot for w in (1 - q, q)]).reshape(2, m, 3, m, 3)

    def _tree(self, joint: np.ndarray) -> list[int]:
        """Parent of each voter (-1: none) in the tree of largest conditional mutual information."""
        m = joint.shape[1]
        info = np.zeros((m, m))
        total = joint[:, 0, :, 0, :].sum()
        for c in range(2):
            t = joint[c] + 1e-9
            for i in range(m):
                for j in range(i):
                    p = t[i, :, j, :] / total
                    info[i, j] += (p * np.log(p * p.sum() / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum()
        info += info.T
        parent, near = [-1] * m, [(info[0, j], 0) for j in range(m)]
        left = set(range(1, m))
        while left:
            j = max(left, key=lambda x: (near[x][0], -x))
            # a tie of no information is no dependence
            parent[j] = near[j][1] if near[j][0] > 1e-4 else -1
            left.remove(j)
            for x in left:
                if info[j, x] > near[x][0]:
                    near[x] = (info[j, x], j)
        return parent

    def _tables(self, joint: np.ndarray) -> list[np.ndarray]:
        """Log P(vote | parent's vote, class) as (class, parent vote, vote); one row for roots."""
        out = []
        for j, p in enumerate(self.parent):
            single = joint[:, j, :, j, :].sum(-1) + self.smoothing
            single = single / single.sum(-1, keepdims=True)
            if p < 0:
                out.append(np.log(single[:, None, :]))
            else:
                # thin cells lean on the voter's own rate
                pair = joint[:, p, :, j, :] + 4 * self.smoothing * single[:, None, :]
                out.append(np.log(pair / pair.sum(-1, keepdims=True)))
        return out

    def posterior(self, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """P(toxic | votes), with recorded labels P(toxic | votes, label)."""
        log = np.tile(self.prior, (len(v), 1))
        for j, (p, table) in enumerate(zip(self.parent, self.tables)):
            row = v[:, p] + 1 if p >= 0 else np.zeros(len(v), dtype=np.int64)
            log += table[:, row, v[:, j] + 1].T
        odds = log[:, 1] - log[:, 0]
        if label is not None:
            odds = odds + label * np.log(self.label_accuracy / (1 - self.label_accuracy))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def fit(self, v: np.ndarray, label: np.ndarray) -> np.ndarray:
        """``v``: votes (-1, 0, 1); ``label``: recorded labels (-1, 1). Returns the posterior.

        The prior is the labels' share, so that a handful of voters that agree
        with each other cannot make a class of their own.
        """
        q = np.where(label > 0, self.label_accuracy, 1 - self.label_accuracy)
        share = (float((label > 0).sum()) + 1) / (len(label) + 2)
        self.prior = np.log(np.array([1 - share, share]))
        for r in range(self.rounds):
            joint = self._joint(v, q)
            if r % 10 == 0:
                self.parent = self._tree(joint)
            self.tables = self._tables(joint)
            new = self.posterior(v, label)
            moved = float(np.abs(new - q).max()) if len(q) else 0.0
            q = new
            if moved < 1e-4:
                break
        return q

    def accuracies(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of each voter: how often its votes (without abstentions) name the likelier class."""
        right = np.where(v == 1, q[:, None], np.where(v == -1, 1 - q[:, None], 0)).sum(0)
        cast = (v != 0).sum(0)
        return np.divide(right, cast, out=np.full(v.shape[1], np.nan), where=cast > 0)


def train_linear(rows: list[list[int]], target: np.ndarray, n: int, rounds: int = 600,
                 l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features with soft targets (accelerated gradient descent)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], dtype=np.int64)
    w, b = np.zeros(n), 0.0
    mw, mb = w.copy(), b
    step = 4.0 / (float(np.mean([len(r) ** 2 for r in rows]) ** 0.5) + 2.0)
    for t in range(rounds):
        gap = 1 / (1 + np.exp(-(mb + np.bincount(at, weights=mw[col], minlength=len(rows))))) - target
        nw = mw - step * (np.bincount(col, weights=gap[at], minlength=n) + l2 * mw) / len(rows)
        nb = mb - step * float(gap.mean())
        k = t / (t + 3)
        mw, mb = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    return w, float(b)


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                  text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y): texts of at most ``rows`` labelled ids that are not held out, one text an id.

    Of different texts under one id, that with the smallest hash counts. Copies, most near copies too, count once (two minhashes of word 5-grams
    agree), so that words of a text that was copied often do not pass for a lexicon.
    """
    lab = pick(labels, doc_id=id_col, y=label_col).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    lab = lab.where(~held_out()).groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    lab = stored(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    found = pick(documents, doc_id=id_col, text=text_col).join(F.broadcast(lab), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    found = found.groupBy("doc_id", "y").agg(one).select("one.text", "y")  # at most ``rows`` rows

    def sign(it):
        for b in batches(it):
            signs = [f"{h[0]:x}-{(h * np.uint64(0x9E3779B97F4A7C15)).min():x}" if len(h) else ""
                     for h in shingle_sets(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("y"), pa.array(signs, pa.string())],
                                             ["text", "y", "sign"])

    signed = arrow_map(found, sign, "text string, y double, sign string")
    return signed.groupBy("sign").agg(F.min("text").alias("text"), F.avg("y").alias("y")).select("text", "y")


def induce(sample: DataFrame) -> dict[str, int]:
    """Words and word beginnings with their numbers, those that speak most for toxicity first."""
    def terms(it):
        counts: dict[str, list[float]] = {}
        docs, toxic = 0, 0.0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array([c[0] for c in counts.values()], pa.int64()),
                                               pa.array([c[1] for c in counts.values()], pa.float64())], ["term", "n", "y"])

        for b in batches(it):
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = set(_WORD.findall(text.lower())) if text else set()
                found = {"w:" + w for w in words if len(w) > 2}
                found.update("p:" + w[:n] for n in PREFIXES for w in words if len(w) >= n)
                for t in found:
                    c = counts.setdefault(t, [0, 0.0])
                    c[0] += 1
                    c[1] += y
                docs += 1
                toxic += y
                if len(counts) > 300_000:
                    yield rows()
                    counts.clear()
        counts[""] = [docs, toxic]
        yield rows()

    counted = stored(arrow_map(sample, terms, "term string, n long, y double").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y")), "terms")
    total = counted.where("term = ''").first()
    n, y = (total["n"], total["y"]) if total else (0, 0.0)
    odds = (F.col("y") + 0.5) / (y + 1.0) / ((F.col("n") - F.col("y") + 0.5) / (n - y + 1.0))
    share = (y + 1e-9) / (n + 2e-9)
    least = 2 * float(np.log(max(2, counted.where((F.col("term") != "") & (F.col("n") >= OFTEN)).count())))
    rest = F.col("n") - F.col("y")
    ratio = 2 * (F.col("y") * F.log((F.col("y") + 1e-9) / (F.col("n") * share))
                 + rest * F.log((rest + 1e-9) / (F.col("n") * (1 - share))))
    best = counted.where((F.col("term") != "") & (odds >= MIN_ODDS) & (ratio >= least))
    best = best.orderBy(F.desc(ratio), "term").limit(LEXICON).select("term")
    return {r[0]: i for i, r in enumerate(best.collect())}


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Induce the lexicon, fit the label model and train the classifier on its posterior."""
    sample = stored(training_rows(documents, labels, label_col, id_col, text_col), "training")
    entries = induce(sample)
    for w in sorted(_ALL_FIXED):
        entries.setdefault("w:" + w, len(entries))
    slices = _slices(entries)

    def look(it):
        lexicon = _Lexicon(entries)
        for b in batches(it):
            seen = [lexicon.look(t) for t in b.column("text").to_pylist()]
            v = [votes(t, lexicon, slices, s) for t, s in zip(b.column("text").to_pylist(), seen)]
            f = [lexicon.features(*s[:3]) for s in seen]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(v, pa.list_(pa.int8())), pa.array(f, pa.list_(pa.int32()))],
                                             ["y", "votes", "features"])

    rows = arrow_map(sample, look, "y double, votes array<tinyint>, features array<int>").collect()  # at most SAMPLE_ROWS
    rows = sorted(rows, key=lambda r: (r["y"], r["votes"], r["features"]))
    n = n_features(len(entries))
    if not rows:  # nothing to learn from: a hit of the fixed lexicon counts, two speak for toxicity
        weights = np.zeros(n)
        weights[len(entries):len(entries) + 2] = (2.0, 2.0)
        return Model(entries, weights, -3.0)
    y = np.array([r["y"] for r in rows])
    v = np.array([r["votes"] for r in rows], dtype=np.int64)
    target = LabelModel().fit(v, np.where(y >= 0.5, 1, -1))
    weights, intercept = train_linear([r["features"] for r in rows], target, n)
    return Model(entries, weights, intercept)


def _slices(entries: dict[str, int]) -> dict[int, int]:
    """The lexicon voter of each entry: by turns, so that every slice has strong and weak entries."""
    out, words, beginnings = {}, 0, 0
    for term, i in sorted(entries.items(), key=lambda e: e[1]):
        if term[0] == "w":
            out[i] = words % WORD_SLICES
            words += 1
        else:
            out[i] = WORD_SLICES + beginnings % PREFIX_SLICES
            beginnings += 1
    return out


def _score_texts(texts: list[str | None], lexicon: _Lexicon, model: Model) -> np.ndarray:
    margins = np.array([model.intercept + model.weights[lexicon.features(*lexicon.look(t)[:3])].sum() for t in texts])
    return 1 / (1 + np.exp(-np.clip(margins, -50, 50)))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    docs = pick(documents, doc_id=id_col, text=text_col)

    def run(it):
        lexicon = _Lexicon(model.entries)
        for b in batches(it):
            s = _score_texts(b.column("text").to_pylist(), lexicon, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, run, f"doc_id {kind}, score double, predicted int")


def keep_harmless(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    ship_package(documents.sparkSession)

    @F.pandas_udf("double")
    def toxic(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = _Lexicon(model.entries)
        for texts in it:
            yield pd.Series(_score_texts(texts.tolist(), lexicon, model))

    return documents.where(toxic(F.col(text_col)) < THRESHOLD)
