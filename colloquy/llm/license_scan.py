"""License scan: ordered signature rules over whole texts.

A signature is a regular expression with a label, a priority, a confidence and
a word of its own name that the text must hold before the expression is tried.
Most rules are hand-written (``license_rules``: SPDX identifiers, version forms,
file headers, the wordings of notices that never name their license,
addresses of the texts). Below them stand plain phrasings of license names
("licensed under ...", a bare name): 73 names in 10 phrasings.
Detections are intervals of the text. They are taken in order of priority,
then length, then position; one that lies inside an interval already taken is
suppressed, so "GNU Lesser General Public License" is no hit for the shorter
name inside it, and a full "licensed under" sentence hides the bare name.

Matching is done on the text's UTF-8 bytes with A-Z lower-cased, where a word
is a run of ASCII letters, digits or non-ASCII characters; between two words
of a phrase anything else may stand.

Besides the signatures, ``BASE`` phrases are counted in all places; their
labels always stay.

Defined results: null and empty texts have no words, no labels ('') and score
0; repeated rows are scanned each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.common import arrow_map, batches, pick
from colloquy.llm.license_rules import RULES

#: Phrases that are counted in all their places, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, keyword, names of the license as words. The keyword's first word gates the names that hold it.
FAMILIES = [
    ("agpl", "affero", ["gnu affero general public license", "affero general public license", "affero gpl"]),
    ("agpl", "agpl", ["agpl", "gnu agpl", "agplv3"]),
    ("lgpl", "lesser", ["gnu lesser general public license", "lesser general public license"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl", "lgplv2 1", "lgplv3"]),
    ("gpl", "general public", ["gnu general public license", "gnu public license", "general public license"]),
    ("gpl", "gpl", ["gpl", "gnu gpl", "gplv2", "gplv3"]),
    ("gfdl", "free documentation", ["gnu free documentation license", "free documentation license"]),
    ("apache", "apache", ["apache license", "apache software license", "apache public license", "asl 2 0"]),
    ("cc-by-nc-nd", "cc by", ["cc by nc nd"]),
    ("cc-by-nc-sa", "cc by", ["cc by nc sa"]),
    ("cc-by-nc", "cc by", ["cc by nc"]),
    ("cc-by-nd", "cc by", ["cc by nd"]),
    ("cc-by-sa", "cc by", ["cc by sa"]),
    ("cc-by", "cc by", ["cc by"]),
    ("cc-by-nc", "noncommercial", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "sharealike", ["creative commons attribution sharealike"]),
    ("cc-by", "creative commons", ["creative commons attribution license", "creative commons attribution"]),
    ("cc0", "cc0", ["cc0", "creative commons zero"]),
    ("mit", "mit", ["mit license", "the mit license", "expat license"]),
    ("bsd", "bsd", ["bsd license", "bsd 2 clause license", "bsd 3 clause license", "new bsd license",
                    "simplified bsd license"]),
    ("isc", "isc", ["isc license", "isc licence"]),
    ("mpl", "mozilla", ["mozilla public license", "mozilla public licence"]),
    ("epl", "eclipse", ["eclipse public license"]),
    ("edl", "eclipse", ["eclipse distribution license"]),
    ("eupl", "european union public", ["european union public licence", "european union public license"]),
    ("cddl", "common development", ["common development and distribution license"]),
    ("artistic", "artistic", ["artistic license", "perl artistic license"]),
    ("boost", "boost", ["boost software license"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("ofl", "open font", ["sil open font license", "open font license"]),
    ("odbl", "open database", ["open database license", "open data commons open database license"]),
    ("python", "python software", ["python software foundation license"]),
    ("postgresql", "postgresql", ["postgresql license"]),
    ("ms-pl", "microsoft", ["microsoft public license"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"]),
    ("public-domain", "public domain", ["public domain dedication", "dedicated to the public domain"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]

#: Phrasing ("@" is the name), priority, confidence.
PHRASINGS = [
    ("licensed under the terms of the @ version", 90, 0.99),
    ("licensed under the @", 80, 0.97),
    ("licensed under @", 80, 0.97),
    ("released under the @", 80, 0.97),
    ("distributed under the terms of the @", 85, 0.97),
    ("available under the @", 75, 0.95),
    ("subject to the @", 70, 0.9),
    ("spdx license identifier @", 95, 1.0),
    ("@ version", 40, 0.8),
    ("@", 20, 0.6),
]

_SEP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IN = rb"[0-9a-z\x80-\xff]"
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Signature(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: bytes
    pattern: re.Pattern


class Hit(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    confidence: float


def phrase(words: str) -> re.Pattern:
    """The words one after another, whole words only."""
    body = _SEP.join(re.escape(w.encode()) for w in words.split())
    return re.compile(b"(?<!" + _IN + b")" + body + b"(?!" + _IN + b")")


def expression(rule: str) -> re.Pattern:
    """A hand-written rule: a space is what separates two words, both ends are word ends."""
    body = rule.encode().replace(b",? ", b" ").replace(b" ?", b"(?:" + _SEP + b")?").replace(b" ", _SEP)
    return re.compile(b"(?<!" + _IN + b")(?:" + body + b")(?!" + _IN + b")")


def gate(keyword: str, name: str) -> bytes:
    """What every text with the name holds: the keyword's first word if the name has it, else the name's own first."""
    first = keyword.split()[0]
    return (first if first in name else name.split()[0]).encode()


@cache
def signatures() -> dict[bytes, list[Signature]]:
    """All signatures by their gate; the order is by priority."""
    found: dict[bytes, list[Signature]] = {}
    for label, rules in RULES.items():
        for keyword, priority, confidence, rule in rules:
            found.setdefault(keyword.encode(), []).append(Signature(
                label, 100 * priority + 99, confidence, keyword.encode(), expression(rule)))
    for label, keyword, names in FAMILIES:
        for name in names:
            for text, priority, confidence in PHRASINGS:
                key = gate(keyword, name)
                # a longer name is the more special rule among equals
                found.setdefault(key, []).append(Signature(
                    label, 100 * priority + len(name), confidence, key, phrase(text.replace("@", name))))
    return found


@cache
def _base() -> list[tuple[bytes, str, re.Pattern]]:
    return [(words.split()[0].encode(), label, phrase(words)) for words, label in BASE.items()]


def resolve(hits: list[Hit]) -> list[Hit]:
    """By priority, length and place; what lies inside an interval taken before is suppressed."""
    taken: list[Hit] = []
    for h in sorted(hits, key=lambda h: (-h.priority, h.start - h.end, h.start, h.label)):
        if not any(t.start <= h.start and h.end <= t.end for t in taken):
            taken.append(h)
    return sorted(taken)


def detect(lowered: bytes) -> list[Hit]:
    """The detections of the signatures in a lower-cased text, resolved.

    Intervals are resolved block by block: hits further apart than the longest
    phrasing can't contain each other, so a text with many notices costs no
    more than the sum of them.
    """
    hits = []
    for keyword, group in signatures().items():
        if all(word in lowered for word in keyword.split()):
            hits += [Hit(*m.span(), s.label, s.priority, s.confidence) for s in group for m in s.pattern.finditer(lowered)]
    hits.sort()
    taken: list[Hit] = []
    block: list[Hit] = []
    end = -1
    for h in hits:
        if block and h.start >= end:
            taken += resolve(block)
            block = []
        block.append(h)
        end = max(end, h.end)
    return taken + resolve(block)


def _word_starts(lowered: bytes) -> np.ndarray:
    inside = _IS_WORD[np.frombuffer(lowered, dtype=np.uint8)]
    return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
    if not text:
        return 0, 0, None, None, "", "", 0.0, []
    lowered = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    starts = _word_starts(lowered)
    places, labels = [], set()
    for keyword, label, pattern in _base():
        if keyword in lowered:
            at = [m.start() for m in pattern.finditer(lowered)]
            places += at
            labels |= {label} if at else set()
    hits = detect(lowered)
    more = labels | {h.label for h in hits}
    score = max([0.9 * bool(labels), *(h.confidence for h in hits)])
    first, last = (np.searchsorted(starts, [min(places), max(places)]).tolist() if places else (None, None))
    return (len(starts), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(more)), score,
            [{"label": h.label, "start": h.start, "end": h.end} for h in hits])


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def _scan_batches(it):
    for b in batches(it):
        cols = zip(*[scan_text(t) for t in b.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, _TYPES)]],
                                         ["doc_id", *_NAMES])


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and phrase counts, labels, score and the detections' byte spans."""
    narrow = pick(documents, doc_id=id_col, text=text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return arrow_map(narrow, _scan_batches, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double, "
                     "spans array<struct<label: string, start: long, end: long>>")
