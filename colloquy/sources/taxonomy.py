"""Label taxonomies.

A taxonomy is a small, fixed-size table ``(taxonomy, parent, label, pos)``;
``parent`` is null for top-level labels and names the top-level label for
sublists. ``pos`` is the position in the list and decides ties.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Label lists that results must match (stated as given, in order).
# ---------------------------------------------------------------------------
HYPOTHESIS_TEMPLATE = "The topic of this sentence is {}."

LEVEL1 = ["sports", "politics", "movies", "books", "music", "science", "animals", "videogames"]
LEVEL1_SUBLISTS = {
    "sports": ["football", "basketball", "tennis", "player", "coach"],
    "politics": ["trump", "elections", "vote", "biden", "poll", "fake news"],
    "movies": ["genre", "director", "title", "plot", "actor", "synopsis"],
    "books": ["genre", "author", "title", "plot", "harry potter"],
    "music": ["genre", "song", "singer", "band", "lyrics", "rythm", "dance"],
    "science": ["nature", "maths", "computer", "physics", "space", "robots"],
    "videogames": ["arcade", "console", "play station", "xbox", "wii"],
}
LEVEL2 = ["art", "teacher", "family", "finance", "cars", "astronomy"]
LEVEL2_SUBLISTS = {
    "art": ["ballet", "theatre", "cinema", "museum", "painting"],
    "teacher": ["history", "school", "subject", "university", "mark", "professor"],
    "family": ["parents", "friends", "relatives", "marriage", "sons"],
    "finance": ["bitcoins", "investment", "stock market", "benefits", "finances"],
    "cars": ["electric vehicle", "fuel", "speed", "model"],
    "astronomy": ["astronomy"],
}
LEVEL3 = ["food", "photography", "newspaper", "fashion", "climate conditions", "facebook"]
LEVEL3_SUBLISTS = {
    "food": ["healthy", "vegetables", "fish", "meat", "dessert"],
    "photography": ["camera", "light", "lens", "zoom", "optics"],
    "newspaper": ["press", "interview", "exclusive", "trending", "fake news"],
    "fashion": ["model", "clothes", "dress", "jewel", "catwalk", "design"],
    "climate conditions": ["sunny", "cloudy", "raining", "cold", "hot"],
    "facebook": ["twitter", "instagram", "facebook", "fake news"],
}
AMAZON = ["Sports", "Politics", "Entertainment_Movies", "Entertainment_Books", "Entertainment_Music",
          "Science_and_Technology", "Entertainment_General", "Phatic", "Interactive",
          "Inappropriate_Content", "Other"]
AMAZON_UNCASED = ["sports", "politics", "movies", "books", "music", "science", "general", "phatic",
                  "interactive", "inappropriate", "other"]
# First level as used for adjacent turn pairs (same labels, other order).
PAIR_LEVEL1 = ["sports", "politics", "movies", "books", "music", "animals", "videogames", "science"]

# Level-name remap applied to the winning label of each level.
LEVEL_RENAME = {
    "teacher": "education",
    "finance": "economy",
    "food": "nutrition",
    "newspaper": "news",
    "climate conditions": "weather",
    "facebook": "social media",
}
# ---------------------------------------------------------------------------

# Own choice (not from any reference): a language taxonomy whose keywords are
# common function words; it gives the flagship query a real ground truth
# (documents.lang) to evaluate against.
LANGUAGE_KEYWORDS = {
    "en": ["the", "of", "and", "to", "is"],
    "fr": ["le", "la", "les", "et", "des"],
    "de": ["der", "die", "und", "den", "von"],
    "es": ["el", "los", "del", "y", "las"],
}


@dataclass(frozen=True)
class Taxonomy:
    """One list of candidate labels plus optional sublists keyed by label."""

    name: str
    labels: tuple
    sublists: dict = field(default_factory=dict)
    keywords: dict = field(default_factory=dict)  # label -> explicit keywords

    def keywords_of(self, label: str, with_sublabels: bool = True) -> list[str]:
        """Evidence words of a label: its own words, plus its sublabels' words."""
        if label in self.keywords:
            words = list(self.keywords[label])
        else:
            words = _letters(label)
            if with_sublabels:
                for sub in self.sublists.get(label, []):
                    words.extend(_letters(sub))
        seen, out = set(), []
        for w in words:
            if w not in seen:
                seen.add(w)
                out.append(w)
        return out

    def rows(self) -> list[tuple]:
        out = [(self.name, None, lab, i) for i, lab in enumerate(self.labels)]
        for parent in self.labels:
            for i, lab in enumerate(self.sublists.get(parent, [])):
                out.append((self.name, parent, lab, i))
        return out


def _letters(label: str) -> list[str]:
    """Lower-case letter runs, as the texts are tokenised."""
    return re.findall(r"[^\W\d_]+", label.lower())


def _tax(name, labels, sublists=None):
    return Taxonomy(name, tuple(labels), dict(sublists or {}))


TOPIC_LEVEL1 = _tax("level1", LEVEL1, LEVEL1_SUBLISTS)
TOPIC_LEVEL2 = _tax("level2", LEVEL2, LEVEL2_SUBLISTS)
TOPIC_LEVEL3 = _tax("level3", LEVEL3, LEVEL3_SUBLISTS)
TOPIC_AMAZON = _tax("amazon", AMAZON)
TOPIC_AMAZON_UNCASED = _tax("amazon_uncased", AMAZON_UNCASED)
PAIR_TOPIC_LEVEL1 = _tax("pair_level1", PAIR_LEVEL1, LEVEL1_SUBLISTS)
LANGUAGES = Taxonomy("language", tuple(LANGUAGE_KEYWORDS), {}, dict(LANGUAGE_KEYWORDS))

ANNOTATION_TAXONOMIES = (TOPIC_LEVEL1, TOPIC_LEVEL2, TOPIC_LEVEL3, TOPIC_AMAZON, TOPIC_AMAZON_UNCASED)

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("taxonomy", T.StringType(), False),
    T.StructField("parent", T.StringType(), True),
    T.StructField("label", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
])


def taxonomy_table(spark: SparkSession, taxonomies=ANNOTATION_TAXONOMIES) -> DataFrame:
    """The label lists as one small table (a few hundred rows at most)."""
    rows = [r for t in taxonomies for r in t.rows()]
    return spark.createDataFrame(rows, TAXONOMY_SCHEMA)
