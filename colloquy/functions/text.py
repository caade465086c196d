"""String column functions (JVM-side, code-generated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are Unicode letters; everything else separates tokens.
TOKEN_SPLIT = r"[^\p{L}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def capitalize_first(col) -> Column:
    """First character upper case, the rest lower case (not ``initcap``)."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def strip_one_leading_space(col) -> Column:
    """Drop exactly one leading blank, if there is one."""
    c = _c(col)
    return F.when(c.startswith(" "), c.substr(F.lit(2), F.length(c))).otherwise(c)


def id_prefix(col, suffix_len: int = 4) -> Column:
    """Id without its last ``suffix_len`` characters; short ids give ''."""
    c = _c(col)
    keep = F.greatest(F.length(c) - F.lit(suffix_len), F.lit(0))
    return F.substr(c, F.lit(1), keep)


def contains_literal(col, needle: str) -> Column:
    """Literal substring test (the question filter uses '?').

    ``Column.contains`` is pushed to the Parquet scan as ``StringContains``.
    """
    return _c(col).contains(needle)


def question_template(kind: str, word) -> Column:
    """Question built from a subject word: 'like', 'favorite' or 'no-fill'."""
    w = _c(word) if not isinstance(word, str) else F.lit(word)
    if kind == "like":
        return F.concat(F.lit("do you like "), w, F.lit("?"))
    if kind == "favorite":
        return F.concat(F.lit("what's your favorite "), w, F.lit("?"))
    if kind == "no-fill":
        return w
    raise ValueError("question type must be 'like', 'favorite' or 'no-fill'")


def hypothesis(template: str, label) -> Column:
    """Fill the single ``{}`` slot of a hypothesis template with the label."""
    if template.count("{}") != 1:
        raise ValueError("template must contain exactly one '{}'")
    head, tail = template.split("{}")
    return F.concat(F.lit(head), _c(label), F.lit(tail))


def parse_labels(col) -> Column:
    """Comma separated label string -> trimmed array; arrays pass through."""
    return F.transform(F.split(_c(col), ","), lambda x: F.trim(x))


def tokens(col) -> Column:
    """Lower-cased letter runs of a text; null text gives an empty array."""
    parts = F.split(F.lower(F.coalesce(_c(col), F.lit(""))), TOKEN_SPLIT)
    return F.filter(parts, lambda x: x != F.lit(""))


def spaced_tokens(col) -> Column:
    """The ``tokens`` of a text with a blank between them; one more may stand before and after them."""
    return F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), TOKEN_SPLIT, " ")
