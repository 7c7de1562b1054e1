"""The list fields of annotation files, as four readers of one text column; each gives array<string>.

A JSON list counts as one if the text starts with [ and ends with ]. Null and blank texts give an empty list, and
null elements are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _none() -> Column:
    return F.array().cast("array<string>")


def _text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))


def _parsed(text: Column, single_quotes: bool) -> Column:
    """The elements of a list literal, or null."""
    listed = text.startswith("[") & text.endswith("]")
    return F.when(listed, F.from_json(text, "array<string>", {"allowSingleQuotes": str(single_quotes).lower()}))


def _filled(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")


def _split(text: Column, by: str) -> Column:
    return _filled(F.split(text, f"[{by}]"))


def _first_sign(text: Column, signs: str) -> Column:
    """Split at the first of the signs that the text has; without any, the text is the only element."""
    out = F.when(F.lit(False), _none())
    for sign in signs:
        out = out.when(F.contains(text, F.lit(sign)), _split(text, sign))
    return out.otherwise(F.array(text))


def storage_list(value: Column) -> Column:
    """A JSON list, else the whole text as one element; ``nan`` is empty."""
    text = _text(value)
    return F.when((text == "") | (F.lower(text) == "nan"), _none()).otherwise(F.coalesce(_filled(_parsed(text, False)), F.array(text)))


def import_list(value: Column) -> Column:
    """A JSON list, else split at | or, without it, at ; or, without both, at a comma."""
    text = _text(value)
    return F.when(text == "", _none()).otherwise(F.coalesce(_filled(_parsed(text, False)), _first_sign(text, "|;,")))


def validation_list(value: Column) -> Column:
    """A JSON value (a list, or a scalar as one element), else a list literal in single quotes, else split at |."""
    text = _text(value)
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    scalar = F.when(~text.startswith("[") & (F.size(alone) == 1), _filled(alone))
    listed = F.coalesce(_parsed(text, False), _parsed(text, True))
    return F.when(text == "", _none()).otherwise(F.coalesce(_filled(listed), scalar, _split(text, "|")))


def gold_list(value: Column) -> Column:
    """A list literal as it stands, else split at ; or, without it, at a comma."""
    text = _text(value)
    literal = F.filter(_parsed(text, True), lambda v: v.isNotNull())
    return F.when(text == "", _none()).otherwise(F.coalesce(literal, _first_sign(text, ";,")))
