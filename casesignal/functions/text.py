"""Name normalisers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python sees it: Unicode White_Space plus the four separators.
_WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(i) for i in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(c: Column) -> Column:
    """Strip all leading and trailing white space, not only blanks."""
    return F.btrim(c, F.lit(_WS))


def blank_ws(c: Column) -> Column:
    """Turn every white-space character into a blank."""
    return F.translate(c, _WS, " " * len(_WS))


def squeeze_ws(c: Column) -> Column:
    """Turn every run of white space into one blank."""
    return F.regexp_replace(blank_ws(c), " {2,}", " ")


def _or_token(c: Column, null_token: str | None) -> Column:
    return c if null_token is None else F.coalesce(c, F.lit(null_token))


def fold_separators(c: Column) -> Column:
    """Trim, upper-case, then turn ``-`` and ``_`` into blanks."""
    return F.translate(F.upper(trim_ws(c)), "-_", "  ")


def lookup_key(c: Column) -> Column:
    """The folded name as it is looked up: separators at the ends are gone."""
    return fold_separators(fold_separators(c))


def collapse_ws(c: Column, null_token: str | None = None) -> Column:
    """Upper-case, trim and squeeze white space."""
    return squeeze_ws(trim_ws(F.upper(_or_token(c, null_token))))


def std_name(c: Column, null_token: str | None = None) -> Column:
    """:func:`collapse_ws`, then drop one quote at each end.

    A null name stays null; ``null_token='NONE'`` counts it as a name instead.
    """
    return F.regexp_replace(collapse_ws(c, null_token), '^"|"$', "")


def first_token(c: Column) -> Column:
    """First white-space separated word; empty text for blank input."""
    return F.substring_index(F.btrim(blank_ws(c)), " ", 1)


def contains_any(c: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """True where the text holds one of the terms anywhere; null counts as ''."""
    if not terms:
        return F.lit(False)
    pattern = "|".join(re.escape(t) for t in terms)
    return F.coalesce(c, F.lit("")).rlike(pattern)


def split_tags(c: Column, separators: str = "[;,|]+") -> Column:
    """Tag list of a delimited text: trimmed, without empty tags."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separators), trim_ws)
    return F.filter(parts, lambda t: t != "")


def count_tag(tags: Column, tag: str) -> Column:
    """How often the tag list holds the tag."""
    return F.size(F.filter(tags, lambda t: t == tag))


def null_if_na(c: Column, tokens: tuple[str, ...]) -> Column:
    """Null for the texts that stand for a missing value."""
    return F.when(~c.isin(list(tokens)), c)
