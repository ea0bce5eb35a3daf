"""Scalar expressions: dates, bins, flags, ratios and casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def parse_date(c: Column, fmt: str = "yyyyMMdd") -> Column:
    """Date, or null where the text is not one."""
    return F.try_to_date(c, fmt)


def year_of(date: Column) -> Column:
    return F.year(date)


def quarter_of(date: Column) -> Column:
    return F.quarter(date)


def cut(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(e0,e1], (e1,e2], ...``; null outside all of them."""
    if len(edges) != len(labels) + 1:
        raise ValueError("cut needs one more edge than labels")
    out = F.when((c > edges[0]) & (c <= edges[1]), F.lit(labels[0]))
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        out = out.when((c > low) & (c <= high), F.lit(label))
    return out


def map_values(c: Column, mapping: Mapping[str, str], default: str | None) -> Column:
    """Map listed values, everything else (null too) to the default."""
    out = F.lit(default)
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def known_sex(c: Column) -> Column:
    return map_values(c, {"M": "M", "F": "F"}, "UNK")


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def at_least(c: Column, k: float) -> Column:
    """1 where the value reaches k, else 0; null stays null."""
    return (c >= k).cast("int")


def equals_flag(c: Column, value: str) -> Column:
    """1 where the upper-cased text equals the value, else 0 (null too)."""
    return F.coalesce((F.upper(c) == value).cast("int"), F.lit(0))


def pattern_flag(c: Column, pattern: str) -> Column:
    """1 where the upper-cased text matches anywhere, else 0 (null too)."""
    return F.coalesce(F.upper(c), F.lit("")).rlike(pattern).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def ratio_if_positive(num: Column, den: Column) -> Column:
    """num / den where den > 0, else null."""
    return F.when(den > 0, F.try_divide(num.cast("double"), den.cast("double")))


def to_number(c: Column) -> Column:
    """Double, or null for text that is not a plain number."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low)))


def rescale(c: Column, low: Column, high: Column, eps: float = 1e-9) -> Column:
    """(x - low) / (high - low + eps)."""
    return (c - low) / (high - low + F.lit(eps))


def hash_fraction(*parts: Column | str) -> Column:
    """Reproducible number in [0, 1) from the text of the parts."""
    return hash_number(*parts) / F.lit(float(2**32))


def hash_number(*parts: Column | str) -> Column:
    """First 32 bits of the md5 of the parts joined by ``|``, as a long."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("long")


def hash_text(*parts: Column | str) -> Column:
    """md5 (hex) of the parts joined by ``|``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
