"""Fixed-width hashed bit features of a text column.

The bits are our own definition: character n-grams hashed onto ``nbits``
positions. They stand where a structure fingerprint would stand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def char_ngrams(c: Column, n: int) -> Column:
    """All n-character windows of the whole text; none for shorter text.

    One regular-expression pass over the text: look ahead for n characters,
    step on by one.
    """
    grams = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.coalesce(grams, F.array().cast(T.ArrayType(T.StringType())))


def hashed_bits(c: Column, nbits: int = 1024, n: int = 3, hash_name: str = "xxhash64") -> Column:
    """Sorted distinct bit positions; null or empty text has none."""
    if hash_name not in ("xxhash64", "md5"):
        raise ValueError(f"unknown hash {hash_name!r}")

    def place(gram: Column) -> Column:
        if hash_name == "md5":
            head = F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long")
        else:
            head = F.xxhash64(gram)
        return F.pmod(head, F.lit(nbits)).cast("int")

    grams = F.array_distinct(char_ngrams(c, n))
    return F.array_sort(F.array_distinct(F.transform(grams, place)))
