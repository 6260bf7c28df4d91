"""Helpers that several operators share: words, row keys, shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.plans.shared import dropped, new_path, workspace, written  # noqa: F401

#: A separator between words: blanks and the ASCII controls from tab to return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(text_or_empty(text), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row.

    A lambda's variable is bound to a value, so that nothing the optimizer
    merges can put the computation inside another lambda's loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(salt: int, key: Column) -> Column:
    """crc32 of a key's decimal text; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(salt))


def joined_small(df: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 100_000) -> DataFrame:
    """A join whose right side is broadcast only if it is counted and small."""
    n = small.limit(max_rows + 1).count()
    return df.join(F.broadcast(small) if n <= max_rows else small, on, how)
