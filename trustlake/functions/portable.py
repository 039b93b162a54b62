"""Hashes and token rules that every engine repeats alike.

Choices that other tools make with a random generator are made here by a hash
of the row's id, so results don't depend on partitions and SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words between white space.
SPACE = r"\s+"


def hash32(*parts: Column | str | int) -> Column:
    """32-bit hash of the parts as a bigint: the first 8 hex digits of their md5, joined by '|'."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Number in [0, 1) from the same hash."""
    return hash32(*parts) / F.lit(4294967296.0)


def ascii_words(text: Column) -> Column:
    """Lower-case words of a-z and apostrophes; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z']+"), lambda w: w != "")


def space_words(text: Column, *, lower: bool = False) -> Column:
    """Words between white space; null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.lower(text) if lower else text, SPACE), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """White space runs become one blank; trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))
