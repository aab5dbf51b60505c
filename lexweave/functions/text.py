"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1C-\x1F]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def clean(c: Column | str) -> Column:
    """Every whitespace run becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE_RUN, " "))


def is_blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | (c == "")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def preview(c: Column | str, n: int) -> Column:
    """The first n characters, with an ellipsis where the text is longer."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def words(c: Column | str) -> Column:
    """Whitespace-separated tokens; no empty ones."""
    body = strip(c)
    parts = F.split(body, WHITESPACE_RUN)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(parts)


def seeded_key(seed: int, *ids: Column | str) -> Column:
    """A pseudo-random order that depends on seed and id alone, not on partitioning."""
    parts = [_col(i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
