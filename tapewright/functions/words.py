"""Tokens and line counts of whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of letters, digits of any script and underscores;
# a line ends at any Unicode line boundary.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(WORD_PATTERN))


def line_count(text: Column) -> Column:
    """Line breaks, plus one when text follows the last break."""
    breaks = F.regexp_count(text, F.lit(LINE_BREAK))
    open_end = (F.length(text) > 0) & ~F.rlike(F.right(text, F.lit(1)), F.lit(LINE_BREAK))
    return breaks + F.when(open_end, 1).otherwise(0)
