"""String expressions (all built-in Spark functions, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CURRENCY_PATTERN, INFINITY_PATTERN, NA_TOKENS, NUMBER_PATTERN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_all(col) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def strip_currency(col) -> Column:
    """Remove currency tokens and thousands separators, then trim."""
    return trim_all(F.regexp_replace(_c(col), CURRENCY_PATTERN, ""))


def to_number(col) -> Column:
    """Text -> double; anything that is not a plain number becomes null.

    ``try_cast`` alone accepts forms such as ``12d`` or ``12f``; the regex
    guard keeps exactly the plain decimal / scientific forms.  The text
    ``nan`` is treated as missing, infinities are kept.
    """
    s = trim_all(col)
    return (
        F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
        .when(s.rlike(INFINITY_PATTERN),
              F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def coerce_currency_number(col) -> Column:
    """Strip currency tokens, then coerce to double (null on failure)."""
    return to_number(strip_currency(col))


def title_case(col) -> Column:
    """Python ``str.title().strip()`` on Spark built-ins.

    ``initcap`` only starts a word after a space; a marker plus space is
    inserted before every letter that follows a non-letter so each such
    letter starts a word, then the markers are removed.  Nulls stay null.
    """
    marked = F.regexp_replace(_c(col), r"(?<=[^\p{L}])(?=\p{L})", "\u0001 ")
    return trim_all(F.regexp_replace(F.initcap(marked), "\u0001 ", ""))


def na_tokens_to_null(col) -> Column:
    """Map the CSV missing-value tokens to null."""
    c = _c(col)
    return F.when(c.isin(NA_TOKENS), F.lit(None)).otherwise(c)
