"""Text normalisation. A token is a maximal run of letters and digits in the lower-cased text."""

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(col) -> Column:
    """Tokens in text order; no stemming and no stop words."""
    return F.regexp_extract_all(F.lower(_col(col)), F.lit(TOKEN), F.lit(0))


def normalised(col) -> Column:
    """Tokens joined by single spaces, with a space at each end.

    A phrase normalised the same way is contained in a text only at token boundaries.
    """
    return F.concat(F.lit(" "), F.array_join(tokens(col), " "), F.lit(" "))


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
