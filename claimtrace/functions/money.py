"""Money as exact decimals."""

from pyspark.sql import Column, functions as F


def money(col) -> Column:
    """Whole cents; cast before any product or sum so that results are exact."""
    return _col(col).cast("decimal(18,2)")


def dollars(col) -> Column:
    """A decimal amount as a double, for final projections only."""
    return _col(col).cast("double")


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
