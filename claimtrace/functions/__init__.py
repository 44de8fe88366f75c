"""Column expressions shared by the operators."""

from claimtrace.functions.money import dollars, money
from claimtrace.functions.text import normalised, tokens

__all__ = ["dollars", "money", "normalised", "tokens"]
