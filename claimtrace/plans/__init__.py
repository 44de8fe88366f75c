"""Plan shapes that keep very large groups spread over many tasks."""

from claimtrace.plans.groups import (
    hot_keys,
    salted_join,
    split_hot,
    top_k,
    with_group_stats,
    with_quantiles,
)
from claimtrace.plans.ordered import OrderedGroups

__all__ = [
    "OrderedGroups",
    "hot_keys",
    "salted_join",
    "split_hot",
    "top_k",
    "with_group_stats",
    "with_quantiles",
]
