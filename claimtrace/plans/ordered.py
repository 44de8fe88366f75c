"""Row-order functions (running sums, previous and next rows) over groups of any size and number.

Where no group is large, a group is one window partition. Otherwise the functions are a
prefix scan of the whole table: all rows are dealt out by ranges of (keys, order), so each range has
about ``RANGE_ROWS`` rows whatever the groups are; a group's rows in one range are a window
partition; and what earlier ranges contribute to a group comes from one summary per range and
open group. Only the first and the last group of a range can be open, so summaries are a few per
range. The result is the same as that of one window per group.
"""

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from claimtrace.plans.hot import HOT_ROWS, HOT_ROWS_CONF, group_sizes, join_bounded
from claimtrace.sources.storage import written

# rows of a range, as far as Spark's sample of the order tells
RANGE_ROWS = 1_000_000
RANGE_ROWS_CONF = "claimtrace.rangeRows"

_RANGE = "__range"


@dataclass(frozen=True)
class _Step:
    """One added column: its value in a window, and how other ranges change it."""

    name: str
    in_window: Callable[[WindowSpec], Column]
    per_range: Column
    over_ranges: Callable[[Column], Column]
    combined: Callable[[Column, Column, WindowSpec], Column]
    looks_ahead: bool = False
    reads_backward: bool = False


class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order`` (ascending, nulls first).

    ``order`` should end in a column that makes it unique within a group. Methods note
    columns to add and return self; a column may be built on earlier ones only after
    ``with_column``. Group sizes are estimated from ``sizes_from``, for a ``df`` that is
    costly to compute twice.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        sizes_from: DataFrame | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        self._steps: list[_Step] = []
        self._columns = df.columns
        self._rows, self._open = df, None
        conf = df.sparkSession.conf
        total, largest = group_sizes(df if sizes_from is None else sizes_from, self.keys)
        if largest > float(conf.get(HOT_ROWS_CONF, str(HOT_ROWS))):
            wanted = math.ceil(total / float(conf.get(RANGE_ROWS_CONF, str(RANGE_ROWS))))
            ranges = max(wanted, int(conf.get("spark.sql.shuffle.partitions")))
            in_order = [F.col(c).asc_nulls_first() for c in [*self.keys, *self.order]]
            dealt = df.repartitionByRange(ranges, *in_order).withColumn(_RANGE, F.spark_partition_id())
            # read again for what the ranges carry over, so it is computed only once
            self._rows = written(dealt, "ranges")
            self._open = written(self._open_groups(), "open-groups")

    def running_sum(self, **columns: str) -> "OrderedGroups":
        """``name=column``: the sum of ``column`` from the start of the group to this row."""
        zero = F.lit(0)
        for name, column in columns.items():
            self._steps.append(
                _Step(
                    name,
                    lambda rows, c=column: F.coalesce(F.sum(c).over(_so_far(rows)), zero),
                    F.sum(column),
                    F.sum,
                    lambda here, carried, rows: here + F.coalesce(carried, zero),
                )
            )
        return self

    def previous(self, **columns: str) -> "OrderedGroups":
        """``name=column``: the value of ``column`` in the row before, null in the first row."""
        return self._beside(columns, F.lag, F.max_by, looks_ahead=False)

    def following(self, **columns: str) -> "OrderedGroups":
        """``name=column``: the value of ``column`` in the row after, null in the last row."""
        return self._beside(columns, F.lead, F.min_by, looks_ahead=True)

    def last_known(self, **columns: str) -> "OrderedGroups":
        """``name=column``: the latest non-null ``column`` up to and including this row."""
        return self._known(columns, F.max_by, looks_ahead=False)

    def next_known(self, **columns: str) -> "OrderedGroups":
        """``name=column``: the earliest non-null ``column`` from this row on."""
        return self._known(columns, F.min_by, looks_ahead=True)

    def with_column(self, name: str, col: Column) -> "OrderedGroups":
        """Adds the noted columns, then ``col``, which may refer to them."""
        self._add()
        self._columns = [*self._columns, name]
        self._rows = self._rows.withColumn(name, col)
        return self

    def result(self) -> DataFrame:
        self._add()
        return self._rows if self._open is None else self._rows.drop(_RANGE)

    def _beside(self, columns: dict[str, str], offset, nearest, looks_ahead: bool) -> "OrderedGroups":
        for name, column in columns.items():
            self._steps.append(
                _Step(
                    name,
                    lambda rows, c=column: offset(c).over(rows),
                    nearest(column, F.struct(*self.order)),
                    F.last,
                    lambda here, carried, rows: F.when(
                        offset(F.lit(True)).over(rows).isNull(), carried
                    ).otherwise(here),
                    looks_ahead,
                )
            )
        return self

    def _known(self, columns: dict[str, str], nearest, looks_ahead: bool) -> "OrderedGroups":
        for name, column in columns.items():
            place = F.when(F.col(column).isNotNull(), F.struct(*self.order))
            self._steps.append(
                _Step(
                    name,
                    lambda rows, c=column: F.last(c, ignorenulls=True).over(_so_far(rows)),
                    nearest(column, place),
                    lambda col: F.last(col, ignorenulls=True),
                    lambda here, carried, rows: F.coalesce(here, carried),
                    looks_ahead,
                    # the next known value is the last one when reading from the end
                    reads_backward=looks_ahead,
                )
            )
        return self

    def _window(self, step: _Step, *extra: str) -> WindowSpec:
        order = [
            F.col(c).desc_nulls_last() if step.reads_backward else F.col(c).asc_nulls_first()
            for c in self.order
        ]
        return Window.partitionBy(*self.keys, *extra).orderBy(*order)

    def _add(self) -> None:
        steps, self._steps = self._steps, []
        if not steps:
            return
        columns = self._columns
        self._columns = [*columns, *[s.name for s in steps]]
        if self._open is None:
            added = [s.in_window(self._window(s)).alias(s.name) for s in steps]
            self._rows = self._rows.select(*columns, *added)
            return
        joined = join_bounded(self._rows, self._carried(steps), [*self.keys, _RANGE], "left")
        added = []
        for s in steps:
            rows = self._window(s, _RANGE)
            added.append(s.combined(s.in_window(rows), F.col(f"__c_{s.name}"), rows).alias(s.name))
        self._rows = joined.select(*columns, _RANGE, *added)

    def _open_groups(self) -> DataFrame:
        """The first and the last group of each range: all that may lie in more than one."""
        group = F.struct(*self.keys)
        ends = self._rows.groupBy(_RANGE).agg(F.min(group).alias("__lo"), F.max(group).alias("__hi"))
        return ends.select(F.explode(F.array("__lo", "__hi")).alias("__g")).select("__g.*").distinct()

    def _carried(self, steps: list[_Step]) -> DataFrame:
        """For each range of an open group, what the ranges before (or after) it contribute."""
        rows = join_bounded(self._rows, self._open, self.keys, "left_semi")
        ranges = rows.groupBy(*self.keys, _RANGE).agg(*[s.per_range.alias(f"__p_{s.name}") for s in steps])

        def others(s: _Step) -> WindowSpec:
            number = F.col(_RANGE).desc() if s.looks_ahead else F.col(_RANGE).asc()
            by_number = Window.partitionBy(*self.keys).orderBy(number)
            return by_number.rowsBetween(Window.unboundedPreceding, -1)

        return ranges.select(
            *self.keys,
            _RANGE,
            *[s.over_ranges(F.col(f"__p_{s.name}")).over(others(s)).alias(f"__c_{s.name}") for s in steps],
        )


def _so_far(rows: WindowSpec) -> WindowSpec:
    return rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
