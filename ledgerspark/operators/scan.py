"""Running values over ordered groups of any size.

``Scan`` adds columns that depend on what came before in a group: sums, extremes, and the first or last known
value.  A group that fits a task is a window.  Where one may not fit, the rows are range-partitioned by
(group, order); each partition works for itself, one row of totals for each (partition, group) is combined over
the partitions, and what it says is put before the partition's own values.  All of these are associative, so both
ways give the same rows, and a group with all rows of a table spreads over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Rows of a group from which it is scanned in segments, and rows of a segment.
HOT_ROWS, SEGMENT_ROWS = 1_000_000, 250_000
FRAMES = {"so_far": (Window.unboundedPreceding, Window.currentRow), "before": (Window.unboundedPreceding, -1), "all": (Window.unboundedPreceding, Window.unboundedFollowing)}


@dataclass
class Running:
    """A running value: ``kind`` is sum, max, min, first or last (known value); ``frame`` one of FRAMES."""

    kind: str
    value: Column
    frame: str = "so_far"

    def over(self, window, value: Column | None = None) -> Column:
        value = self.value if value is None else value
        f = {"sum": F.sum, "max": F.max, "min": F.min, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}[self.kind]
        return f(value).over(window)

    def total(self, order: Column) -> Column:
        """The value of a whole (partition, group)."""
        if self.kind in ("first", "last"):
            known = self.value.isNotNull()
            return (F.min_by if self.kind == "first" else F.max_by)(F.when(known, self.value), F.when(known, order))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)

    def joined(self, earlier: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.when(earlier.isNull(), own).when(own.isNull(), earlier).otherwise(earlier + own)
        if self.kind in ("max", "min"):
            return (F.greatest if self.kind == "max" else F.least)(earlier, own)
        return F.coalesce(earlier, own) if self.kind == "first" else F.coalesce(own, earlier)


class Scan:
    """Rows in an order that has no ties within a group (null groups are groups)."""

    def __init__(self, rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], segmented: bool = False, segment_rows: int = SEGMENT_ROWS):
        self.group, self.order, self.segmented = group, order, segmented
        if segmented:
            n = max(2, -(-rows.count() // segment_rows))
            rows = materialize(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "segments")
        self._rows = rows

    @property
    def rows(self) -> DataFrame:
        return self._rows.drop("_part")

    def map(self, f) -> Scan:
        """Row-wise changes that keep group and order."""
        out = Scan.__new__(Scan)
        out.group, out.order, out.segmented, out._rows = self.group, self.order, self.segmented, f(self._rows)
        return out

    def add(self, **running: Running) -> Scan:
        if not self.segmented:
            w = Window.partitionBy(*self.group).orderBy(*self.order)
            return self.map(lambda rows: rows.withColumns({n: r.over(w.rowsBetween(*FRAMES[r.frame])) for n, r in running.items()}))
        order = F.struct(*self.order)
        # values become columns first, so that totals and running values read the same
        named = self._rows.withColumns({f"_v_{n}": r.value for n, r in running.items()})
        held = {n: Running(r.kind, F.col(f"_v_{n}"), r.frame) for n, r in running.items()}
        totals = named.groupBy("_part", *self.group).agg(*(r.total(order).alias(f"_t_{n}") for n, r in held.items()))
        over = Window.partitionBy(*self.group).orderBy("_part")
        carried = {n: r.over(over.rowsBetween(*FRAMES["all" if r.frame == "all" else "before"]), F.col(f"_t_{n}")).alias(f"_c_{n}") for n, r in held.items()}
        carry = totals.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(self.group)), *carried.values())
        match = reduce(and_, [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(self.group))])
        rows = named.join(carry, match)
        w = Window.partitionBy("_part", *self.group).orderBy(*self.order)
        out = {n: F.col(f"_c_{n}") if r.frame == "all" else r.joined(F.col(f"_c_{n}"), r.over(w.rowsBetween(*FRAMES[r.frame]))) for n, r in held.items()}
        gone = ["_p", *(f"_g{k}" for k in range(len(self.group))), *(f"_{x}_{n}" for n in held for x in "vc")]
        return self.map(lambda _: rows.withColumns(out).drop(*gone))


def hot(rows: DataFrame, group: tuple[str, ...], most: int = HOT_ROWS) -> bool:
    """Whether a group has more rows than ``most``."""
    return not rows.groupBy(*group).count().where(F.col("count") > most).isEmpty()
