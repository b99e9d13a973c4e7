"""Pages of an ordered dataset that is kept.

The rows are written once in their order: range-partitioned by sampled splitters, sorted within, a folder for each
part.  A cursor holds the part and the last row's key, so a page reads the part it is in and those after it that it
needs, and skips nothing.  The number of rows of each part also finds the part of an offset.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Rows of a part, about; rows of a page at most.
PART_ROWS, MOST = 50_000, 500


@dataclass(frozen=True)
class By:
    """A column of the order; unknown values come first if ascending and last if descending."""

    column: str
    descending: bool = False

    @property
    def sort(self) -> Column:
        return F.desc_nulls_last(self.column) if self.descending else F.asc_nulls_first(self.column)

    def after(self, value: Column) -> Column:
        c = F.col(self.column)
        return value.isNotNull() & (c.isNull() | (c < value)) if self.descending else F.when(value.isNull(), c.isNotNull()).otherwise(c > value)


class Pages:
    """Pages of ``df`` in the order ``by``, which should have no ties (an id is its last column)."""

    def __init__(self, df: DataFrame, by: list[By], part_rows: int = PART_ROWS):
        self.by, self.kinds = by, dict(df.dtypes)
        n = max(1, -(-df.count() // part_rows))
        sort = [b.sort for b in by]
        kept = df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
        self.table = materialize(kept, "pages", "_part")
        # as many rows as there are parts
        self.sizes = {r["_part"]: r["count"] for r in sorted(self.table.groupBy("_part").count().collect(), key=lambda r: r["_part"])}

    def _rows(self, first: int, rows: int, skip: Column | None, offset: int = 0) -> DataFrame:
        """``rows`` rows from a part on; those before ``skip`` says so are left out."""
        parts, seen = [], -offset if skip is None else -self.sizes.get(first, 0)
        for p, size in self.sizes.items():
            if p >= first and (seen < rows or not parts):
                parts.append(p)
                seen += size
        found = self.table.where(F.col("_part").isin(parts) if parts else F.lit(False))
        found = found.where(skip) if skip is not None else found
        found = found.orderBy("_part", *[b.sort for b in self.by])
        return (found.offset(offset) if offset else found).limit(rows)

    def after(self, cursor: str | None = None, limit: int = 100) -> tuple[list, str | None]:
        """A page of rows and the cursor of the next one, None at the end."""
        limit = min(max(int(limit), 1), MOST)
        at = json.loads(base64.urlsafe_b64decode(cursor)) if cursor else None
        if at is None:
            rows = self._rows(min(self.sizes, default=0), limit, None).collect()
        else:
            rows = self._rows(at["part"], limit, self._beyond(at["key"]) | (F.col("_part") > at["part"])).collect()
        return [r.asDict() for r in rows], self._cursor(rows[-1]) if len(rows) == limit else None

    def frame(self, cursor: str | None, limit: int = 100) -> DataFrame:
        """The same page as a DataFrame."""
        at = json.loads(base64.urlsafe_b64decode(cursor)) if cursor else None
        limit = min(max(int(limit), 1), MOST)
        found = self._rows(min(self.sizes, default=0), limit, None) if at is None else self._rows(at["part"], limit, self._beyond(at["key"]) | (F.col("_part") > at["part"]))
        return found.drop("_part")

    def at(self, offset: int, limit: int = 100) -> DataFrame:
        """A page by its offset: sizes of parts say where it begins."""
        left = max(0, int(offset))
        for p, size in self.sizes.items():
            if left < size:
                return self._rows(p, min(max(int(limit), 1), MOST), None, left).drop("_part")
            left -= size
        return self._rows(0, 1, F.lit(False)).drop("_part")

    def _cursor(self, row) -> str:
        key = [None if row[b.column] is None else str(row[b.column]) for b in self.by]
        return base64.urlsafe_b64encode(json.dumps({"part": row["_part"], "key": key}).encode()).decode()

    def _beyond(self, key: list[str | None]) -> Column:
        """Rows after a key: equal in the first columns and after it in the next one."""
        values = [F.lit(k).cast(self.kinds[b.column]) for k, b in zip(key, self.by, strict=True)]
        ways = []
        for k, b in enumerate(self.by):
            same = [F.col(x.column).eqNullSafe(v) for x, v in zip(self.by[:k], values, strict=False)]
            ways.append(reduce(and_, [*same, F.coalesce(b.after(values[k]), F.lit(False))]))
        return reduce(or_, ways)
