"""Exports: JSON with metadata, CSV that spreadsheets can't run, drill-down ids."""

from __future__ import annotations

import csv
import io
import json
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.exprs import csv_safe

UNITS = "tokens, milliseconds and UTF-8 bytes; empty means unknown"
NOTE = "Subtotals cover known facts only; see the coverage counts."


def with_ids(rows: DataFrame, facts: DataFrame, keys: list[str] | str, out: str, fact_id: str = "id") -> DataFrame:
    """Aggregate rows with the ordered ids of the facts behind them, in one join; none: empty text.

    A row's ids are one text, as readers of exports expect it.  Where a row may have more than a text holds,
    ``write`` puts the ids into rows of their own.
    """
    keys = [keys] if isinstance(keys, str) else keys
    ids = facts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_join(F.array_sort(F.collect_list(F.col(fact_id).cast("string"))), ",").alias(out))
    match = [rows[k].eqNullSafe(ids[f"_{k}"]) for k in keys]
    return rows.join(ids, reduce(and_, match), "left").drop(*[f"_{k}" for k in keys]).withColumn(out, F.coalesce(out, F.lit("")))


def safe_text(df: DataFrame) -> DataFrame:
    return df.select(*[csv_safe(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def _plain(value):
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value


def to_json(df: DataFrame, metadata: dict) -> str:
    rows = ({k: _plain(v) for k, v in r.asDict(True).items()} for r in df.toLocalIterator())
    return json.dumps({"metadata": metadata, "rows": list(rows)}, ensure_ascii=False)


def to_csv(df: DataFrame, timezone: str = "UTC") -> str:
    """One page of rows as text; unknown is empty and zero is 0."""
    out = io.StringIO()
    safe = safe_text(df).withColumns({"display_timezone": F.lit(timezone), "units": F.lit(UNITS), "measurement_note": F.lit(NOTE)})
    writer = csv.writer(out)
    writer.writerow(safe.columns)
    for r in safe.toLocalIterator():
        writer.writerow(["" if v is None else _plain(v) for v in r])
    return out.getvalue()


def write(df: DataFrame, path: str, kind: str, timezone: str = "UTC", ids: dict[str, DataFrame] | None = None) -> None:
    """A whole dataset as files, written by the executors; the ids behind aggregate rows go to folders beside it."""
    for name, rows in (ids or {}).items():
        write(rows, f"{path}-{name}", kind, timezone)
    if kind == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        safe = safe_text(df).withColumns({"display_timezone": F.lit(timezone), "units": F.lit(UNITS), "measurement_note": F.lit(NOTE)})
        safe.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {kind}")
