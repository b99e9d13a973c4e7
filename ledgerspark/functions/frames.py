"""Python rows to pandas frames that Arrow takes as they are."""

from __future__ import annotations

import pandas as pd


def frame(rows: list[dict], ddl: str) -> pd.DataFrame:
    """Columns of a DDL text; missing values are null, whole numbers stay whole."""
    made = {}
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        values = [r.get(name) for r in rows]
        made[name] = pd.Series(pd.array(values, "Int64") if kind in ("int", "bigint") else values, dtype=None if kind in ("int", "bigint") else object)
    return pd.DataFrame(made)
