"""Registered queries against their SQL on tables unlike the small ones."""

import os

import duckdb
import pytest

from ledgerspark.plans import catalog
from ledgerspark.plans.fixtures import TABLES


def differs(spark, sf, folder, name, view, sql):
    """Rows that only one of a query and its SQL has, where ``sql`` over the small tables makes a table anew."""
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if t == view:
            c.execute(f"copy (select * from ({sql.format(f"read_parquet('{sf}/{t}.parquet')")})) to '{path}' (format parquet)")
        else:
            os.symlink(f"{sf}/{t}.parquet", path)
        c.execute(f"create view {t} as select * from '{path}'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = c.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    want, got = sorted(map(repr, want.fetchall())), sorted(repr(tuple(r)) for r in got.select(*names).collect())
    assert want
    return [r for r in want if r not in got] + [r for r in got if r not in want] or len(want) - len(got)


def test_daily_bars_of_mostly_unknown_times(spark, sf, tmp_path):
    """Facts without a time that outweigh every day don't shorten the days' bars."""
    more = "select * from {} union all select 900000 + range, 0, 'system', repeat('x', 4000) from range(50)"
    assert not differs(spark, sf, tmp_path, "daily_bars", "conversations", more)


@pytest.mark.parametrize("name", ["ledger_offset", "ledger_with_responses"])
def test_records_of_sessions_that_share_ids(spark, sf, tmp_path, name):
    """Conversations of more than a hundred turns have the record ids of the next one."""
    more = "select * from {0} union all select conv_id - 1, 100 + turn, role, text from {0} where conv_id % 2 = 1"
    assert not differs(spark, sf, tmp_path, name, "conversations", more)
