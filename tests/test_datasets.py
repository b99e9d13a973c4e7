"""Datasets against DuckDB, filters, exports and graph rules."""

import csv
import io
import json
from datetime import datetime

import duckdb
import pytest

from ledgerspark.engine import Engine
from ledgerspark.operators import export, graph
from ledgerspark.operators.filters import Filters
from ledgerspark.plans import catalog
from ledgerspark.plans.fixtures import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    r = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in r.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found, names: sorted(tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in found)
    assert rows([tuple(x) for x in got.collect()], got.columns) == rows(r.fetchall(), columns)


def test_filters():
    f = Filters.parse({"timezone": "Europe/London", "start": "2026-03-29", "end": "2026-03-29", "other": "x"})
    assert f.bounds() == (datetime(2026, 3, 29), datetime(2026, 3, 29, 23))
    for bad in ({"timezone": "Mars/Base"}, {"start": "2026-02-30"}, {"start": "2026-03-02", "end": "2026-03-01"}, {"scope": "all"}, {"sort": "name; drop"}):
        with pytest.raises(ValueError):
            Filters.parse(bad)


def test_cyclic_scope(spark):
    edges = spark.createDataFrame([("root", "child"), ("child", "grandchild"), ("grandchild", "root")], "parent_id string, child_id string")
    roots = spark.createDataFrame([("root",), ("alone",)], "root string")
    got = {(r.root, r.node) for r in graph.reach(edges, roots).collect()}
    assert got == {("root", "root"), ("root", "child"), ("root", "grandchild"), ("alone", "alone")}
    up = {(r.session, r.ancestor) for r in graph.ancestors(edges, roots.selectExpr("root as session")).collect()}
    assert up == {("root", "child"), ("root", "grandchild")}


def test_exports(spark, sf):
    e = Engine(spark, catalog.tables(spark, sf))
    rows = json.loads(e.export("rankings", "json"))["rows"]
    assert rows and all(r["tool_fact_ids"] for r in rows) and rows[0]["estimated_result_tokens"] is None
    df = spark.createDataFrame([("=1+1", 0, None), ("\tx", 5, "ok")], "name string, n int, note string")
    got = list(csv.DictReader(io.StringIO(export.to_csv(df, "UTC"))))
    assert got[0]["name"] == "'=1+1" and got[0]["n"] == "0" and got[0]["note"] == "" and got[1]["name"] == "'\tx" and got[0]["display_timezone"] == "UTC"
    with pytest.raises(ValueError):
        e.dataset("nope")


def test_files(spark, sf, tmp_path):
    e = Engine(spark, catalog.tables(spark, sf))
    e.export("usage", "json", path=str(tmp_path / "u"))
    assert spark.read.json(str(tmp_path / "u")).count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_paging(spark, sf):
    t = catalog.tables(spark, sf)
    first, second = ([r.id for r in catalog.ds.tools(t, limit=10, offset=o).collect()] for o in (0, 10))
    both = [r.id for r in catalog.ds.tools(t, limit=20).collect()]
    assert first + second == both and len(catalog.ds.tools(t, limit=0).collect()) == 1


def test_whole_engine(spark, tmp_path):
    line = lambda s, kind, **p: json.dumps({"timestamp": f"2026-09-01T12:00:{s:02d}Z", "type": kind, "payload": p}) + "\n"
    used = {"input_tokens": 100, "output_tokens": 20, "total_tokens": 120}
    (tmp_path / "a.jsonl").write_text(line(0, "session_meta", id="root", cwd="/w") + line(1, "token_usage_record", response_id="r1", usage=used) + line(2, "response_item", type="function_call", call_id="c", name="x", arguments="{}") + line(3, "response_item", type="function_call_output", call_id="c", output='{"success": true}'))
    (tmp_path / "b.jsonl").write_text(line(4, "session_meta", id="kid", parent_thread_id="root") + line(5, "token_usage_record", response_id="r2", usage=used))
    e = Engine(spark)
    e.rebuild(e.import_logs(str(tmp_path)))
    assert {r.session_id for r in e.session_scope("root", True).collect()} == {"kid", "root"}
    assert e.usage_summary("root").first().total_tokens == 120 and e.usage_summary("root", True).first().total_tokens == 240
    assert [(r.name, r.status) for r in e.dataset("tools").collect()] == [("x", "succeeded")]
    assert {r.session_id: r.reported_total_tokens for r in e.dataset("sessions").collect()} == {"root": 120, "kid": 120}
    assert e.overview()["totals"].first().facts == 2 and e.dataset("timeline").count() == 5
