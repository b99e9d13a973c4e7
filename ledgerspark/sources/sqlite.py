"""Tables of SQLite files, read only, in one snapshot."""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = (("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def connect(path: str) -> sqlite3.Connection:
    """A connection that can't write, inside a snapshot."""
    c = sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True, timeout=2, isolation_level=None)
    c.execute("PRAGMA query_only = ON")
    c.execute("BEGIN")
    return c


def reflect(path: str) -> dict[str, dict[str, str]]:
    """Columns and Spark types of every table."""
    with closing(connect(path)) as c:
        names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        return {n: {r[1]: next((k for w, k in KINDS if w in (r[2] or "").upper()), "string") for r in c.execute(f"PRAGMA table_info({quoted(n)})")} for n in names}


def signature(path: str) -> str:
    """Hash of the tables and columns that a file has."""
    shape = {t: sorted(cols) for t, cols in reflect(path).items()}
    return hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.fields = options["path"], options["table"], schema.fields

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join('"' + f.name.replace('"', '""') + '"' for f in self.fields)
        make = [{"long": int, "bigint": int, "double": float}.get(f.dataType.typeName(), str) for f in self.fields]
        with closing(connect(partition.value)) as c:
            table = self.table.replace('"', '""')
            for row in c.execute(f'SELECT {columns} FROM "{table}"'):
                yield tuple(None if v is None else m(v) for v, m in zip(row, make, strict=True))


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        columns = reflect(self.options["path"]).get(self.options["table"])
        if columns is None:
            raise ValueError(f"no table {self.options['table']}")
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return ", ".join(f"`{c}` {k}" for c, k in columns.items() if not wanted or c in wanted)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)


def rows(spark: SparkSession, path: str, table: str, wanted: dict[str, str], required: tuple[str, ...]) -> DataFrame | None:
    """The wanted columns (missing ones null); None if the table or a required column isn't there."""
    has = reflect(path).get(table, {})
    if any(c not in has for c in required):
        return None
    register(spark)
    there = [c for c in wanted if c in has]
    df = spark.read.format("sqlite_ro").options(path=path, table=table, columns=",".join(there)).load()
    return df.select(*[F.col(c).cast(k).alias(c) if c in has else F.lit(None).cast(k).alias(c) for c, k in wanted.items()])


#: Tables that state, catalogue and history files may have.
STATE = {
    "threads": ({"id": "string", "cwd": "string", "project_id": "string", "created_at": "bigint", "updated_at": "bigint", "archived": "bigint", "tokens_used": "bigint", "rollout_path": "string"}, ("id",)),
    "thread_spawn_edges": ({"parent_thread_id": "string", "child_thread_id": "string", "status": "string"}, ("parent_thread_id", "child_thread_id")),
    "project_roots": ({"project_id": "string", "path": "string", "position": "bigint"}, ("project_id", "path")),
}
CATALOG = {
    "local_thread_catalog": ({"host_id": "string", "thread_id": "string", "cwd": "string", "project_id": "string", "source_created_at": "bigint", "source_updated_at": "bigint", "observation_sequence": "bigint"}, ("thread_id",)),
    "local_thread_catalog_hosts": ({"host_id": "string", "host_kind": "string"}, ("host_id",)),
}
HISTORY = {
    "thread_turns": ({"thread_id": "string", "turn_id": "string", "status": "string", "started_at": "bigint", "completed_at": "bigint", "duration_ms": "double", "rollout_ordinal": "bigint", "rollout_byte_offset": "bigint", "rollout_end_ordinal": "bigint"}, ("thread_id", "turn_id")),
    "thread_realtime_items": ({"thread_id": "string", "turn_id": "string", "item_id": "string", "rollout_ordinal": "bigint", "created_at_ms": "bigint", "item_json": "string", "item_type": "string", "updated_at_ordinal": "bigint"}, ("thread_id", "item_id", "item_json")),
    "thread_items": ({"thread_id": "string", "turn_id": "string", "item_id": "string", "rollout_ordinal": "bigint", "created_at_ms": "bigint", "item_json": "string", "item_type": "string", "updated_at_ordinal": "bigint"}, ("thread_id", "item_id", "item_json")),
}


KINDS_OF = {"state_database": STATE, "catalog_database": CATALOG, "history_database": HISTORY}


def adapter(spark: SparkSession, path: str, tables: dict) -> tuple[dict[str, DataFrame], list[str]]:
    """The known tables of a file, and what isn't supported: tables that lack a required column, none that is known,
    and a timeline that holds rows."""
    has, found, bad = reflect(path), {}, []
    for name, (wanted, required) in tables.items():
        df = rows(spark, path, name, wanted, required)
        if df is not None:
            found[name] = df
        elif name in has:
            bad.append(name)
    if not has:
        bad.append("empty_schema")
    if tables is CATALOG and "thread_timeline_ledger" in has:
        with closing(connect(path)) as c:
            if c.execute("SELECT 1 FROM thread_timeline_ledger LIMIT 1").fetchone():
                bad.append("nonempty_thread_timeline_ledger")
    return found, bad
