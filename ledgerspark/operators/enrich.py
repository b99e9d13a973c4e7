"""What databases say about sessions, merged with what logs say.

Databases are read whole in one snapshot; a row that changed replaces the one before.  A value that is known
wins over one that isn't, and later kinds of sources over earlier ones: logs, state, catalogue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.exprs import epoch_to_utc

from . import merge, records

SESSION = {"cwd": "string", "project_id": "string", "created_at": "string", "updated_at": "string", "archived": "bigint", "reported_state_tokens": "bigint", "host_id": "string", "host_kind": "string", "coverage": "string"}


def _part(df: DataFrame, rank: int, session: str, **known: Column) -> DataFrame:
    return df.select(F.col(session).cast("string").alias("id"), F.lit(rank).alias("rank"), *[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in SESSION.items()]).where("id is not null")


def sessions(logs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``id`` and the columns of ``SESSION`` for every session that a log (``id, cwd``) or a database names."""
    found = [_part(logs, 0, "id", cwd=F.col("cwd"))]
    if "threads" in tables:
        found.append(_part(tables["threads"], 1, "id", cwd=F.col("cwd"), project_id=F.col("project_id"), created_at=epoch_to_utc(F.col("created_at")), updated_at=epoch_to_utc(F.col("updated_at")),
                           archived=F.col("archived"), reported_state_tokens=F.col("tokens_used")))
    if "local_thread_catalog" in tables:
        threads = tables["local_thread_catalog"].withColumnRenamed("thread_id", "id")
        hosts = tables.get("local_thread_catalog_hosts")
        hosts = threads.sparkSession.createDataFrame([], "host_id string, host_kind string") if hosts is None else hosts.select("host_id", "host_kind")
        found.append(_part(merge.catalog(threads, hosts), 2, "id", **{c: F.col(c) for c in ("cwd", "project_id", "host_id", "host_kind", "coverage")}))
    for t in ("thread_turns", "thread_items", "thread_realtime_items"):
        if t in tables:
            found.append(_part(tables[t].select("thread_id").distinct(), 0, "thread_id"))
    every = reduce(DataFrame.unionByName, found)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("rank")))
    rows = every.groupBy("id").agg(*[last(c).alias(c) for c in SESSION])
    return rows.withColumns({"coverage": F.coalesce("coverage", F.lit("unknown")), "host_kind": F.coalesce("host_kind", F.lit("local"))})


def edges(logs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``parent_id, child_id`` of log headers and spawned threads."""
    if "thread_spawn_edges" not in tables:
        return logs
    spawned = tables["thread_spawn_edges"].select(F.col("parent_thread_id").alias("parent_id"), F.col("child_thread_id").alias("child_id"))
    return logs.unionByName(spawned.where("parent_id <> child_id")).distinct()


def projects(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    if "project_roots" not in tables:
        return spark.createDataFrame([], "id string, root string")
    return tables["project_roots"].select(F.col("project_id").alias("id"), F.col("path").alias("root")).distinct()


def turns(tables: dict[str, DataFrame]) -> DataFrame | None:
    if "thread_turns" not in tables:
        return None
    return tables["thread_turns"].select(F.col("thread_id").alias("session_id"), F.col("turn_id").alias("id"), "status", epoch_to_utc(F.col("started_at")).alias("started_at"), epoch_to_utc(F.col("completed_at")).alias("completed_at"), "duration_ms")


def items(tables: dict[str, DataFrame], salt: str = "") -> DataFrame | None:
    """Events (``EVENTS`` columns and ``table_name``) of items that history databases hold; malformed ones
    have an error instead of a kind.  Usage is never taken from them."""
    found = []
    for t in ("thread_items", "thread_realtime_items"):
        if t in tables:
            rows = records.item_events(tables[t], salt)
            good = F.col("error").isNull()
            own = {"source_id": F.lit(t), "generation": F.lit(1), "byte_start": F.col("rollout_ordinal"), "byte_end": F.col("rollout_ordinal"), "ordinal": F.coalesce("updated_at_ordinal", "rollout_ordinal"),
                   "digest": F.sha2("item_json", 256), "kind": F.when(good, "item_completed"), "session_id": F.col("thread_id"), "turn_id": F.col("turn_id"), "timestamp": epoch_to_utc(F.col("created_at_ms"), True),
                   "native_id": F.col("item_id"), "data_json": F.col("data_json"), "error": F.col("error")}
            kinds = dict(c.split() for c in records.EVENTS.split(", "))
            found.append(rows.select(*[own.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], F.lit(t).alias("table_name")))
    return reduce(DataFrame.unionByName, found) if found else None


def index_events(lines: DataFrame) -> DataFrame:
    """Events of a session index: raw records ``(…, raw, error)`` of ``{"id", "updated_at"}`` objects."""
    v = records.Json(F.try_parse_json("raw"))
    rows = lines.withColumns({"native_id": v.text("id"), "timestamp": v.text("updated_at")})
    good = F.col("native_id").isNotNull() & F.col("error").isNull()
    own = {"kind": F.when(good, "session_index"), "session_id": F.when(good, F.col("native_id")), "timestamp": F.when(good, F.col("timestamp")), "native_id": F.when(good, F.col("native_id")),
           "data_json": F.when(good, "{}"), "error": F.coalesce("error", F.when(~good, "unsupported_index_record"))}
    kinds = dict(c.split() for c in records.EVENTS.split(", "))
    return rows.select(*[own[c].cast(k).alias(c) if c in own else (F.col(c) if c in records.PLACE else F.lit(None).cast(k).alias(c)) for c, k in kinds.items()])
