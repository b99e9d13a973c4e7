"""Merges of keyed rows: versions, upserts, anti joins, newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_versions(old: DataFrame, new: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """New rows with what becomes of them: ``insert``, ``supersede`` (an older version exists), ``keep``."""
    before = old.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    action = F.when(F.col("_was").isNull(), "insert").when(F.col(digest).eqNullSafe(F.col("_old")), "keep").otherwise("supersede")
    return new.join(before, keys, "left").withColumn("action", action).drop("_old", "_was")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; a new value wins where it is known."""
    rest = [c for c in new.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest])
    return o.join(new, keys, "full_outer").select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in rest])


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys (name and signature) weren't there before."""
    return new.join(old.select(*keys), keys, "left_anti")


def missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that are no longer there."""
    return old.join(new.select(*keys), keys, "left_anti")


def newest(rows: DataFrame, keys: list[str], most: int, by: str = "record_id") -> DataFrame:
    """The newest rows of each key, with their ``place``; partial limits run before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def current_view(records: DataFrame, current: DataFrame, generations: DataFrame) -> DataFrame:
    """Records that count, with their generation: those that are the current interpretation of their bytes, and
    rows of databases (``table_name``) that no later version replaced (``superseded``)."""
    own = [c for c in records.columns if c not in ("table_name", "superseded")] if "table_name" in records.columns else records.columns
    lines = records.join(current.select("record_id"), "record_id", "left_semi").select(*own)
    if "table_name" in records.columns:
        lines = lines.unionByName(records.where("table_name is not null and superseded = 0").join(current.select("record_id"), "record_id", "left_anti").select(*own))
    return lines.join(generations, "source_id")


def catalog(threads: DataFrame, hosts: DataFrame) -> DataFrame:
    """Catalogue threads with the kind of their host; those elsewhere have metadata only."""
    rows = threads.join(hosts, "host_id", "left").withColumn("host_kind", F.coalesce("host_kind", F.lit("unknown")))
    return rows.withColumn("coverage", F.when(F.col("host_kind") == "local", "unknown").otherwise("remote_metadata_only"))


def health(sources: DataFrame) -> DataFrame:
    return sources.agg(F.sum(F.col("failed").cast("int")).alias("failed_sources"), F.coalesce(F.sum("pending_bytes"), F.lit(0)).alias("pending_bytes"), F.count("*").alias("sources"))


def primary_stream(rows: DataFrame, generation: str) -> DataFrame:
    """Each session's main copy of a counter: not superseded, then longest, then newest."""
    size = rows.groupBy("session_id", generation).agg(F.count("*").alias("n"), F.min("record_id").alias("first_record"), F.max("superseded").alias("superseded"))
    best = F.row_number().over(Window.partitionBy("session_id").orderBy("superseded", F.desc("n"), F.desc("first_record")))
    return size.withColumn("_place", best).where("_place = 1").drop("_place")


def edges_of(meta: DataFrame) -> DataFrame:
    """``parent_id, child_id`` that session headers name."""
    rows = meta.select(F.get_json_object("data_json", "$.parent").alias("parent_id"), F.coalesce(F.get_json_object("data_json", "$.id"), F.col("session_id")).alias("child_id"))
    return rows.where("parent_id <> child_id").distinct()


def labels_of(log: DataFrame) -> DataFrame:
    """The last label of each session from an append-only log."""
    return log.groupBy("session_id").agg(F.max_by("label", "updated_at").alias("label"), F.max("updated_at").alias("updated_at"))
