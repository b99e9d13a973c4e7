"""Canonical tables on shared storage, of which a batch rebuilds only what it touches.

A table is parquet files of buckets.  A batch writes the buckets that it changes to a folder of its own, and when
all tables are there one small file, the snapshot, is replaced: it names each bucket's folder.  So facts, gaps,
calls and patterns of a batch appear together or not at all, and a reader that opened the tables before
reads on what it opened.  A batch that was committed before isn't done again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.engine import Engine, numbered
from ledgerspark.operators import enrich, graph, merge, tools
from ledgerspark.operators.datasets import Tables
from ledgerspark.operators.storage import folders, materialize, read_text, remove, replace_text

#: Parts that rows are dealt over; a batch rewrites those that it touches.
BUCKETS = 64
#: Derived tables, whose rows are dealt by session.
NAMES = ("facts", "gaps", "calls", "patterns")
#: Tables of what relates sessions and files: links, labels of components, and which file told of which session.
LINKS, LABELS, FILES = "parent_id string, child_id string", "session string, component string", "source_id string, generation int, session_id string"


class Store:
    """Events by batch, and derived tables by bucket of session.

    A batch's events are a folder of its own, so a batch that is repeated replaces them.  Sessions that it
    touches, all that are linked to them, and those that a file told of which it begins anew are derived from
    all their events, and their buckets written again.
    """

    def __init__(self, spark: SparkSession, path: str, retry_seconds: float = 600, buckets: int = BUCKETS):
        self.spark, self.path, self.retry_seconds, self.buckets = spark, path.rstrip("/"), retry_seconds, buckets

    # the snapshot

    def snapshot(self) -> dict:
        """Version (the last batch) and the folders of each table's buckets; version -1 before the first batch."""
        text = read_text(self.spark, f"{self.path}/snapshot.json")
        return json.loads(text) if text else {"version": -1, "tables": {}, "old": []}

    def read(self, name: str, snapshot: dict | None = None) -> DataFrame:
        """A table of a snapshot (the newest one)."""
        table = (snapshot or self.snapshot())["tables"].get(name)
        if table is None:
            raise FileNotFoundError(f"{self.path} has no table {name} yet")
        return self._files(table["schema"], list(table["buckets"].values()))

    def _files(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in sorted(paths))) if paths else self.spark.createDataFrame([], schema)

    def _held(self, snapshot: dict, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets; none before the first batch."""
        found = snapshot["tables"].get(name, {"buckets": {}})["buckets"]
        return self._files(schema, [p for b, p in found.items() if buckets is None or int(b) in buckets])

    def bucket(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, draft: dict, number: int, name: str, rows: DataFrame, key: str, gone: DataFrame) -> None:
        """Buckets of ``rows`` and of ``gone`` anew: old rows but those whose ``key`` is in ``gone``, and ``rows``."""
        schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
        touched = [r.b for r in rows.select(self.bucket(key).alias("b")).unionByName(gone.select(self.bucket(key).alias("b"))).distinct().collect()]
        old = self._held(self.snapshot(), name, schema, touched).join(gone.select(F.col(key).alias("_gone")), F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        at = f"data/{number}/{name}"
        made = old.unionByName(rows).withColumn("bucket", self.bucket(key))
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{at}")
        there = {f.partition("=")[2]: f"{at}/{f}" for f in folders(self.spark, f"{self.path}/{at}") if f.startswith("bucket=")}
        kept = {b: p for b, p in draft["tables"].get(name, {"buckets": {}})["buckets"].items() if int(b) not in touched}
        draft["tables"][name] = {"schema": schema, "buckets": kept | there}

    # reading

    def events(self, snapshot: dict | None = None) -> DataFrame | None:
        """Events of all committed batches."""
        version = (snapshot or self.snapshot())["version"]
        return None if version < 0 else self._events(version).drop("batch", "bucket")

    def _events(self, version: int) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/events").parquet(f"{self.path}/events").where(F.col("batch") <= version)

    def edges(self, snapshot: dict | None = None) -> DataFrame:
        """``parent_id, child_id`` of all headers so far."""
        return self._held(snapshot or self.snapshot(), "edges", LINKS)

    # a batch

    def rebuild(self, sessions: DataFrame, events: DataFrame, number: int) -> None:
        """Take a batch of events, and derive ``session``s that it touches (and what goes with them) anew."""
        before = self.snapshot()
        if number <= before["version"]:
            return
        draft = {"version": number, "tables": dict(before["tables"])}
        own = numbered(events.where("kind is not null"), number).withColumn("bucket", self.bucket("session_id"))
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/events/batch={number}")
        own = self._events(number).where(F.col("batch") == number)
        nothing = self.spark.createDataFrame([], "x string")
        links = materialize(merge.edges_of(own.where("kind = 'session_meta'")).join(self.edges(before), ["parent_id", "child_id"], "left_anti"), "links")
        self._write(draft, number, "edges", links, "child_id", nothing.withColumnRenamed("x", "child_id"))
        labels = self._held(before, "labels", LABELS)
        moved = materialize(graph.merge_components(labels, links), "moved")
        self._write(draft, number, "labels", moved, "session", moved.select("session"))
        labels = self._held(draft, "labels", LABELS)
        told = materialize(own.select("source_id", "generation", "session_id").distinct(), "told")
        files = self._held(before, "files", FILES)
        again = told.groupBy(F.col("source_id").alias("_s")).agg(F.max("generation").alias("_g"))
        lost = files.join(again, F.col("source_id").eqNullSafe(F.col("_s"))).where("generation < _g").select(F.col("session_id").alias("session"))
        new = told.join(files, [told[c].eqNullSafe(files[c]) for c in ("source_id", "generation", "session_id")], "left_anti")
        self._write(draft, number, "files", new, "source_id", nothing.withColumnRenamed("x", "source_id"))
        touched = graph.expand(labels, sessions.select("session").unionByName(lost))
        touched = materialize(touched.select(F.col("session").alias("session_id")).withColumn("bucket", self.bucket("session_id")), "touched")
        # the bucket is part of the join, so that only the folders of touched buckets are read
        rows = self._events(number).drop("batch").join(touched, ["session_id", "bucket"], "left_semi").drop("bucket")
        rows = materialize(self._latest(rows, self._held(draft, "files", FILES)), "events")
        facts, gaps, calls = Engine(self.spark).derive(rows, self._held(draft, "edges", LINKS))
        calls = materialize(calls, "calls")
        for name, derived in zip(NAMES, (facts, gaps, calls, tools.retries(calls, self.retry_seconds)), strict=True):
            self._write(draft, number, name, derived, "session_id", touched.select("session_id"))
        self._commit(before, draft)

    def _commit(self, before: dict, draft: dict) -> None:
        """Replace the snapshot; what the one before the last named and none names now goes."""
        named = lambda tables: {p for t in tables.values() for p in t["buckets"].values()}
        now, was = named(draft["tables"]), named(before["tables"])
        draft["old"] = sorted(was - now)
        replace_text(self.spark, f"{self.path}/snapshot.json", json.dumps(draft))
        for p in before["old"]:
            if p not in now and p not in was:
                remove(self.spark, f"{self.path}/{p}")

    @staticmethod
    def _latest(events: DataFrame, files: DataFrame) -> DataFrame:
        """``superseded`` as it is now: a later batch may have begun a new generation of a file."""
        newest = files.groupBy(F.col("source_id").alias("_s")).agg(F.max("generation").alias("_g"))
        rows = events.join(newest, F.col("source_id").eqNullSafe(F.col("_s")))
        return rows.withColumn("superseded", (F.col("generation") < F.col("_g")).cast("int")).drop("_s", "_g")

    def tables(self, databases: dict[str, DataFrame] | None = None, labels: DataFrame | None = None) -> Tables:
        """What the store holds, with what databases and labels say of sessions, for datasets; one snapshot of it."""
        at, held = self.snapshot(), databases or {}
        facts, gaps, calls, patterns = (self.read(n, at) for n in NAMES)
        rows = self.events(at)
        logs = rows.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.min_by(F.col("project"), F.when(F.col("project").isNotNull(), F.col("record_id"))).alias("cwd"))
        return Tables(
            usage_facts=facts, tool_calls=calls, gaps=gaps, patterns=patterns, edges=enrich.edges(self.edges(at), held), records=rows, events=rows.selectExpr(*["try_cast(timestamp as timestamp_ntz) as timestamp" if c == "timestamp" else c for c in rows.columns], "record_id as id"),
            sessions=enrich.sessions(logs, held), projects=enrich.projects(self.spark, held), labels=self.spark.createDataFrame([], "session_id string, label string") if labels is None else labels,
            fact_sources=facts.selectExpr("id as fact_id", "explode(refs) as record_id"), tool_sources=calls.selectExpr("id as tool_id", "explode(refs) as record_id"), extra={"turns": enrich.turns(held)})
