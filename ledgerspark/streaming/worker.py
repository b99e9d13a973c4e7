"""Structured Streaming: logs are tailed, new records normalized, and only what they touch rebuilt.

The driver looks at names, sizes, times and ends of files; tasks read, number and hash what is new, and verify
what was read before.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.operators import records
from ledgerspark.operators.graph import related
from ledgerspark.operators.storage import exists, materialize
from ledgerspark.operators.token_counts import TokenCounter
from ledgerspark.sources import content, jsonl


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Raw records of all logs below a path, as they are appended, numbered by range with ``counted=false``."""
    jsonl.register(spark)
    return spark.readStream.format("agent_jsonl").options(path=path, **options).load()


class Context:
    """What earlier batches leave behind for each file, a table for each batch.

    A batch that is repeated after a failure reads the table of the one before it and writes its own again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, number: int) -> DataFrame | None:
        at = f"{self.path}/batch={number - 1}"
        return self.spark.read.schema(records.MEMORY).parquet(at) if number and exists(self.spark, at) else None

    def keep(self, number: int) -> None:
        """The context after a batch without records is the one before."""
        if (before := self.before(number)) is not None:
            before.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def events(self, raw: DataFrame, number: int, salt: str = "", counter: TokenCounter | None = None) -> DataFrame:
        """Events of a batch as a table; the context after it is kept."""
        before = self.before(number)
        touched = raw.select("source_id", "generation").distinct()
        own = before.join(touched, ["source_id", "generation"], "left_semi") if before is not None else None
        carried = materialize(records.carry(records.project(raw, salt), own), "carried")
        after = records.remember(carried)
        if before is not None:
            after = after.unionByName(before.join(touched, ["source_id", "generation"], "left_anti"))
        after.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return materialize(records.finish(carried, counter), "events")


class Leaves:
    """Hashes of what was read of each file, by ranges, a table for each batch that read something."""

    def __init__(self, spark: SparkSession, path: str, step: int = jsonl.RANGE):
        self.spark, self.path, self.step = spark, path, step
        self.notes = f"{path.removeprefix('file://')}-rewritten"
        self.verified_at = time.monotonic()

    def kept(self) -> DataFrame | None:
        """The leaves that count."""
        return content.latest(self.spark.read.schema(f"{content.LEAVES}, batch int").parquet(self.path)) if exists(self.spark, self.path) else None

    def add(self, raw: DataFrame, number: int) -> None:
        """Hash what a batch read, from its first record of a file to its last.

        Each byte is hashed once, so a later append hides no change before it.
        """
        read = raw.groupBy("path", "generation").agg(F.min("byte_start").alias("begin"), F.max("byte_end").alias("size"))
        content.measured(content.ranges(read, self.step), count=False).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def verify(self, seconds: float) -> None:
        """Every so many seconds (0: never), leave a note for each file whose bytes aren't those that were read."""
        if not seconds or time.monotonic() - self.verified_at < seconds:
            return
        self.verified_at = time.monotonic()
        kept = self.kept()
        if kept is not None:
            for r in content.verify(materialize(kept, "kept")).select("path", "generation").distinct().toLocalIterator():
                jsonl.note_rewritten(self.notes, r.path, r.generation)


def start(
    raw_path: str, spark: SparkSession, rebuild: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, salt: str = "", seconds: float = 2,
    edges: Callable[[], DataFrame] | None = None, available_now: bool = False, counter: TokenCounter | None = None, **options: str,
) -> StreamingQuery:
    """Run until stopped: ``rebuild(sessions, events, number)`` gets the sessions that a batch touches, with all
    that are linked to them.  A batch that is repeated after a failure has the same number, so writes
    that are keyed by it happen once.  Contents are verified every ``verifySeconds``; a file that isn't what it was is
    read as a new generation by the batch after."""
    context, leaves = Context(spark, f"{checkpoint}/context"), Leaves(spark, f"{checkpoint}/leaves", int(options.get("rangeBytes", jsonl.RANGE)))
    verify_seconds = float(options.get("verifySeconds", 300))
    options |= {"counted": "false", "rewritten": leaves.notes}

    def batch(df: DataFrame, number: int) -> None:
        # the batch is a table first: its files are read once, whatever becomes of them
        leaves.verify(verify_seconds)
        read = materialize(df, "raw")
        if read.isEmpty():
            return context.keep(number)
        before = context.before(number)
        known = before.groupBy(F.col("source_id").alias("path"), "generation").agg(F.max("ordinal").alias("ordinal")) if before is not None else None
        raw = content.numbered(read, known=known).withColumnRenamed("path", "source_id")
        leaves.add(read, number)
        events = context.events(raw, number, salt, counter)
        touched = events.where("session_id is not null").selectExpr("session_id as session").distinct()
        if not touched.isEmpty():
            rebuild(related(edges(), touched) if edges else touched, events, number)

    writer = tail(spark, raw_path, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
