"""Queries that write logs or a database of their own and read them back through the sources.

They show the sources at work; logs, the streams' results and the database lie in the shared folder.
"""

from __future__ import annotations

import os
import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.operators import provenance, records
from ledgerspark.operators.storage import exists, materialize, shared_dir
from ledgerspark.sources import content, jsonl, sqlite
from ledgerspark.streaming import worker

from .fixtures import load


def _log(spark: SparkSession, d: str) -> str:
    """Logs that tasks write to the shared folder, as a pattern: a file for each session, a header and then its counters."""
    rows = load(spark, d, "fx_observations")
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // 250_000))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal")) == 1
    rows = rows.repartition(n, "session_id").withColumn("first", first).sortWithinPartitions("session_id", "ordinal")
    time = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp")
    total = F.struct("input_tokens", F.when(F.col("input_tokens").isNotNull(), F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), (F.col("input_tokens") + F.coalesce("output_tokens", F.lit(0))).alias("total_tokens"))
    text = lambda kind, payload: F.to_json(F.struct(time, F.lit(kind).alias("type"), payload.alias("payload")), {"ignoreNullFields": "false"})
    head = text("session_meta", F.struct(F.col("session_id").alias("id"), F.lit("/p0").alias("cwd")))
    counter = text("event_msg", F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage")).alias("info")))
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = rows.select("session_id", F.explode(F.when(F.col("first"), F.array(head, counter)).otherwise(F.array(counter))).alias("value"))
    lines.write.partitionBy("session_id").text(path)
    path = path.removeprefix("file://")
    os.makedirs(os.path.join(path, "session_id=open"))
    with open(os.path.join(path, "session_id=open", "part-open"), "w") as f:
        f.write('{"not finished')
    return os.path.join(path, "*", "part-*")


#: The same lines in SQL, with their places, for the oracles.
LINES = """
o as (select session_id, ordinal, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' ts, coalesce(cast(input_tokens as varchar), 'null') i,
  case when input_tokens is null then 'null' else cast(coalesce(output_tokens, 0) as varchar) end o, coalesce(cast(input_tokens + coalesce(output_tokens, 0) as varchar), 'null') t from fx_observations),
w as (select session_id, 0 as kind, ordinal, ts, i, o, t, '{"timestamp":"' || ts || '","type":"session_meta","payload":{"id":"' || session_id || '","cwd":"/p0"}}' as line
    from (select *, row_number() over (partition by session_id order by ordinal) n from o) where n = 1
  union all select session_id, 1, ordinal, ts, i, o, t, '{"timestamp":"' || ts || '","type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":' || i || ',"output_tokens":' || o || ',"total_tokens":' || t || '}}}}' from o),
lines as (select *, cast(row_number() over z as bigint) ord, cast(sum(strlen(line) + 1) over z as bigint) stop, sha256(line || chr(10)) digest from w window z as (partition by session_id order by kind, ordinal rows unbounded preceding))"""
PLACES = "ord as ordinal, digest, cast(null as varchar) error"
RECORDS = f"with {LINES} select 1 as generation, stop - strlen(line) - 1 as byte_start, stop as byte_end, {PLACES} from lines"
EVENTS = f"""with {LINES} select ord as ordinal, case kind when 0 then 'session_meta' else 'cumulative_usage' end kind, session_id, ts as timestamp,
  case kind when 0 then '{{"cwd":"/p0","id":"' || session_id || '","identity_epoch":1,"compactions":0,"parent":null}}'
  else '{{"total_token_usage":{{"input_tokens":' || i || ',"cached_input_tokens":null,"cache_write_input_tokens":null,"output_tokens":' || o || ',"reasoning_output_tokens":null,"total_tokens":' || t || '}},"last_token_usage":null,"own_counter_origin":false,"identity_epoch":1,"compactions":0,"parent":null}}' end data_json,
  cast(null as varchar) error from lines"""
REWRITE = f"""with {LINES}, h as (select session_id, coalesce(max(case when stop <= total // 2 then stop end), 0) half, coalesce(max(case when stop <= total // 2 then ord end), 0) n
    from (select *, max(stop) over (partition by session_id) total from lines) group by 1),
  r as (select 1 as generation, stop - strlen(line) - 1 as byte_start, stop as byte_end, ord as ordinal, digest from lines join h using (session_id) where stop <= half
    union all select case when half > 0 then 2 else 1 end, stop - strlen(line) - 1 - half, stop - half, ord - n, digest from lines join h using (session_id) where stop > half)
  select *, cast(null as varchar) error, generation > 1 as again from r"""
DATABASE = "select id, cwd, cast(null as varchar) project_id, cast(1 as bigint) tokens_used from fx_sessions"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return jsonl.load(spark, path)


def jsonl_tail_batch(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, _log(spark, d)).select("generation", "byte_start", "byte_end", "ordinal", "digest", "error")


def normalize_records(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, _log(spark, d)).withColumnRenamed("path", "source_id")
    return records.normalize(raw).select("ordinal", "kind", "session_id", "timestamp", "data_json", "error")


def sqlite_ro_scan(spark: SparkSession, d: str) -> DataFrame:
    folder = os.path.join(shared_dir(spark).removeprefix("file://"), f"db-{uuid.uuid4().hex}")
    os.makedirs(folder)
    path = os.path.join(folder, "state_1.sqlite")
    rows = [(r.id, r.cwd) for r in load(spark, d, "fx_sessions").toLocalIterator()]
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE threads (id TEXT PRIMARY KEY, cwd TEXT, tokens_used INTEGER)")
    c.executemany("INSERT INTO threads VALUES (?, ?, 1)", rows)
    c.commit()
    c.close()
    return sqlite.adapter(spark, path, sqlite.STATE)[0]["threads"].select("id", "cwd", "project_id", "tokens_used")


def _stream(spark: SparkSession, path: str, steps) -> DataFrame:
    """Records that a tail gives over several appends or rewrites, numbered and kept by batch."""
    out, state = (f"{shared_dir(spark)}/{k}-{uuid.uuid4().hex}" for k in ("out", "state"))

    def batch(df: DataFrame, number: int) -> None:
        read = materialize(df.drop("raw"), "raw")
        known = None
        if exists(spark, out):
            known = spark.read.parquet(out).where(F.col("batch") < number).groupBy("path", "generation").agg(F.max("ordinal").alias("ordinal"))
        content.numbered(read, known=known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    for step in steps:
        step()
        raw = worker.tail(spark, path, counted="false")
        raw.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("path", "batch")


def _halves(spark: SparkSession, d: str, rewrite: bool) -> DataFrame:
    """A tail over logs of which tasks first put the first half, then append the second or put it instead."""
    logs = jsonl.listed(_log(spark, d))
    to = os.path.join(shared_dir(spark).removeprefix("file://"), f"tail-{uuid.uuid4().hex}")
    os.makedirs(to)

    def step(second: bool):
        def copy(log: str) -> None:
            size = os.path.getsize(log)
            half = jsonl.last_line_end(log, 0, size // 2)
            begin, end = (half, size) if second else (0, half)
            target = os.path.join(to, log.split(os.sep)[-2])
            with open(log, "rb") as f, open(target, "r+b" if second else "wb") as g:
                f.seek(begin)
                g.truncate(0 if rewrite else begin)  # a task that is repeated writes the same
                g.seek(0, os.SEEK_END)
                while left := end - f.tell():
                    g.write(f.read(min(left, jsonl.BLOCK)))

        return lambda: spark.sparkContext.parallelize(logs, len(logs)).foreach(copy)

    return _stream(spark, os.path.join(to, "session_id=*"), [step(False), step(True)])


def stream_append(spark: SparkSession, d: str) -> DataFrame:
    return _halves(spark, d, False)


def stream_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return _halves(spark, d, True).withColumn("again", F.col("generation") > 1)


#: Every seventh session's file gets another byte in its middle.
VERIFIED = f"""with {LINES}, t as (select *, max(stop) over (partition by session_id) total from lines)
  select session_id, ord as ordinal, case when cast(substr(session_id, 2) as int) % 7 = 0 and stop - strlen(line) - 1 <= total // 2 and total // 2 < stop then 'source_changed' else 'digest_matches' end verification from t"""


def provenance_verified(spark: SparkSession, d: str) -> DataFrame:
    """All records of all logs, verified where they stand after some files were changed by one byte."""
    path = _log(spark, d)
    rows = _raw(spark, path).select(F.col("path").alias("source_id"), "generation", "byte_start", "byte_end", "digest", F.col("ordinal").alias("record_id"), F.lit("record").alias("kind"))
    rows = materialize(rows, "places")
    logs = [p for p in jsonl.listed(path) if (n := p.split(os.sep)[-2].partition("=s")[2]).isdigit() and int(n) % 7 == 0]

    def touch(log: str) -> None:
        at = os.path.getsize(log) // 2
        with open(log, "r+b") as f:
            f.seek(at)
            f.write(b"~")  # no log has this sign, and a task that is repeated writes the same

    spark.sparkContext.parallelize(logs, max(1, len(logs))).foreach(touch)
    found = provenance.verify(rows)
    return found.select(F.regexp_extract("source_id", "session_id=([^/]+)", 1).alias("session_id"), F.col("record_id").alias("ordinal"), "verification")


QUERIES = {f.__name__: f for f in (jsonl_tail_batch, normalize_records, sqlite_ro_scan, stream_append, stream_rewrite, provenance_verified)}
ORACLE = {"jsonl_tail_batch": RECORDS, "normalize_records": EVENTS, "sqlite_ro_scan": DATABASE, "stream_append": RECORDS, "stream_rewrite": REWRITE, "provenance_verified": VERIFIED}
