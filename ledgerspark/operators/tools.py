"""Tool invocations: calls, outputs and completions correlated, repeats and likely retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.exprs import display_name, elapsed_ms, key, sum_or_unknown

from .graph import ancestors
from .ledger import physical_merge
from .scan import Running, Scan

#: Completed items that are tool invocations.
TOOL_TYPES = ("commandExecution", "mcpToolCall", "dynamicToolCall", "fileChange", "webSearch", "imageView", "collabAgentToolCall", "sleep", "imageGeneration", "functionCallOutput")

#: The parts of an event's data that correlation reads.
DATA = "name string, tool string, server string, namespace string, type string, status string, success boolean, exitCode bigint, explicit_error boolean, durationMs double, parent string, parent_call_id string, parentCallId string, pattern_hash string, pattern_kind string, argument_size struct<bytes:bigint,characters:bigint,tokens:bigint>, result_size struct<bytes:bigint,characters:bigint,tokens:bigint,method:string,completeness:string>, read_patterns array<struct<pattern_hash:string,pattern_kind:string>>"


def tool_rows(events: DataFrame) -> DataFrame:
    """Typed rows of tool events, and only of items that are invocations."""
    rows = events.where(F.col("kind").isin("tool_call", "tool_output", "item_completed")).withColumn("d", F.from_json("data_json", DATA))
    return rows.where((F.col("kind") != "item_completed") | F.col("d.type").isin(*TOOL_TYPES)).drop("data_json")


def owners(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``session_id, native_id, owner``: copies of an invocation belong to the one topmost ancestor
    that has it too; without just one, to their own session."""
    has = rows.select("native_id", "session_id").distinct()
    up = ancestors(edges, has.select(F.col("session_id").alias("session")).distinct())
    other = has.select(F.col("native_id").alias("_n"), F.col("session_id").alias("ancestor"))
    found = has.join(up, has.session_id == up.session).join(other, "ancestor").where("native_id = _n").select("native_id", "session_id", "ancestor")
    above = found.select("native_id", "session_id", F.col("ancestor").alias("candidate"))
    rank = up.select(F.col("session").alias("candidate"), F.col("ancestor").alias("_above"))
    lower = above.join(rank, "candidate").join(found.select(F.col("native_id").alias("_n"), F.col("session_id").alias("_s"), F.col("ancestor").alias("_a")), (F.col("native_id") == F.col("_n")) & (F.col("session_id") == F.col("_s")) & (F.col("_above") == F.col("_a")), "left_semi")
    tops = above.join(lower.select("native_id", "session_id", "candidate").distinct(), ["native_id", "session_id", "candidate"], "left_anti")
    only = tops.groupBy("native_id", "session_id").agg(F.count("*").alias("n"), F.min("candidate").alias("owner")).where("n = 1").drop("n")
    return has.join(only, ["native_id", "session_id"], "left").select("native_id", "session_id", F.coalesce("owner", "session_id").alias("owner"))


def correlate(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per invocation from typed tool rows (see ``tool_rows``)."""
    physical = [c for c in ("source_id", "byte_start", "digest") if c in rows.columns]
    if len(physical) == 3:
        loose = rows.where("source_id is null").withColumn("refs", F.array("record_id"))
        rows = physical_merge(rows.where("source_id is not null"), physical).unionByName(loose)
    else:
        rows = rows.withColumn("refs", F.array("record_id"))
    rows = rows.withColumn("native_id", F.coalesce("native_id", F.concat(F.lit("unknown-record:"), F.col("record_id").cast("string"))))
    parents = rows.where("d.parent is not null").select(F.col("d.parent").alias("parent_id"), F.col("session_id").alias("child_id"))
    known = owners(rows, edges.select("parent_id", "child_id").unionByName(parents).distinct())
    rows = rows.join(known, ["native_id", "session_id"])
    call, item, output = (F.col("kind") == k for k in ("tool_call", "item_completed", "tool_output"))
    order = F.struct(F.coalesce(F.col("timestamp").cast("string"), F.lit("")), F.col("record_id"))
    late = F.struct(item.cast("int"), order)  # outputs before items
    early = F.struct((~call).cast("int"), order)  # calls before items
    failed = F.coalesce(F.col("d.explicit_error"), F.lit(False)) | F.coalesce(~F.col("d.success"), F.lit(False)) | F.coalesce(F.col("d.status").isin("failed", "error"), F.lit(False)) | F.coalesce(F.col("d.exitCode") != 0, F.lit(False))
    good = F.coalesce(F.col("d.success"), F.lit(False)) | F.coalesce(F.col("d.exitCode") == 0, F.lit(False)) | F.coalesce(F.col("d.status").isin("completed", "succeeded"), F.lit(False))
    verdict = F.when(call, None).when(failed, "failed").when(good, "succeeded")
    time = F.when(~call & (F.col("d.durationMs") >= 0), F.col("d.durationMs"))
    seen = F.struct("turn_id", "timestamp", "model", "project", "d")
    first = lambda value, when, by: F.min_by(F.when(when, value), F.when(when, by))
    last = lambda value, when, by: F.max_by(F.when(when, value), F.when(when, by))
    arg = F.coalesce(F.col("d.argument_size.bytes").isNotNull(), F.lit(False)) & ~output
    res = F.coalesce(F.col("d.result_size.bytes").isNotNull(), F.lit(False)) & item
    patterned = F.col("d.pattern_hash").isNotNull() & ~output
    reads = F.when(item, F.col("d.read_patterns"))
    group = rows.groupBy("owner", "native_id").agg(
        F.coalesce(first(seen, call, order), last(seen, item, order), F.min_by(seen, order)).alias("rep"),
        F.count_if(call).alias("calls"), F.count_if(output).alias("outputs"), last(verdict, verdict.isNotNull(), late).alias("verdict"), last(time, time.isNotNull(), late).alias("duration_ms"),
        first(F.col("d.argument_size"), arg, early).alias("argument"), last(F.col("d.result_size"), res, order).alias("item_result"), first(F.struct("d.pattern_hash", "d.pattern_kind"), patterned, early).alias("pattern"),
        F.max(F.when(~call, F.col("timestamp"))).alias("completed_at"), F.array_distinct(F.flatten(F.collect_list(reads))).alias("read_patterns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))
    chunk = rows.where(output).groupBy("owner", "native_id", "source_id").agg(
        F.count("*").alias("n"), F.max("record_id").alias("top"), *[sum_or_unknown(F.col(f"d.result_size.{m}")).alias(m) for m in ("bytes", "characters", "tokens")],
        F.min_by("d.result_size.method", order).alias("method"), F.max((F.col("d.result_size.completeness") == "partial").cast("int")).alias("cut"))
    fullest = chunk.groupBy("owner", "native_id").agg(F.max_by(F.struct("n", "bytes", "characters", "tokens", "method", "cut"), F.struct("n", "top")).alias("chunk"))
    rows = group.join(fullest, ["owner", "native_id"], "left")
    d = F.col("rep.d")
    from_item = F.col("item_result").isNotNull()
    result = lambda m: F.when(from_item, F.col("item_result")[m]).otherwise(F.col("chunk")[m])
    parent = F.coalesce(d["parent_call_id"], d["parentCallId"])
    name = display_name(d["name"], d["tool"], d["type"], F.coalesce(d["namespace"], d["server"]))
    start = F.col("rep.timestamp")
    opaque = F.col("name").isin("functions.exec", "exec")
    pending = F.when(F.col("outputs") > 0, "unknown_outcome").when(F.col("calls") > 0, "pending").otherwise("unknown")
    rows = rows.withColumn("name", name)
    return rows.select(
        key(F.col("owner"), F.col("native_id")).alias("id"), F.col("owner").alias("session_id"), "native_id", F.col("rep.turn_id").alias("turn_id"), "name", start.alias("timestamp"), "completed_at",
        F.coalesce("verdict", pending).alias("status"), "duration_ms", F.when(F.col("calls") > 0, elapsed_ms(F.try_to_timestamp(start.cast("string")), F.try_to_timestamp(F.col("completed_at").cast("string")))).alias("wall_ms"),
        F.col("argument.bytes").alias("argument_bytes"), result("bytes").alias("result_bytes"), F.col("argument.characters").alias("argument_characters"), result("characters").alias("result_characters"),
        F.col("argument.tokens").alias("argument_tokens"), result("tokens").alias("result_tokens"), F.coalesce(result("method"), F.lit("unknown")).alias("estimate_method"),
        F.coalesce(F.when(from_item, F.col("item_result.completeness")), F.when(F.col("chunk").isNull(), "unknown").when(F.col("chunk.cut") == 1, "partial").otherwise("retained_content")).alias("completeness"),
        F.when(from_item, 1).otherwise(F.coalesce("chunk.n", F.lit(0))).cast("bigint").alias("output_chunks"), F.col("pattern.pattern_hash").alias("pattern_hash"), F.col("pattern.pattern_kind").alias("pattern_kind"),
        F.when(parent.isNotNull(), "child").when(opaque, "outer_opaque").otherwise("observed").alias("level"), F.when(parent.isNotNull(), key(F.col("owner"), parent)).alias("parent_id"),
        F.when(opaque, "nested_unobserved").when(F.col("native_id").startswith("unknown-record:"), "missing_native_identity").otherwise("observed").alias("coverage"),
        "read_patterns", F.col("rep.model").alias("model"), F.col("rep.project").alias("project"), "refs")


def occurrences(calls: DataFrame) -> DataFrame:
    """A row for each call and each of its patterns: its own and those of what it read."""
    own = F.when(F.col("pattern_hash").isNotNull(), F.array(F.struct("pattern_hash", F.coalesce("pattern_kind", F.lit("exact_arguments")).alias("pattern_kind")))).otherwise(F.array().cast("array<struct<pattern_hash:string,pattern_kind:string>>"))
    every = F.concat(F.coalesce(F.col("read_patterns"), F.array().cast("array<struct<pattern_hash:string,pattern_kind:string>>")), own) if "read_patterns" in calls.columns else own
    rows = calls.withColumn("p", F.explode(every)).select("id", "session_id", "timestamp", "status", F.col("p.pattern_hash").alias("pattern_hash"), F.col("p.pattern_kind").alias("kind"))
    return rows.where("pattern_hash is not null").dropDuplicates(["id", "pattern_hash"])


def retries(calls: DataFrame, window_seconds: float = 600, segmented: bool = False) -> DataFrame:
    """``pattern_hash, tool_id, kind, likely_retry, previous_tool_id``.

    A likely retry repeats, in its session and within the window, a call that failed; unknown times
    don't count.  ``segmented`` is for repeats of one call that may not fit a task (see ``scan``).
    """
    rows = occurrences(calls).withColumn("_at", F.coalesce(F.col("timestamp").cast("string"), F.lit("")))
    rows = Scan(rows, ("session_id", "pattern_hash"), ("_at", "id"), segmented).add(before=Running("last", F.struct("id", "status", "timestamp"), "before")).rows
    gap = elapsed_ms(F.col("before.timestamp"), F.col("timestamp"))
    retry = F.coalesce((F.col("before.status") == "failed") & (gap <= window_seconds * 1000), F.lit(False)).cast("int")
    return rows.select("pattern_hash", F.col("id").alias("tool_id"), "kind", retry.alias("likely_retry"), F.col("before.id").alias("previous_tool_id"), "session_id")
