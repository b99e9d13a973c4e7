"""Counters and responses of a session, by joins over running totals.

A counter shows a running total; so does the state that a response reports with itself.  The response up
to which a counter goes is the one with that total (less an offset, where counting began before
responses did): an equality join.  What lies between two counters is a difference of running sums of responses at
both, which one ordered pass over responses and counters gives.  The offset changes only where
a counter's step equals what responses in its time add up to, so it is the last such row's.

These rules see all rows at once, where the definition goes row by row.  They agree unless a session's
matches go back in time, a running total occurs twice, or an offset would change at a matched row;
such sessions are named, and folded.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.exprs import all_zero, key, valid
from ledgerspark.schema import TOKEN_FIELDS

from .scan import Running, Scan
from .storage import materialize

VECTOR = "struct<" + ", ".join(f"{f}: bigint" for f in TOKEN_FIELDS) + ">"
#: The parts of an observation's data that accounting reads.
DATA = f"usage {VECTOR}, thread_token_usage {VECTOR}, total_token_usage {VECTOR}, last_token_usage {VECTOR}, own_counter_origin boolean, parent string"


def parsed(rows: DataFrame) -> DataFrame:
    """Observations with ``d`` (see DATA) and ``mark``, which equal copies of a counter row share."""
    rows = rows.withColumn("d", F.from_json("data_json", DATA))
    return rows.withColumn("mark", key(F.col("turn_id"), F.col("timestamp"), F.to_json("d.total_token_usage"), F.to_json("d.last_token_usage")))


def each(f) -> Column:
    return F.struct(*[f(c).alias(c) for c in TOKEN_FIELDS])


def minus(a: Column, b: Column) -> Column:
    return each(lambda c: a[c] - b[c])


def same(a: Column, b: Column) -> Column:
    """Equal in every category; unknown equals unknown."""
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in TOKEN_FIELDS])


def consistent(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(valid({c: v[c] for c in TOKEN_FIELDS}), F.lit(False))


def unknown(v: Column) -> Column:
    return reduce(and_, [v[c].isNull() for c in TOKEN_FIELDS])


def moves(v: Column) -> Column:
    return reduce(or_, [F.coalesce(v[c] != 0, F.lit(False)) for c in TOKEN_FIELDS])


def lower(v: Column) -> Column:
    return reduce(or_, [F.coalesce(v[c] < 0, F.lit(False)) for c in TOKEN_FIELDS])


def name(v: Column) -> Column:
    """A text that equal vectors share."""
    return F.concat_ws(",", *[F.coalesce(v[c].cast("string"), F.lit("-")) for c in TOKEN_FIELDS])


#: Running sums and numbers of unknown values of each category, as one struct.
def sums(prefix: str) -> Column:
    return F.struct(*[F.coalesce(F.col(f"{prefix}s_{c}"), F.lit(0)).alias(f"s_{c}") for c in TOKEN_FIELDS], *[F.coalesce(F.col(f"{prefix}u_{c}"), F.lit(0)).alias(f"u_{c}") for c in TOKEN_FIELDS])


def nothing() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(f"{p}_{c}") for p in "su" for c in TOKEN_FIELDS])


def between(low: Column, high: Column) -> Column:
    """What was added between two states of running sums; unknown where one part is."""
    return each(lambda c: F.when(high[f"u_{c}"] == low[f"u_{c}"], high[f"s_{c}"] - low[f"s_{c}"]))


def answered(answers: DataFrame) -> DataFrame:
    """Responses with ``outcome``: null where they count, else their gap's code."""
    u = F.col("d.usage")
    return answers.withColumn("outcome", F.when(~consistent(u), "invalid_usage_categories").when(unknown(u), "unknown_usage_categories"))


def account(counters: DataFrame, answers: DataFrame, segmented: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(outcomes, covered, doubtful)``.

    ``counters`` are parsed rows of one stream a session, with ``o1, o2`` for their order before ``record_id`` and
    a ``row`` that no two share (record ids may be shared);
    ``answers`` parsed responses that count.  ``outcomes`` has a row for each counter: ``outcome`` (a gap's code,
    a fact's method, or null), ``also_decrease``, ``tokens`` and the previous row's ``prev``.  ``covered``
    (``row, answer``) are the responses behind facts, ``doubtful`` the sessions that must be folded.
    """
    counters = counters.withColumn("ok", consistent(F.col("d.total_token_usage")))
    invalid = counters.where("not ok")
    time = F.coalesce("timestamp", F.lit(""))
    # one order of responses and counters: how many responses there were, and what they add up to, at each row
    left = answers.select("session_id", time.alias("t"), F.lit(0).alias("side"), "record_id", F.lit(None).cast("long").alias("row"), F.lit(1).cast("long").alias("one"), F.col("d.usage").alias("usage"), F.struct("d.thread_token_usage").alias("shown"), "turn_id")
    right = counters.where("ok").select("session_id", time.alias("t"), F.lit(1).alias("side"), "record_id", "row", F.lit(None).cast("long").alias("one"), F.lit(None).cast(VECTOR).alias("usage"), F.lit(None).cast(f"struct<thread_token_usage:{VECTOR}>").alias("shown"), "turn_id")
    answer = F.col("side") == 0
    line = Scan(left.unionByName(right), ("session_id",), ("t", "side", "record_id"), segmented).add(
        k=Running("sum", F.col("one")), shown_last=Running("last", F.col("shown")), first_at=Running("min", F.when(answer, F.col("t")), "all"),
        **{f"s_{c}": Running("sum", F.when(answer, F.coalesce(F.col("usage")[c], F.lit(0)))) for c in TOKEN_FIELDS}, **{f"u_{c}": Running("sum", F.when(answer, F.col("usage")[c].isNull().cast("long"))) for c in TOKEN_FIELDS})
    line = line.rows.select("session_id", "side", "record_id", "row", "t", "turn_id", F.coalesce("k", F.lit(0)).alias("k"), sums("").alias("sum"), F.col("shown_last.thread_token_usage").alias("thread"), "shown", "first_at")
    line = materialize(line, "line")
    points = line.where(answer).select(F.col("session_id").alias("_as"), F.col("k").alias("at"), F.col("t").alias("at_time"), F.col("turn_id").alias("at_turn"), F.col("sum").alias("at_sum"), name(F.col("shown.thread_token_usage")).alias("at_name"), F.col("record_id").alias("answer")).where(F.col("shown.thread_token_usage").isNotNull())
    # with equal totals of two responses a match isn't one
    twice = points.groupBy("_as", "at_name").count().where("count > 1").select(F.col("_as").alias("session_id"))
    seen = line.where("side = 1").select(F.col("row").alias("_r"), "k", "sum", F.col("thread").alias("hi_thread"), "first_at")
    rows = counters.where("ok").join(seen, F.col("row") == F.col("_r")).drop("_r").withColumn("total", F.col("d.total_token_usage"))
    own = F.coalesce("d.own_counter_origin", F.lit(False))
    rows = rows.withColumn("own", own).withColumn("inherited", F.coalesce(F.col("d.parent") != "", F.lit(False)) & ~own).withColumn("has", F.col("first_at").isNotNull())
    # a response without a time has the least one; then no interval is known
    rows = rows.withColumn("timed", ~F.col("has") | (F.coalesce(F.col("timestamp") != "", F.lit(False)) & (F.col("first_at") != "")))
    zero = all_zero(F.col("total.input_tokens"), F.col("total.output_tokens"), F.col("total.total_tokens"))
    scan = Scan(rows, ("session_id",), ("o1", "o2", "record_id"), segmented).add(
        prev=Running("last", F.struct("record_id", "timestamp", "turn_id", "model", "project", "refs", "mark", "total", "k", "sum"), "before"), n=Running("sum", F.lit(1).cast("long")))
    first, total = F.col("prev").isNull(), F.col("total")
    scan = scan.map(lambda r: r.withColumn("delta", each(lambda c: F.when(first, total[c]).otherwise(total[c] - F.col("prev.total")[c]))))
    scan = scan.map(lambda r: r.withColumn("drop", F.col("timed") & ~first & lower(F.col("delta"))).withColumn("zero", F.col("timed") & zero))
    scan = scan.add(last_drop=Running("max", F.when(F.col("drop"), F.col("n"))), last_zero=Running("max", F.when(F.col("zero"), F.col("n"))))
    open_ = F.coalesce(F.col("prev.timestamp") == "", F.lit(True))  # no time before: all responses so far
    low = F.when(open_, 0).otherwise(F.col("prev.k"))
    low_sum = F.when(open_, nothing()).otherwise(F.col("prev.sum"))
    scan = scan.map(lambda r: r.withColumn("uncertain", F.coalesce("last_drop", F.lit(0)) > F.coalesce("last_zero", F.lit(0))).withColumn("low", low).withColumn("some", F.col("k") > F.col("low")).withColumn("in_time", between(low_sum, F.col("sum"))))
    goes = F.col("timed") & ~F.col("zero") & ~F.col("inherited") & ~F.col("uncertain") & F.col("has")
    scan = scan.map(lambda r: r.withColumn("goes", goes).withColumn("equal", F.col("goes") & F.col("some") & same(F.col("delta"), F.col("in_time"))))
    scan = scan.map(lambda r: r.withColumn("shift", F.when(F.col("equal") & consistent(F.col("hi_thread")), minus(total, F.col("hi_thread")))))
    scan = scan.add(offset=Running("last", F.col("shift"), "before"))
    offset = F.coalesce("offset", each(lambda c: F.lit(0).cast("long")))
    scan = scan.map(lambda r: r.withColumn("offset", offset).withColumn("target", name(minus(total, F.col("offset")))))
    at = (F.col("session_id").eqNullSafe(F.col("_as"))) & (F.col("target") == F.col("at_name")) & F.col("goes")
    # of equal totals one is taken; such sessions are doubtful anyway
    one = points.groupBy("_as", "at_name").agg(F.min_by(F.struct("at", "at_time", "at_turn", "at_sum"), "at").alias("m"))
    scan = scan.map(lambda r: r.join(one, at, "left").drop("_as", "at_name"))
    reached = F.coalesce((F.col("m.at_time") <= F.col("timestamp")) | F.col("m.at_turn").eqNullSafe(F.col("turn_id")), F.lit(False))
    scan = scan.map(lambda r: r.withColumn("hit", F.col("m").isNotNull() & reached))
    event = F.when(F.col("hit"), F.struct(F.col("m.at").alias("at"), F.col("m.at_sum").alias("sum"))).when(F.col("shift").isNotNull(), F.struct(F.col("k").alias("at"), F.col("sum").alias("sum")))
    scan = scan.add(cursor=Running("last", event, "before"))
    rows = materialize(scan.rows, "matched")
    back = F.col("hit") & (F.col("m.at") < F.coalesce("cursor.at", F.lit(0)))
    jumps = F.col("hit") & F.col("shift").isNotNull() & ~same(F.col("shift"), F.col("offset"))
    doubtful = twice.unionByName(rows.where(back | jumps).select("session_id")).distinct()
    began = F.coalesce("cursor.at", F.lit(0))
    rows = rows.withColumn("from", F.when(F.col("hit"), began).otherwise(F.col("low"))).withColumn("to", F.when(F.col("hit"), F.col("m.at")).otherwise(F.col("k")))
    spent = F.when(F.col("hit"), between(F.coalesce("cursor.sum", nothing()), F.col("m.at_sum"))).otherwise(F.col("in_time"))
    rows = rows.withColumn("covers", F.col("has") & (F.col("to") > F.col("from"))).withColumn("rest", F.when(F.col("covers"), minus(F.col("delta"), spent)).otherwise(F.col("delta")))
    quiet = F.col("goes") & ~F.col("hit") & ~F.col("equal")
    new = first & ~F.col("covers")
    method = F.when(first & ~F.col("own"), "unallocated_historical").when(F.col("covers"), "reported_interval_residual").otherwise("reported_cumulative_delta")
    none = F.lit(None).cast("string")
    outcome = (
        F.when(~F.col("timed"), "unknown_response_interval").when(F.col("zero"), none).when(F.col("inherited"), "inherited_cumulative_unallocated")
        .when(F.col("uncertain"), F.when(~(F.col("some") & same(F.col("in_time"), total)), "unresolved_epoch_interval"))
        .when(quiet & ~moves(F.col("delta")), none).when(quiet & (F.col("timestamp") >= F.col("first_at")), "response_checkpoint_mismatch")
        .when(F.col("covers") & ~consistent(F.col("rest")), "response_interval_mismatch").when(~(moves(F.col("rest")) | new), none)
        .when(~consistent(F.col("rest")), "invalid_usage_categories").when(unknown(F.col("rest")), "unknown_usage_categories").otherwise(method))
    rows = rows.withColumn("outcome", outcome).withColumnRenamed("drop", "also_decrease").withColumnRenamed("rest", "tokens")
    outcomes = rows.select("session_id", "row", "record_id", "turn_id", "timestamp", "model", "project", "refs", "mark", "d", "outcome", "also_decrease", "tokens", "prev", "covers", "from", "to")
    lost = invalid.select("session_id", "row", "record_id", "turn_id", "timestamp", "model", "project", "refs", "mark", "d", F.lit("null_or_invalid_cumulative").alias("outcome"), F.lit(False).alias("also_decrease"))
    outcomes = materialize(outcomes.unionByName(lost, allowMissingColumns=True), "outcomes")
    facts = outcomes.where("covers and outcome = 'reported_interval_residual' or covers and outcome = 'unallocated_historical'")
    span = facts.select("row", "session_id", F.explode(F.sequence(F.col("from") + 1, F.col("to"))).alias("k"))
    numbered = line.where(answer).select(F.col("session_id").alias("_as"), F.col("k").alias("_k"), F.col("record_id").alias("answer"))
    covered = span.join(numbered, F.col("session_id").eqNullSafe(F.col("_as")) & (F.col("k") == F.col("_k"))).select("row", "answer")
    return outcomes, covered, doubtful
