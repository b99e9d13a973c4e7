"""Profiles of sources, and an audit that recomputes the ledger's totals independently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.schema import TOKEN_FIELDS


def families(rows: DataFrame, kind: Column, payload: Column) -> DataFrame:
    """Records by kind and sorted payload keys."""
    keys = F.array_join(F.array_sort(F.json_object_keys(payload)), ",")
    return rows.groupBy(F.concat(kind, F.lit("/"), F.coalesce(keys, F.lit(""))).alias("family")).agg(F.count("*").alias("records"))


def counters(rows: DataFrame, fields: list[str], order: str = "ordinal") -> DataFrame:
    """Per session: records, repeats of the totals before, and decreases."""
    before = F.lag(F.struct(F.lit(1).alias("there"), *fields)).over(Window.partitionBy("session_id").orderBy(order))
    rows = rows.withColumn("_b", before)
    same, less = F.col("_b").isNotNull(), F.lit(False)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col("_b")[f])
        less = less | F.coalesce(F.col(f) < F.col("_b")[f], F.lit(False))
    return rows.groupBy("session_id").agg(F.count("*").alias("records"), F.sum(F.coalesce(same, F.lit(False)).cast("int")).alias("repeats"), F.sum(less.cast("int")).alias("decreases"))


def compare(source: DataFrame, ledger: DataFrame, key: str, value: str) -> DataFrame:
    """What a source says against what the ledger says, key by key."""
    s = source.select(key, F.col(value).alias(f"source_{value}"), F.lit(True).alias("_s"))
    own = ledger.select(key, F.col(value).alias(f"ledger_{value}"), F.lit(True).alias("_l"))
    verdict = F.when(F.col("_s").isNull(), "only_in_ledger").when(F.col("_l").isNull(), "only_in_source").when(F.col(f"source_{value}").eqNullSafe(F.col(f"ledger_{value}")), "exact").otherwise("mismatch")
    return s.join(own, key, "full_outer").withColumn("verdict", verdict).drop("_s", "_l")


def audit(observations: DataFrame, facts: DataFrame) -> DataFrame:
    """Sessions with one plain, rising counter: the last total against the sum of the ledger's facts.

    ``observations``: ``session_id, ordinal, epoch, input_tokens, output_tokens, own_origin``.  Others
    are excluded, with the reason.
    """
    before = F.lag(F.struct("input_tokens", "output_tokens")).over(Window.partitionBy("session_id").orderBy("ordinal"))
    rows = observations.withColumn("_b", before)
    less = F.coalesce(F.col("input_tokens") < F.col("_b.input_tokens"), F.lit(False)) | F.coalesce(F.col("output_tokens") < F.col("_b.output_tokens"), F.lit(False))
    per = rows.groupBy("session_id").agg(
        F.max_by(F.struct("input_tokens", "output_tokens"), "ordinal").alias("last"), F.max(less.cast("int")).alias("less"), F.count_distinct("epoch").alias("epochs"),
        F.max((F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).cast("int")).alias("unknown"), F.min_by("own_origin", "ordinal").alias("proven"))
    reason = F.when(F.col("unknown") == 1, "missing_categories").when(F.col("epochs") > 1, "multiple_identity_epochs").when(F.col("less") == 1, "counter_decrease").when(~F.coalesce("proven", F.lit(False)), "unproven_first_boundary")
    total = facts.groupBy("session_id").agg(F.sum("input_tokens").alias("_i"), F.sum("output_tokens").alias("_o"))
    both = per.withColumn("reason", reason).join(total, "session_id", "left")
    same = (F.col("last.input_tokens") == F.coalesce("_i", F.lit(0))) & (F.col("last.output_tokens") == F.coalesce("_o", F.lit(0)))
    return both.select("session_id", F.when(F.col("reason").isNotNull(), "excluded").when(same, "exact").otherwise("mismatch").alias("verdict"), "reason")


def profile(raw: DataFrame) -> dict[str, DataFrame]:
    """Shapes and counters of raw records ``(source_id, generation, ordinal, byte_start, raw, error)``; names and numbers only.

    ``files`` (records, errors, times, usage, repeats), ``families`` (records by kind and keys), ``versions``,
    ``decreases`` (with what lies between), ``duplicate_first_ids``.
    """
    v = F.col("v")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = raw.withColumn("v", F.try_parse_json("raw")).select("source_id", "ordinal", "byte_start", "error", get("$.type", "string").alias("kind"), get("$.timestamp", "string").alias("time"), get("$.payload", "variant").alias("p"))
    body = lambda path, kind="string": F.try_variant_get("p", path, kind)
    rows = rows.withColumns({"sub": body("$.type"), "info": body("$.info", "variant")})
    counter = (F.col("kind") == "event_msg") & (F.col("sub") == "token_count")
    total = F.struct(*[F.try_variant_get("info", f"$.total_token_usage.{f}", "bigint").alias(f) for f in TOKEN_FIELDS])
    last = F.struct(*[F.try_variant_get("info", f"$.last_token_usage.{f}", "bigint").alias(f) for f in TOKEN_FIELDS])
    has = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("info", f"$.{name}", "variant")).startswith("OBJECT"), F.lit(False))
    w = Window.partitionBy("source_id").orderBy("ordinal", "byte_start")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "used": counter & has("total_token_usage"), "null_usage": F.coalesce(counter & ~F.coalesce(F.schema_of_variant("info").startswith("OBJECT"), F.lit(False)), F.lit(False)),
        "session": F.last(F.when(F.col("kind") == "session_meta", F.struct(body("$.id").alias("x"))), True).over(so_far)["x"],
        "turn": F.last(F.when(F.col("kind") == "turn_context", F.struct(body("$.turn_id").alias("x"))), True).over(so_far)["x"], "compactions": F.count_if(F.col("kind") == "compacted").over(so_far)})
    seen = rows.where("used").withColumns({"total": total, "last": F.when(has("last_token_usage"), last)})
    seen = seen.withColumn("b", F.lag(F.struct("total", "session", "turn", "compactions")).over(w))
    less = F.lit(False)
    for f in TOKEN_FIELDS:
        less = less | F.coalesce(F.col(f"total.{f}") < F.col(f"b.total.{f}"), F.lit(False))
    evidence = F.when(~F.col("session").eqNullSafe(F.col("b.session")), "identity_change").when(F.col("compactions") != F.col("b.compactions"), "compaction_between").when(
        ~F.col("turn").eqNullSafe(F.col("b.turn")) & (F.col("total") == F.col("last")), "new_turn_last_equals_total").otherwise("unexplained")
    keys = F.array_join(F.array_sort(F.json_object_keys(F.to_json("p"))), ",")
    good = rows.where("error is null")
    first = good.where("kind = 'session_meta'").groupBy("source_id").agg(F.min_by(body("$.id"), "ordinal").alias("first_session"))
    repeats = seen.groupBy("source_id").agg(F.count("*").alias("usage_records"), F.count_if(F.col("total").eqNullSafe(F.col("b.total"))).alias("repeats"), F.count_if(less).alias("decreases"))
    files = rows.groupBy("source_id").agg(F.count_if(F.col("error").isNull()).alias("records"), F.count("error").alias("errors"), F.min("time").alias("first_timestamp"), F.max("time").alias("last_timestamp"), F.count_if("null_usage").alias("null_usage"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("usage_records", "repeats", "decreases")}
    return {
        "files": files.join(repeats, "source_id", "left").join(first, "source_id", "left").withColumns(zero),
        "families": good.groupBy(F.concat_ws("/", F.coalesce("kind", F.lit("None")), F.coalesce("sub", F.lit(""))).alias("family"), F.coalesce(keys, F.lit("")).alias("keys")).agg(F.count("*").alias("records")),
        "versions": good.where("kind = 'session_meta'").groupBy(F.coalesce(body("$.cli_version"), F.lit("None")).alias("version")).agg(F.count("*").alias("headers")),
        "decreases": seen.where(less).select("source_id", "byte_start", F.col("time").alias("timestamp"), F.col("b.total").alias("previous"), F.col("total").alias("current"), "last", evidence.alias("evidence"), F.lit("unresolved_decrease").alias("classification")),
        "duplicate_first_ids": first.groupBy("first_session").agg(F.count("*").alias("files"), F.array_sort(F.collect_list("source_id")).alias("paths")).where("files > 1 and first_session is not null"),
    }


def projection_types(items: DataFrame, column: str = "item_json") -> DataFrame:
    """Items of history databases by their type; those that are no object are malformed."""
    v = F.try_parse_json(column)
    kind = F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("None"))).otherwise("malformed")
    return items.groupBy(kind.alias("type")).agg(F.count("*").alias("items"))


CHECKED = ("input_tokens", "output_tokens", "total_tokens")


def audit_sources(events: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each file: its counters and responses, read plainly, against the ledger's sum for its session.

    Expected is the last counter, with responses after it added; if the first response equals the first counter
    and all responses together are no less than the last counter, their sum.  Files that this reading can't settle
    are outside it, with a ``reason``; ``tags`` say what else they hold.
    """
    vector = "struct<" + ", ".join(f"{f}: bigint" for f in CHECKED) + ">"
    d = F.from_json("data_json", f"id string, parent_thread_id string, forked_from_id string, response_id string, total_token_usage {vector}, last_token_usage {vector}, usage {vector}")
    rows = events.where("kind in ('session_meta', 'cumulative_usage', 'response_usage', 'task_started', 'compacted')").select("source_id", "ordinal", "kind", "timestamp", d.alias("d"))
    is_ = lambda k: F.col("kind") == k
    known = lambda v: F.col(f"d.{v}").isNotNull() & F.forall(F.array(*[F.col(f"d.{v}.{f}") for f in CHECKED]), lambda x: x.isNotNull())
    counted = is_("cumulative_usage") & known("total_token_usage")
    before = Window.partitionBy("source_id", F.col("counted")).orderBy("ordinal")
    rows = rows.withColumn("counted", counted).withColumn("b", F.when(counted, F.lag("d.total_token_usage").over(before)))
    less = F.exists(F.array(*[F.col(f"d.total_token_usage.{f}") < F.col(f"b.{f}") for f in CHECKED]), lambda x: F.coalesce(x, F.lit(False)))
    # a response counts once, as it was said last
    newest = F.row_number().over(Window.partitionBy("source_id", "kind", "d.response_id").orderBy(F.desc("ordinal")))
    rows = rows.withColumn("answer", is_("response_usage") & F.col("d.response_id").isNotNull() & (newest == 1)).withColumn("less", F.when(counted, less))
    at = lambda c, when: F.max_by(F.when(when, c), F.when(when, F.col("ordinal")))
    first = lambda c, when: F.min_by(F.when(when, c), F.when(when, F.col("ordinal")))
    per = rows.groupBy("source_id").agg(
        F.count_if(is_("session_meta")).alias("headers"), first(F.col("d.id"), is_("session_meta")).alias("session_id"), at(F.col("d.total_token_usage"), F.col("counted")).alias("last"), at(F.col("timestamp"), F.col("counted")).alias("last_time"),
        first(F.struct("d.total_token_usage", "d.last_token_usage", "timestamp"), F.col("counted")).alias("first"), first(F.col("timestamp"), is_("task_started")).alias("task"), F.max(F.coalesce("less", F.lit(False))).alias("less"),
        F.max(is_("cumulative_usage") & ~F.coalesce(F.col("counted"), F.lit(False))).alias("missing"), first(F.col("d.usage"), is_("response_usage") & F.col("d.response_id").isNotNull()).alias("answered"), F.count_if("answer").alias("answers"),
        F.max(is_("compacted")).alias("compacted"), F.max(is_("session_meta") & (F.col("d.parent_thread_id").isNotNull() | F.col("d.forked_from_id").isNotNull())).alias("branch"))
    answers = rows.where("answer").select("source_id", "timestamp", "d.usage").join(per.select("source_id", "last_time"), "source_id")
    sums = answers.groupBy("source_id").agg(F.struct(*[F.sum(f"usage.{f}").alias(f) for f in CHECKED]).alias("all"), F.struct(*[F.coalesce(F.sum(F.when(F.col("timestamp") > F.col("last_time"), F.col(f"usage.{f}"))), F.lit(0)).alias(f) for f in CHECKED]).alias("later"))
    total = facts.groupBy(F.col("session_id").alias("_s")).agg(F.struct(*[F.sum(f).alias(f) for f in CHECKED]).alias("actual"))
    both = per.join(sums, "source_id", "left").join(total, F.col("session_id") == F.col("_s"), "left")
    unproven = ~(F.col("first.total_token_usage").eqNullSafe(F.col("first.last_token_usage")) & F.coalesce(F.col("task") <= F.col("first.timestamp"), F.lit(False)))
    reason = F.when(F.col("headers") != 1, "multiple_identity_epochs").when(F.col("less"), "counter_decrease").when(F.col("missing"), "missing_categories").when(F.col("last").isNull(), "no_cumulative_usage").when(unproven, "unproven_first_boundary")
    enough = F.forall(F.array(*[F.col(f"all.{f}") >= F.col(f"last.{f}") for f in CHECKED]), lambda x: F.coalesce(x, F.lit(False)))
    whole = F.coalesce(F.col("answered") == F.col("first.total_token_usage"), F.lit(False)) & enough
    expected = F.struct(*[F.when(whole, F.col(f"all.{f}")).otherwise(F.col(f"last.{f}") + F.coalesce(F.col(f"later.{f}"), F.lit(0))).alias(f) for f in CHECKED])
    tags = F.array_compact(F.array(F.when(F.col("branch"), "branch"), F.when(F.col("compacted"), "compaction"), F.when(F.col("answers") > 0, "responses")))
    both = both.withColumn("reason", reason).withColumn("expected", F.when(F.col("reason").isNull(), expected))
    disposition = F.when(F.col("reason").isNotNull(), "outside_simple_oracle").when(F.col("expected").eqNullSafe(F.col("actual")), "exact").otherwise("mismatch")
    return both.select("source_id", "session_id", disposition.alias("disposition"), "reason", "expected", "actual", tags.alias("tags"))


def audit_responses(events: DataFrame, facts: DataFrame, fact_sources: DataFrame, numbered: DataFrame) -> DataFrame:
    """Responses by native id: what the logs say last against the ledger's facts; ``verdict`` for every id of either."""
    usage = "struct<" + ", ".join(f"{f}: bigint" for f in CHECKED) + ">"
    said = events.where("kind = 'response_usage' and native_id is not null").select("native_id", "source_id", "ordinal", F.from_json("data_json", f"usage {usage}")["usage"].alias("usage"))
    source = said.groupBy("native_id").agg(F.max_by("usage", F.struct("source_id", "ordinal")).alias("source_usage"), (F.count_distinct(F.to_json("usage")) > 1).alias("conflict"))
    named = numbered.where("kind = 'response_usage' and native_id is not null").select("record_id", "native_id")
    own = facts.where("method = 'reported_response'").select(F.col("id").alias("fact_id"), F.struct(*CHECKED).alias("ledger_usage")).join(fact_sources, "fact_id").join(named, "record_id").select("native_id", "ledger_usage").distinct()
    both = source.join(own, "native_id", "full_outer")
    verdict = F.when(F.col("conflict"), "conflict").when(F.col("ledger_usage").isNull(), "only_in_source").when(F.col("source_usage").isNull(), "only_in_ledger").when(F.col("source_usage") == F.col("ledger_usage"), "exact").otherwise("mismatch")
    return both.select("native_id", "source_usage", "ledger_usage", verdict.alias("verdict"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """How often each value (or each entry of an array) occurs; unknown ones don't count."""
    value = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    return rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
