"""Column expressions; unknown stays NULL, a measured zero stays 0."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.schema import TOKEN_FIELDS


def flag_sum(condition: Column) -> Column:
    """Rows for which a condition holds; NULL over no rows, unlike ``count_if``."""
    return F.sum(condition.cast("int"))


def noncached(cached: str = "cached_input_tokens", given: str = "input_tokens") -> Column:
    """Input beyond the cache, known only where the cache is no larger than the input."""
    return F.when(F.col(given) >= F.col(cached), F.col(given) - F.col(cached))


def rough_tokens(characters: str) -> Column:
    return F.expr(f"({characters} + 3) div 4")


def model_key(model: str = "model") -> Column:
    return F.coalesce(F.col(model), F.lit("unknown"))


def local_time(ts: Column, zone: str) -> Column:
    """UTC wall time (timestamp_ntz) as wall time of a zone, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_day(ts: Column, zone: str) -> Column:
    return local_time(ts, zone).cast("date")


def valid(v: dict[str, Column]) -> Column:
    """A token vector is consistent: no negative part; input and output make the total where all are
    known; cached input within input; reasoning within output.  Unknown parts can't be wrong."""
    yes = F.lit(True)
    parts = [F.coalesce(v[f] >= 0, yes) for f in TOKEN_FIELDS if f in v]
    get = lambda f: v.get(f, F.lit(None).cast("bigint"))
    parts += [
        F.coalesce(get("input_tokens") + get("output_tokens") == get("total_tokens"), yes),
        F.coalesce(get("cached_input_tokens") <= get("input_tokens"), yes),
        F.coalesce(get("reasoning_output_tokens") <= get("output_tokens"), yes),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def all_zero(given: Column, output: Column, total: Column) -> Column:
    return F.coalesce((given == 0) & (output == 0) & (total == 0), F.lit(False))


def sum_or_unknown(value: Column) -> Column:
    """A sum that is unknown as soon as one part is; nothing at all sums to zero."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.coalesce(F.sum(value), F.lit(0)))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps; unknown if either is or time runs backwards."""
    ms = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000
    return F.when(ms >= 0, ms)


def epoch_to_utc(value: Column, millis: bool = False) -> Column:
    made = F.timestamp_millis(value) if millis else F.timestamp_seconds(value)
    return F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def key(*parts: Column) -> Column:
    """A deterministic id; unknown parts differ from empty ones."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\u0000", *marked), 256)


def fingerprint(name: Column, arguments: Column, salt: str) -> tuple[Column, Column]:
    """(kind, hash) of a call's arguments: commands and reads are recognised by the tool's short name."""
    short = F.element_at(F.split(F.coalesce(name, F.lit("None")), r"\."), -1)
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    command = F.coalesce(F.try_variant_get(parsed, "$.cmd", "string"), F.try_variant_get(parsed, "$.command", "string"), arguments)
    shell = short.isin("exec_command", "shell", "shell_command", "commandExecution")
    read = short.isin("read_file", "read", "read_text_file", "get_file_contents") & is_object
    kind = F.when(shell, "exact_command").when(read, "exact_read_and_range").otherwise("exact_arguments")
    value = F.when(shell & is_object, command).when(read, F.to_json(parsed)).otherwise(arguments)
    hashed = F.sha2(F.concat_ws("\u0000", F.lit(salt), kind, F.coalesce(name, F.lit("None")), value), 256)
    known = arguments.isNotNull()
    return F.when(known, kind), F.when(known, hashed)


def display_name(name: Column, tool: Column, kind: Column, namespace: Column) -> Column:
    """Name, tool or type of a call, with its namespace in front unless it is there already."""
    typed = F.when(kind == "commandExecution", "exec_command").when(kind == "fileChange", "apply_patch").otherwise(kind)
    plain = F.coalesce(name, tool, typed, F.lit("unknown_tool"))
    return F.when(namespace.isNotNull() & (namespace != "") & ~plain.startswith(F.concat(namespace, F.lit("."))), F.concat(namespace, F.lit("."), plain)).otherwise(plain)


def csv_safe(value: Column) -> Column:
    """Text that a spreadsheet can't take for a formula."""
    risky = F.ltrim(value).rlike(r"^[=+\-@]") | value.rlike(r"^[\t\r]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


#: What a preview hides, and how much of a text it shows.
REDACTIONS = (
    (r"((?i:bearer)\s+)[A-Za-z0-9._~+/=-]+", "$1[redacted]"),
    (r"\bsk-[A-Za-z0-9_-]+", "[redacted]"),
    (r"(--(?i:api-key|token|password|secret)\s+)(\"[^\"]*\"|'[^']*'|\S+)", "$1[redacted]"),
    (r"([\"']?(?i:api[_-]?key|access[_-]?token|authorization|password|secret)[\"']?\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;}]+)", "$1[redacted]"),
)
PREVIEW_CHARACTERS = 2000


def redact(text: Column) -> Column:
    for pattern, instead in REDACTIONS:
        text = F.regexp_replace(text, pattern, instead)
    return F.when(F.char_length(text) > PREVIEW_CHARACTERS, F.concat(F.left(text, F.lit(PREVIEW_CHARACTERS)), F.lit("\n[preview truncated]"))).otherwise(text)


def canonical_path(path: Column) -> Column:
    """Windows paths without long-path prefix, lower-cased, with backslashes; others without doubled
    or trailing slashes."""
    plain = F.regexp_replace(path, r"^\\\\\?\\(?i:UNC)\\", r"\\\\")
    plain = F.regexp_replace(plain, r"^\\\\\?\\", "")
    windows = plain.rlike(r"^(?:[A-Za-z]:|\\\\)")
    back = F.lower(F.replace(plain, F.lit("/"), F.lit("\\")))
    back = F.when(F.char_length(back) > 3, F.rtrim(back, F.lit("\\"))).otherwise(back)
    posix = F.regexp_replace(plain, r"/+", "/")
    posix = F.when(F.char_length(posix) > 1, F.rtrim(posix, F.lit("/"))).otherwise(posix)
    return F.when(windows, back).otherwise(posix)


def measure(text: Column) -> Column:
    """Size of a text: UTF-8 bytes, code points, whether it says that it was cut."""
    cut = F.lower(text).contains("truncated")
    return F.struct(
        F.octet_length(text).cast("long").alias("bytes"), F.char_length(text).cast("long").alias("characters"),
        F.when(text.isNull(), "unavailable").otherwise("no_verified_local_tokenizer").alias("method"),
        F.when(text.isNull(), "unknown").when(cut, "partial").otherwise("retained_content").alias("completeness"))


def media_in(text: Column, is_json: Column) -> Column:
    """Whether serialized JSON holds media.  Nothing but expressions: a media part shows in its type, and no such
    key can be inside a JSON string, where quotes are escaped."""
    return is_json & text.rlike(r'(?i)"type":"[^"]*(?:image|audio|video)')


def measured_text(text: Column, is_json: Column) -> Column:
    """The part of a text that counts: all of it, or only the texts in JSON that holds media."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(r'"text":("(?:[^"\\]|\\.)*")'), F.lit(1)), lambda t: F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0])
    return F.when(media_in(text, is_json), F.array_join(inner, "\n")).otherwise(text)


def measure_value(text: Column, is_json: Column, tokens: Column | None = None) -> Column:
    """Size of a text or of serialized JSON (``is_json``), of which only texts count if it holds media.

    ``tokens`` is the number of tokens of its measured text, NULL where no tokenizer is known.
    """
    media, seen = media_in(text, is_json), measured_text(text, is_json)
    tokens = F.lit(None).cast("long") if tokens is None else tokens
    cut = F.lower(text).contains("truncated")
    none = F.lit(None).cast("string")
    flags = F.array_compact(F.array(F.when(cut, "truncated"), F.when(media, "unsupported_media")))
    return F.struct(
        F.octet_length(text).cast("long").alias("bytes"), F.char_length(seen).cast("long").alias("characters"), tokens.alias("tokens"),
        F.when(text.isNull(), "unavailable").when(tokens.isNotNull(), "local_tokenizer_estimate").otherwise("no_verified_local_tokenizer").alias("method"),
        F.when(text.isNull(), none).when(media, "extracted_text_only").when(is_json, "serialized_json").otherwise("retained_text").alias("scope"),
        F.when(text.isNull(), "unknown").when(F.size(flags) > 0, "partial").otherwise("retained_content").alias("completeness"), F.when(text.isNotNull(), flags).alias("flags"))


def size_json(name: str, when: Column, text: Column, is_json: Column, tokens: Column | None = None, told: dict[str, Column] | None = None) -> Column:
    """``{"<name>": <size>}`` as text, NULL unless ``when``.  Unknown numbers are named as null; what only a known or
    counted text has (``told`` of a counted one) is left out otherwise."""
    size = measure_value(text, is_json, tokens)
    numbers = F.to_json(F.struct(*[size[c].alias(c) for c in ("bytes", "characters", "tokens")]), {"ignoreNullFields": "false"})
    extra = [F.when(size["tokens"].isNotNull(), c).alias(k) for k, c in (told or {}).items()]
    rest = F.to_json(F.struct(*[size[c].alias(c) for c in ("method", "scope", "completeness", "flags")], *extra))
    inner = F.concat(F.left(numbers, F.char_length(numbers) - 1), F.lit(","), F.substring(rest, F.lit(2), F.char_length(rest) - 1))
    return F.when(when, F.concat(F.lit(f'{{"{name}":'), inner, F.lit("}")))


def strict_int(variant: Column, path: str) -> Column:
    """A JSON integer; true, 1.0 and \"7\" are none."""
    found = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(found) == "BIGINT", F.try_variant_get(variant, path, "bigint"))
