"""Secret scans by a trigram inverted index; DataFrame functions only.

From each rule's regex the driver derives a Boolean query of trigrams that any match must hold.  The
index keeps postings (trigram, doc_id) of the trigrams that some rule asks for, over whole
lower-cased texts; intersecting postings gives each rule's candidates, and only those are verified
by the regex.  A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

from re import _constants as ops
from re import _parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, fresh, numbered


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are spans if group ``group`` has ``least`` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ["password", "passwd", "secret", "token"])) + "|" + either_case("api") + "_?" + either_case("key")
BASE = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
)
#: Spans that the index adds to the base ones.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A Boolean query in disjunctive form: any of these sets of trigrams; {()} holds always.
Query = frozenset
ANY: Query = frozenset({frozenset()})
#: Strings that a part of a regex may stand for, as long as there are few.
MOST_STRINGS = 16


def both(a: Query, b: Query) -> Query:
    return simplest(frozenset(x | y for x, y in product(a, b)))


def simplest(q: Query) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def grams(strings: set[str]) -> Query:
    """For each string the trigrams that cover it; those between would say little more and cost a test each."""
    cover = lambda s: {*range(0, len(s) - 2, 3), len(s) - 3} if len(s) > 2 else ()
    return simplest(frozenset(frozenset(s[k : k + 3] for k in cover(s)) for s in strings))


def _walk(items) -> tuple[set[str] | None, Query]:
    """The strings that a sequence stands for (None: unknown) and what a match must hold."""
    strings, query, exact = {""}, ANY, True
    for op, arg in items:
        own, inner = _strings(op, arg)
        query = both(query, inner)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, own)}
            continue
        query = both(query, grams(strings))
        exact = False
        strings = own if own is not None and len(own) <= MOST_STRINGS else {""}
    return (strings, query) if exact else (None, both(query, grams(strings)))


def _strings(op, arg) -> tuple[set[str] | None, Query]:
    if op is ops.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is ops.IN:
        if any(k not in (ops.LITERAL, ops.RANGE) for k, _ in arg):
            return None, ANY
        codes = [c for k, v in arg for c in ([v] if k is ops.LITERAL else range(v[0], v[1] + 1))]
        found = {chr(c).lower() for c in codes}
        return (found, ANY) if len(found) <= 8 else (None, ANY)
    if op is ops.SUBPATTERN:
        return _walk(arg[-1])
    if op is ops.BRANCH:
        parts = [_walk(p) for p in arg[1]]
        if all(s is not None for s, _ in parts):
            found = set().union(*(s for s, _ in parts))
            if len(found) <= MOST_STRINGS:
                return found, ANY
        return None, simplest(frozenset().union(*(both(q, grams(s)) if s is not None else q for s, q in parts)))
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, body = arg
        own, inner = _walk(body)
        if low == 0:
            return (own | {""}, ANY) if high == 1 and own is not None else (None, ANY)
        if low == high == 1:
            return own, inner
        return None, inner if own is None else both(inner, grams(own))
    return (None, ANY) if op is not ops.AT else ({""}, ANY)


def trigram_query(pattern: str) -> Query:
    """Trigrams of the lower-cased text that every match of the regex must hold, in disjunctive form."""
    strings, query = _walk(parser.parse(pattern))
    return query if strings is None else both(query, grams(strings))


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of these trigrams: ``trigram, doc_id`` rows."""
    # a projection of its own, or each of the tests would lower-case the text again
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, rules``: the rules (by number) whose query a document's postings satisfy."""
    spark = index.sparkSession
    terms = [(k, c, len(clause), t) for k, r in enumerate(rules) for c, clause in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in clause]
    asked = spark.createDataFrame(terms, "rule int, clause int, needs int, trigram string")
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "rule", "clause", "needs").agg(F.count_distinct("trigram").alias("has"))
    return met.where("has = needs").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, leftmost and non-overlapping: array of start, rank, kind, end (code points)."""
    pattern = F.lit(rule.pattern)
    between, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    held = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), held.alias("held"))
    none = F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>")

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.char_length(m["held"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(F.rlike(text, pattern), found).otherwise(none)


def long_enough(rule: Rule) -> Rule:
    """The same spans from a pattern that asks for the length itself.

    Only for a whole-match rule that ends in a repeated class: a run that is too short holds no other
    match that is long enough, so nothing else changes.
    """
    if rule.group or not rule.pattern.endswith("]+"):
        return rule
    fixed = rule.pattern[: rule.pattern.rindex("[")]
    return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - len(fixed)},}}", 0, rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "spans") -> DataFrame:
    """All rows and columns of ``docs`` and an array of spans, by start, then in the order of the rules.

    Null texts count as empty.  Postings are of rows, so rows with equal or null ids don't share any.
    ``out`` replaces a column of that name, other columns stay whatever they are called; an empty table
    gives no rows.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*(c for q in queries for c in q)))
    spans, columns = [], [c for c in docs.columns if c != out]
    asked = fresh(docs, "_rules")
    if trigrams:
        row, to = fresh(docs, "_row"), fresh(docs, "_to")
        docs = numbered(docs, row)
        found = cut(candidates(postings(docs, trigrams, row, text), rules), "candidates")
        docs = docs.join(found.select(F.col("doc_id").alias(to), F.col("rules").alias(asked)), F.col(row) == F.col(to), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    for k, (rule, q) in enumerate(zip(rules, queries, strict=True)):
        own = spans_of(whole, long_enough(rule), k)
        if q != ANY:
            own = F.when(F.array_contains(F.coalesce(asked, F.array().cast("array<int>")), k), own)
        spans.append(F.coalesce(own, F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>")))
    return docs.select(*columns, F.array_sort(F.concat(*spans)).alias(out))


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, first, add, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    # only spans leave the join; the texts stay behind
    found = cut(scan(docs).select("doc_id", "spans"), "spans")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same by plain regexes in SQL, for the oracle."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""select doc_id, id, {k} as rank, '{r.kind}' kind, {r.least} as least, string_split_regex(text, '{p}') gaps,
          regexp_extract_all(text, '{p}', 0) whole, regexp_extract_all(text, '{p}', {r.group}) held from d""")
    return f"""
with d as (select doc_id, row_number() over () id, coalesce(text, '') text from documents),
m as ({" union all ".join(parts)}),
e as (select doc_id, id, rank, kind, least, gaps, whole, held, unnest(range(1, len(whole) + 1)) i from m),
s as (select id, rank, kind, len(held[i]) >= least ok, whole[i] w,
  list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda g: len(g))), 0) start from e),
f as (select id, rank, kind, cast(start as bigint) start, kind || ':' || cast(start as bigint) || ':' || cast(start + len(w) as bigint) span from s where ok),
g as (select id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
  string_agg(span, ',' order by start, rank) filter (rank < {len(BASE)}) base, string_agg(span, ',' order by start, rank) spans from f group by id)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join g using (id)"""


SQL = _sql()
