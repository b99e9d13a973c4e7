"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents and queues them, pass after pass, up to ``repeat`` passes.  A
copy's virtual finish time is the source's tokens up to and including it, divided by the source's
target.  All copies are range-sorted by finish time, and the mix ends where the budget does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, parts, running_totals, small, words

#: Weights of sources in code point order, repeating; most passes over a source.
WEIGHTS = (5, 2, 1)
REPEAT = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """``source, source_size, target`` from ``(source, size)`` rows.

    Sources by code point (null last) take the weights in turn and share the sum of all sizes; none
    gets more than ``repeat`` times its own size, and what is above is shared again by weight.  With
    the sources sorted by size over weight, those that stop short are the first ones, so one pass
    finds the water level.  Only one row per source takes part.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(listed, ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    cap = F.lit(repeat) * F.col("source_size")
    rise = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").isNull(), F.col("source"))
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    rest = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest))
    per = per.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(every))
    target = F.when(F.col("water").isNull() | (F.col("water") * F.col("weight") > cap), cap.cast("double")).otherwise(F.col("water") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def place(doc_id: Column, seed: str) -> Column:
    """A document's place in its source's shuffle."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT, seed: str = "mix:", doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row.

    Size is the number of words; null text has none, and an empty document is never taken.  A copy is
    taken if the budget (the sum of all sizes) still holds it whole when its turn comes.  Rows with
    equal ids stand next to each other in the shuffle, and each is taken or not by itself; a column
    ``row`` of numbers comes back with each row if one is named.  An empty table gives no rows.
    """
    more = ["row"] if row else []
    rows = docs.select(*[F.col(row).alias("row") for _ in more], F.col(doc_id).cast("long").alias("doc_id"), F.size(words(F.col(text))).cast("long").alias("size"), F.col(source).cast("string").alias("source"))
    rows = cut(rows.withColumn("place", place(F.col("doc_id"), seed)), "sizes")
    n = parts(docs.sparkSession, rows.count(), 200_000)
    per = small(targets(rows, weights, repeat).withColumnRenamed("source", "_source"), "targets")
    queued = running_totals(rows, "source", "size", ["place", "doc_id", "size", *more], "ahead", n)
    queued = cut(queued.join(per, queued.source.eqNullSafe(per._source), "left").drop("_source"), "queued")
    copy = queued.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).select(
        "source", "place", "doc_id", "size", "ahead", "pass", (((F.col("pass") - 1) * F.col("source_size") + F.col("ahead") + F.col("size")) / F.col("target")).alias("finish"))
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    turn = running_totals(copy, None, "size", ["finish", "place", "doc_id", "pass"], "used", n)
    taken = turn.crossJoin(F.broadcast(budget)).where("used + size <= budget").groupBy("source", "ahead", "doc_id", "size").agg(F.count("*").alias("copies"))
    t = taken.select(F.col("source").alias("_s"), F.col("ahead").alias("_a"), F.col("doc_id").alias("_d"), F.col("size").alias("_n"), "copies")
    match = queued.source.eqNullSafe(t._s) & (queued.ahead == t._a) & queued.doc_id.eqNullSafe(t._d) & (queued["size"] == t._n)
    copies = F.coalesce(F.col("copies"), F.lit(0)).cast("int")
    return queued.join(t, match, "left").select(*more, "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


#: The same in SQL, for the oracle.
SQL = """
with d as (
  select cast(doc_id as bigint) doc_id, source, md5('mix:' || coalesce(cast(doc_id as varchar), '')) place,
    cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, [5, 2, 1][cast((row_number() over (order by source is null, source) - 1) % 3 + 1 as int)] weight from s),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 3 * source_size / weight, source is null, source rows between current row and unbounded following) as level from w),
v as (select *, max(case when level * weight <= 3 * source_size then level end) over () water from l),
t as (select source, source_size, cast(case when water is null or water * weight > 3 * source_size then 3 * source_size else water * weight end as double) target from v),
q as (select d.*, t.source_size, t.target, coalesce(sum(d.size) over (partition by d.source order by place, doc_id, d.size rows between unbounded preceding and 1 preceding), 0) ahead,
    row_number() over (order by d.source, place, doc_id, d.size) as id from d join t on d.source is not distinct from t.source),
c as (select *, ((p - 1) * source_size + ahead + size) / target finish from q, (select unnest([1, 2, 3]) p) where size > 0),
u as (select *, coalesce(sum(size) over (order by finish, place, doc_id, p rows between unbounded preceding and 1 preceding), 0) used from c),
k as (select id, count(*) n from u where used + size <= (select sum(size) from d) group by id)
select doc_id, size, source_size, target, cast(coalesce(n, 0) * size as bigint) taken from q left join k using (id)
"""
