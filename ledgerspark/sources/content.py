"""Contents of logs by fixed ranges of bytes: how many records end in each, and a hash of it.

A file is a tree of two levels: leaves are hashes of its ranges, the root is one of the leaves in order.
Tasks count and hash; the driver holds none of a log's bytes.  A line belongs to the range in which it
ends, so numbers of records add up over ranges, and a range can be read without those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jsonl

LEAVES = "path string, generation int, span bigint, span_end bigint, records bigint, digest string"


def ranges(files: DataFrame, step: int = jsonl.RANGE) -> DataFrame:
    """``path, generation, span, span_end`` of all ranges of files of ``path, generation, begin, size``.

    The first begins at ``begin``, the others at multiples of ``step``; a file without bytes has none.
    """
    first = (F.col("begin") / step).cast("bigint") * step
    at = files.where("size > begin").select("path", "generation", "size", "begin", F.explode(F.sequence(first, F.col("size") - 1, F.lit(step).cast("bigint"))).alias("at"))
    return at.select("path", "generation", F.greatest("begin", "at").alias("span"), F.least("size", F.col("at") + step).alias("span_end"))


def measured(spans: DataFrame, count: bool = True, digest: bool = True) -> DataFrame:
    """``LEAVES`` rows of ranges; what isn't asked for, and what can't be read, is null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records, digests = [], []
            for path, begin, end in zip(*(b.column(c).to_pylist() for c in ("path", "span", "span_end")), strict=True):
                n = d = None
                try:
                    d = jsonl.sha(path, begin, end - begin) if digest else None
                    n = jsonl.records_in(path, begin, end) if count else None
                except OSError:  # a file may be gone
                    n = d = None
                records.append(n)
                digests.append(d)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "generation", "span", "span_end")), pa.array(records, pa.int64()), pa.array(digests, pa.string())], [c.split()[0] for c in LEAVES.split(", ")])

    n = max(spans.sparkSession.sparkContext.defaultParallelism, -(-spans.count() // 4))  # a few ranges a task
    return spans.repartition(n, "path", "span").mapInArrow(task, LEAVES)


def before(counts: DataFrame) -> DataFrame:
    """``path, generation, span, before``: how many records end in the ranges of a file before each.  Takes ``records``."""
    order = Window.partitionBy("path", "generation").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("path", "generation", "span", F.coalesce(F.sum("records").over(order), F.lit(0)).alias("before"))


def numbered(rows: DataFrame, counts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Records whose ``ordinal`` goes through their file instead of their range; without ``span``.

    ``counts`` (``path, generation, span, records``) is taken from the rows where it isn't given, so the rows should be
    a table then.  ``known`` (``path, generation, ordinal``) is how many records earlier batches had.
    """
    if counts is None:
        counts = rows.groupBy("path", "generation", "span").agg(F.max("ordinal").alias("records"))
    offsets = before(counts)
    if known is not None:
        offsets = offsets.join(known.withColumnRenamed("ordinal", "_known"), ["path", "generation"], "left").withColumn("before", F.col("before") + F.coalesce("_known", F.lit(0))).drop("_known")
    names = [c for c in rows.columns if c != "span"]
    made = rows.join(offsets, ["path", "generation", "span"], "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("before", F.lit(0)))
    return made.select(*names)


def roots(leaves: DataFrame) -> DataFrame:
    """``path, generation, root, size``: one hash for each file, of its leaves in the order of their places."""
    each = F.sort_array(F.collect_list(F.struct("span", F.coalesce("digest", F.lit("")).alias("digest"))))
    text = F.concat_ws(",", F.transform(each, lambda x: x["digest"]))
    return leaves.groupBy("path", "generation").agg(F.sha2(text, 256).alias("root"), F.max("span_end").alias("size"))


def latest(kept: DataFrame) -> DataFrame:
    """The leaves that count: those of a file's newest generation."""
    newest = kept.groupBy("path").agg(F.max("generation").alias("generation"))
    return kept.join(newest, ["path", "generation"], "left_semi").select(*[c.split()[0] for c in LEAVES.split(", ")])


def changed(kept: DataFrame, now: DataFrame) -> DataFrame:
    """``path, generation, span, span_end`` of kept ranges whose bytes aren't what they were.

    Roots are compared first; only files whose roots differ have their leaves compared.  A range that
    can't be read now isn't changed: what was read of a file stays when it goes.
    """
    own, other = roots(kept), roots(now).select("path", "generation", F.col("root").alias("now"))
    differ = own.join(other, ["path", "generation"]).where("root <> now").select("path", "generation")
    leaves = kept.join(differ, ["path", "generation"], "left_semi")
    seen = now.select("path", "generation", "span", F.col("digest").alias("now"))
    return leaves.join(seen, ["path", "generation", "span"]).where("now is not null and digest <> now").select("path", "generation", "span", "span_end")


def verify(kept: DataFrame) -> DataFrame:
    """``changed`` of kept leaves against the files as they are."""
    return changed(kept, measured(kept.select("path", "generation", "span", "span_end"), count=False))
