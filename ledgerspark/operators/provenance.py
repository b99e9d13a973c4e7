"""Whether records still stand where they were read, for many records at once.

Records are put in the order of their bytes; a task merges neighbouring places into ranges, reads each range
once, and compares every record's digest with its slice of it.  Nothing is read on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes between two records that are still one range; bytes of a range; records of a task.
GAP_BYTES, RANGE_BYTES, TASK_RECORDS = 64 << 10, 8 << 20, 50_000
BLOCK = 1 << 20
#: Tables of databases, whose rows have no bytes, and what is said of them.
DATABASE_TABLES = ("thread_items", "thread_realtime_items")
DATABASE_ROW = "database_row_locator; revision checked during ingestion"


def ranges(places: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs ``(first, after)`` of places in byte order that one read serves."""
    first, end = 0, 0
    for k, (path, begin, stop) in enumerate(places):
        if k > first and (path != places[first][0] or begin - end > gap or stop - places[first][1] > most):
            yield first, k
            first, end = k, 0
        end = max(end, stop)
    if places:
        yield first, len(places)


def read_range(path: str, begin: int, end: int) -> bytes | None:
    try:
        with open(path, "rb") as f:
            f.seek(begin)
            return f.read(end - begin)
    except OSError:
        return None


def digest_of(path: str, begin: int, end: int) -> str | None:
    """The digest of a record that is longer than a range, in blocks."""
    h = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            f.seek(begin)
            while begin < end and (b := f.read(min(BLOCK, end - begin))):
                h.update(b)
                begin += len(b)
    except OSError:
        return None
    return h.hexdigest()


def check(places: list[tuple[str, int, int]], digests: list[str]) -> list[str]:
    """``digest_matches``, ``source_changed`` or ``unavailable`` for each place; places in byte order."""
    said = lambda found, want: "unavailable" if found is None else "digest_matches" if found == want else "source_changed"
    out: list[str] = []
    for a, b in ranges(places):
        path, begin, end = places[a][0], places[a][1], max(p[2] for p in places[a:b])
        if end - begin > RANGE_BYTES:
            out += [said(digest_of(*places[k]), digests[k]) for k in range(a, b)]
            continue
        raw = read_range(path, begin, end)
        out += [said(None if raw is None else hashlib.sha256(raw[x - begin : y - begin]).hexdigest(), digests[k]) for k, (_, x, y) in enumerate(places[a:b], a)]
    return out


def verify(records: DataFrame) -> DataFrame:
    """``record_id, source_id, generation, byte_start, byte_end, digest, kind, verification`` of all rows.

    Rows of databases have a locator and no bytes; a record without a place is unavailable.
    """
    columns = ("record_id", "source_id", "generation", "byte_start", "byte_end", "digest", "kind")
    rows = records.select(*columns).withColumn("generation", F.col("generation").cast("int"))
    database = F.coalesce(F.col("source_id").isin(*DATABASE_TABLES), F.lit(False))
    placed = F.col("source_id").isNotNull() & F.col("byte_start").isNotNull() & F.col("byte_end").isNotNull() & F.col("digest").isNotNull()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = list(zip(b.column("source_id").to_pylist(), b.column("byte_start").to_pylist(), b.column("byte_end").to_pylist(), strict=True))
            if places:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(check(places, b.column("digest").to_pylist()))], [*b.schema.names, "verification"])

    own = rows.where(~database & placed)
    n = max(records.sparkSession.sparkContext.defaultParallelism, -(-own.count() // TASK_RECORDS))
    kinds = ", ".join(f"{c} {k}" for c, k in own.dtypes)
    read = own.repartitionByRange(n, "source_id", "byte_start").sortWithinPartitions("source_id", "byte_start", "byte_end").mapInArrow(task, f"{kinds}, verification string")
    rest = rows.where(database | ~placed).withColumn("verification", F.when(database, DATABASE_ROW).otherwise("unavailable"))
    return read.unionByName(rest)
