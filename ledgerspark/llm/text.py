"""Words of many texts at once, and sums of arrays over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4_000_000
#: Rows that are in Python objects at a time where texts are handled one by one.
SLICE_ROWS = 1000


def word_blocks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Runs of texts as words: first text's index, distinct words, a code per word, words per text.

    Words are what lies between ASCII white space, with A-Z lower-cased if asked; null counts as empty.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        part = pc.fill_null(texts.slice(at, end - at), "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        owner = np.repeat(np.arange(end - at), np.diff(split.offsets.to_numpy()))
        flat = split.flatten()
        whole = pc.not_equal(flat, "")
        flat, owner = flat.filter(whole), owner[whole.to_numpy(zero_copy_only=False).astype(bool)]
        coded = flat.dictionary_encode()
        yield at, coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.bincount(owner, minlength=end - at)
        at = end


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a task holds few texts besides the batch itself."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def total(rows: DataFrame, fan_in: int = 16) -> np.ndarray | None:
    """Sum of the equally long float64 arrays in column ``blob``; tasks add up in a tree, so that the
    driver gets at most ``fan_in`` of them however many tasks there were.  None if there is no row."""

    def add_up(part: pa.Table) -> pa.Table:
        got = np.sum([np.frombuffer(x) for x in sorted(part["blob"].to_pylist())], axis=0)
        return pa.table({"part": part["part"][:1], "blob": pa.array([got.tobytes()], pa.binary())})

    # an array's place is its task's number, so every task of a level gets at most fan_in of them
    n = rows.rdd.getNumPartitions()
    rows = rows.withColumn("part", F.spark_partition_id())
    while True:  # one level at least: the arrays are made by all tasks at once
        n = -(-n // fan_in)
        rows = rows.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(add_up, "part long, blob binary")
        if n <= fan_in:
            break
    got = [np.frombuffer(x) for x in sorted(bytes(r.blob) for r in rows.collect())]
    return np.sum(got, axis=0) if got else None


def partial_sums(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> DataFrame:
    """One array per task, made by ``add`` from its batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = add(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(got, np.float64).tobytes()], pa.binary())], ["blob"])

    return df.mapInArrow(task, "blob binary")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
