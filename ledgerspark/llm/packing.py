"""Best-fit packing by hierarchical residuals.

Every partition packs its own pieces best-fit decreasing and closes the bins that are nearly full.
The underfull bins go up a tree as items: fewer nodes each round pack them best-fit again, until one
node holds them all or a round no longer helps.  Items carry only ids and sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut
from .tokens import encoder, vocabulary

CAPACITY = 1024
#: A bin with at most so much room left is closed where it was made.
NEARLY_FULL = 8
#: Items that one node of the tree packs.
NODE_ITEMS = 100_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item and the fill of each bin; largest items first, each to the bin
    with the least room that holds it.  Items of equal size keep their order."""
    n = len(sizes)
    bins, offsets, fills = np.empty(n, np.int64), np.empty(n, np.int64), []
    free: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            own = free[room]
            k = own.pop()
            if not own:
                rooms &= ~(1 << room)
        else:
            k, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += size
        if left := room - size:
            free.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


MOVE = "item long, bin long, shift long, fill long"


def pack_round(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Pack each partition's ``(item, size)`` rows: ``item, bin, shift, fill`` of its bin."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        item, size = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((item, size))
        item, size = item[order], size[order]
        bins, shift, fills = best_fit(size, capacity)
        ids = (np.int64(level + 1) << np.int64(56)) | (np.int64(part) << np.int64(32)) | bins
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, ids, shift, fills[bins])], ["item", "bin", "shift", "fill"])

    return cut(items.select("item", "size").mapInArrow(task, MOVE), f"pack{level}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = NEARLY_FULL, node_items: int = NODE_ITEMS) -> DataFrame:
    """``item, sequence_id, offset`` for ``(item long unique, size long)`` rows, 0 < size <= capacity.

    Full pieces make sequences of their own.  The others go through rounds; each round's moves are a
    table, and the moves are followed at the end by joins on bin ids.  The number of bins that are
    carried on may stay large if hardly any fit together; then a round that doesn't lessen them by a
    hundredth ends the tree.
    """
    full = pieces.where(F.col("size") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    moves, level = [pack_round(pieces.where(F.col("size") < capacity), 0, capacity)], 0
    count, nodes = None, None
    while nodes != 1:
        left = moves[-1].where(F.col("fill") < capacity - slack).groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("size"))
        n = left.count()
        nodes = max(1, -(-n // node_items))
        if n < 2 or count is not None and n > 0.99 * count and nodes > 1:
            break
        count, level = n, level + 1
        moves.append(pack_round(left.repartition(1) if nodes == 1 else left.repartition(nodes, "item"), level, capacity))
    final = moves[-1].select("item", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
    for below in reversed(moves[:-1]):
        up = final.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("more"))
        final = below.join(up, "bin", "left").select(
            "item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("offset"))
    return full.unionByName(final)


PIECES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut_pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole texts.  Longer documents are cut so that all pieces but the first are full."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, uid = encoder(vocab), TaskContext.get().partitionId() << 32
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, ids, counts in enc.encode_all(batch.column(1)):
                raw, stop, rows = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts).tolist(), []
                for k, (e, c) in enumerate(zip(stop, counts.tolist(), strict=True)):
                    begin, n, b = e - c, c + 1, 0
                    size = (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        end = b + size
                        crc = zlib.crc32(raw[4 * (begin + b) : 4 * (begin + min(end, c))])
                        if end == n:
                            crc = zlib.crc32(tail, crc)
                        rows.append((uid, keys[at + k], piece, b, size, crc))
                        uid, b, size = uid + 1, end, capacity
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(task, "item long, doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")


def pack_documents(docs: DataFrame, vocab: str, end_id: int = 2, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs whole documents (null text: empty) into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece; rows
    with equal or null ids are documents of their own; an empty table gives no rows.
    """
    pieces = cut_pieces(docs, vocab, end_id, capacity, doc_id, text)
    placed = pack(pieces.select("item", F.col("length").alias("size")), capacity)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), end_id=2)
