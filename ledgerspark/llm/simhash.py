"""SimHash near-duplicates linked through BK-trees of shards.

Fingerprints are 64-bit SimHashes of word shingles.  Two that differ in at most ``radius`` bits agree
on some of the blocks that the 64 bits are cut into, so every choice of blocks is a way to shard:
fingerprints whose key bits (some bits of the chosen blocks) are equal share a shard, and no link is
lost.  The number of key bits, and with it the number of blocks, follows the number of fingerprints:
shards hold a few thousand at every size, and a fingerprint is looked up in one shard a choice.

Each shard has a BK-tree whose children are keyed by their integer Hamming distance to the parent.  A
tree goes to the task that has the shard's queries, and they follow only edges whose label is within
the radius of their own distance.  A shard that skew makes larger than a tree is cut into chunks:
each chunk's tree is sent to every chunk's queries.  A task gives a spanning forest of its links,
never all pairs.  (One tree of all fingerprints, sent to every task, would have no bound; and trees of
arbitrary shards would meet every query, which is quadratic work.)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, cut, fresh, hot_join, numbered, parts, spanning, with_least
from .text import slices

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that a shard has on average, at most; those that a tree holds.
SHARD_MEAN, SHARD_ROWS = 2048, 4096
#: Pairs that one step of a search looks at.
STEP_PAIRS = 2_000_000


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one whole text as an unsigned 64-bit number; no words: zero."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), joined), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        ones += np.unpackbits(h[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long) for every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([simhash(t, shingle, seed) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, "doc_id long, fp long")


def key_masks(rows: int, radius: int, mean: int = SHARD_MEAN) -> list[int]:
    """Key bits of each choice of blocks, as signed longs; as many bits as ``rows`` fingerprints need.

    With ``radius`` more blocks than are chosen, some choice has only equal bits.  The fewest blocks
    whose choices hold enough bits are taken, as choices multiply the rows.
    """
    need = max(0, -(-rows // mean) - 1).bit_length()
    for blocks in range(radius + 1, 64):
        edge = [round(64 * k / blocks) for k in range(blocks + 1)]
        own = [list(range(a, b)) for a, b in zip(edge, edge[1:], strict=False)]
        choices = [[bit for block in c for bit in block] for c in combinations(own, blocks - radius)]
        if min(map(len, choices)) >= need:
            break
    masks = [sum(1 << bit for bit in c[:need]) for c in choices] if need else [0]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """BK-trees of many shards: nodes, and children found by (parent, label)."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """``shard`` ascending; the first row of each is its root."""
        first = np.append(True, shard[1:] != shard[:-1]) if len(shard) else np.zeros(0, bool)
        self.fp, self.roots, self.shards = fp, np.flatnonzero(first), shard[first]
        parent = self.roots[np.cumsum(first) - 1] if len(shard) else np.zeros(0, np.int64)
        rest = np.flatnonzero(~first)
        parent, keys, nodes = parent[rest], [], []
        while len(rest):
            key = parent * 65 + np.bitwise_count(fp[rest] ^ fp[parent])
            order = np.argsort(key, kind="stable")
            key, rest = key[order], rest[order]
            head = np.append(True, key[1:] != key[:-1])
            keys.append(key[head])
            nodes.append(rest[head])
            parent, rest = rest[head][np.cumsum(head) - 1][~head], rest[~head]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.nodes = self.keys[order], self.nodes[order]

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all pairs in a shard that differ in 1 to ``radius`` bits."""
        if not len(self.roots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        query = np.flatnonzero(self.shards[at] == shard)
        node, found = self.roots[at[query]], []
        while len(query):
            d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (d > 0)
            found.append((query[hit], node[hit]))
            # children lie sorted by (parent, label), so those within the radius are one run
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 1))
            size = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - low
            stop = np.cumsum(size)
            run = np.repeat(low - stop + size, size) + np.arange(stop[-1])
            query, node = np.repeat(query, size), self.nodes[run]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def links_of(shard: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole shards.  side: 1 in the tree, 2 searched for, 3 both."""
    order = np.argsort(shard, kind="stable")
    shard, fp, side = shard[order], fp[order], side[order]
    tree, ask = (side & 1) > 0, (side & 2) > 0
    forest = Forest(shard[tree], fp[tree])
    qs, qf, a, b = shard[ask], fp[ask], [], []
    _, inverse, count = np.unique(qs, return_inverse=True, return_counts=True)
    step = np.cumsum(count[inverse])
    at = 0
    while at < len(qs):
        end = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + STEP_PAIRS, "right")))
        q, n = forest.search(qs[at:end], qf[at:end], radius)
        x, y = spanning(qf[at:end][q].view(np.int64), forest.fp[n].view(np.int64))
        a.append(x)
        b.append(y)
        at = end
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(a), np.concatenate(b))


def links(distinct: DataFrame, radius: int = RADIUS, shard_mean: int = SHARD_MEAN, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``a, b`` (longs) that join fingerprints ``fp`` at up to ``radius`` bits into their components."""
    n = distinct.count()
    masks = key_masks(n, radius, shard_mean)
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits"))
    rows = rows.withColumn("shard", F.xxhash64("choice", "bits")).select("shard", "fp")
    large = rows.groupBy("shard").count().where(F.col("count") > shard_rows).select(F.col("shard").alias("big"), F.ceil(F.col("count") / shard_rows).cast("int").alias("chunks"))
    rows = rows.join(large, rows.shard == large.big, "left")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
    each = F.when(F.col("chunks").isNull(), F.array(F.struct(F.col("shard").alias("shard"), F.lit(3).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(
            F.xxhash64("shard", F.least("own", other), F.greatest("own", other)).alias("shard"),
            F.when(F.col("own") == other, 3).when(F.col("own") < other, 1).otherwise(2).alias("side"))))
    rows = rows.withColumn("own", F.when(F.col("chunks").isNotNull(), chunk)).select("fp", F.explode(each).alias("e")).select("e.shard", "fp", "e.side")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give(cols):
            a, b = links_of(cols[0], cols[1].view(np.uint64), cols[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(cols[0]):
                continue
            held.append(cols)
            if sum(len(h[0]) for h in held) >= 100_000:
                cols = tuple(map(np.concatenate, zip(*held, strict=True)))
                whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last shard may go on
                held = [tuple(c[whole:] for c in cols)]
                if whole:
                    yield give(tuple(c[:whole] for c in cols))
        if held:
            yield give(tuple(map(np.concatenate, zip(*held, strict=True))))

    tasks = parts(distinct.sparkSession, n * len(masks), 100_000)
    return rows.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the smallest doc_id reachable names a component.

    Null and empty texts have fingerprint zero and are linked like any other; rows with equal or null
    ids each keep their row; a component whose ids are all null has a null id; other columns are
    ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, shingle, seed, doc_id, text), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("times")), "nodes")
    label = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(label, nodes.fp == label.node, "left").select("fp", "low", "times", F.coalesce("root", "fp").alias("root"))
    ids = cut(with_least(rooted, "root", "low", "fp").select(F.col("fp").alias("_fp"), "times", F.col("least").alias("component_id")), "components")
    return hot_join(rows, ids, [("fp", "_fp")], "times").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, radius: int = 7, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component left, the one with the smallest id.

    Components are of texts of which 0.8 or more of all five-word shingles are common (see ``similar``);
    fingerprints up to ``radius`` bits apart are only the first place to look.  Every row counts for
    itself: rows that repeat an id go only if their texts are near copies, and of equal ids one row
    stays.  Rows without an id stay.  Columns are those of ``docs``; an empty table gives no rows.
    """
    from .similar import similar_documents

    row = fresh(docs, "_row")
    columns, docs = docs.columns, numbered(docs, row)
    found = similar_documents(docs.select(F.col(row).alias("doc_id"), F.col(text).alias("text")), shingle, radius, seed).select(F.col("doc_id").alias("_n"), F.col("component_id").alias("_c"))
    ids = docs.select(F.col(row).alias("_n"), F.col(doc_id).cast("long").alias("_id"))
    member = found.join(ids, "_n").select("_n", "_c", "_id", F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_n").alias("n")).alias("_place"))
    gone = with_least(member, "_c", "_place", "_n").where((F.col("least.n") != F.col("_n")) & F.col("_id").isNotNull()).select("_n")
    return docs.join(cut(gone, "gone"), F.col(row) == F.col("_n"), "left_anti").select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
