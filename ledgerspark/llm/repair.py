"""Token-id files compressed by Re-Pair: one grammar per shard, random access by expansion length.

A shard holds the ids of consecutive documents.  Frequent neighbouring pairs are replaced by a new
symbol, round after round; a rule is a pair of symbols, and each symbol's expansion length is kept,
so a span of ids is found by a search over running lengths and only the symbols that it touches are
expanded.

File format of a shard, little-endian: magic ``RPG1``; uint32 document count, base (ids from here on
are rules), rule count, sequence length; uint64 id count, first document's position; then int64
doc_id (nulls flagged by one bit each, packed), uint32 ids per document, uint32 rule pairs, uint32
expansion lengths of rules, the sequence (uint16 if every symbol fits, else uint32); last the uint32 crc32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, small
from .tokens import encoder, vocabulary

SHARD_IDS = 1 << 18
LEAST_COUNT = 8
HEAD = struct.Struct("<4sIIIIQQ")


def pair_keys(seq: np.ndarray, top: int) -> np.ndarray:
    """Neighbouring pairs as numbers; half the width if all symbols are below 65536 (``top`` bounds them)."""
    if top <= 0x10000:
        return (seq[:-1] << np.uint32(16)) | seq[1:]
    return (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]


def pair_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    keys = np.sort(keys)
    edge = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return keys[edge], np.diff(np.append(edge, len(keys)))


def compress(ids: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n, 2) and the sequence left.  Symbol ``base + i`` stands for rule i.

    Each round counts all pairs, makes a rule of every pair that occurs at least ``least`` times, and
    replaces occurrences; where two overlap, the more frequent pair wins, then the earlier place.  It ends
    when no pair is that frequent.  After the first round only places are counted whose pair was frequent
    or has a new symbol; no other pair can have become frequent.
    """
    seq, rules = ids.astype(np.uint32), []
    made, at = 0, np.arange(len(seq) - 1, dtype=np.int32)
    while len(seq) >= 2 * least:
        keys = pair_keys(seq, base + made)[at]
        pairs, count = pair_counts(keys)
        often = count >= least
        pairs, count = pairs[often], count[often]
        if not len(pairs):
            break
        seq, used, at = _replace(seq, at, keys, pairs, count, base + made)
        pairs = pairs[used].astype(np.uint64)
        bits = np.uint64(16 if base + made <= 0x10000 else 32)
        rules.append(np.stack([pairs >> bits, pairs & ((np.uint64(1) << bits) - np.uint64(1))], 1).astype(np.uint32))
        made += len(rules[-1])
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)), seq


def _slots(keys: np.ndarray) -> np.ndarray:
    """A place among 2**18 for each key."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(14)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.uint32)


def _replace(seq: np.ndarray, at: np.ndarray, keys: np.ndarray, pairs: np.ndarray, count: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence with symbols from ``first`` on for pairs, which pairs have one, and the places to count next.

    ``at`` and ``keys``: the places that may hold one of ``pairs``, in order, and what they hold.
    """
    table = np.full(1 << 18, -1, np.int32)  # of pairs that share a place the most frequent stays for this round
    order = np.argsort(count, kind="stable")
    table[_slots(pairs[order])] = order
    count = count.astype(np.int32)
    which = table[_slots(keys)]
    held = np.flatnonzero(which >= 0)
    again = np.zeros(len(seq), bool)
    again[at[held]] = True  # all places of frequent pairs, also of those without a slot
    held = held[pairs[which[held]] == keys[held]]
    at, which = at[held], which[held]
    rank = count[which]
    for _ in range(3):  # neighbours overlap; the stronger of two stays
        touch = at[1:] == at[:-1] + 1
        if not touch.any():
            break
        left = rank[:-1] >= rank[1:]
        by_left, by_right = np.append(False, touch & left), np.append(touch & ~left, False)
        lose = by_left | by_right
        # a loser whose winner itself loses stays for the next pass
        back = np.append(False, by_left[1:] & lose[:-1]) | np.append(by_right[:-1] & lose[1:], False)
        keep = np.flatnonzero(~lose | back)
        at, which, rank = at[keep], which[keep], rank[keep]
    touch = at[1:] == at[:-1] + 1
    if touch.any():  # what still overlaps: every other place of each run
        begin = np.flatnonzero(np.append(True, ~touch))
        run = np.cumsum(np.append(True, ~touch)) - 1
        keep = (np.arange(len(at)) - begin[run]) % 2 == 0
        at, which = at[keep], which[keep]
    used = np.flatnonzero(np.bincount(which, minlength=len(pairs)))
    symbol = np.zeros(len(pairs), np.uint32)
    symbol[used] = first + np.arange(len(used))
    out = seq.copy()
    out[at] = symbol[which]
    stay = np.ones(len(seq), bool)
    stay[at + 1] = False
    out, again = out[stay], again[stay]
    new = out >= first
    again |= new
    again[:-1] |= new[1:]
    return out, used, np.flatnonzero(again[:-1]).astype(np.int32)


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to.  A rule only names ids and rules before it."""
    size = np.ones(len(rules), np.int64)
    done = np.zeros(len(rules), bool)
    while not done.all():
        left, right = (np.where(rules[:, k] >= base, rules[:, k].astype(np.int64) - base, -1) for k in (0, 1))
        ready = ~done & ((left < 0) | done[left]) & ((right < 0) | done[right])
        size[ready] = np.where(left < 0, 1, size[left])[ready] + np.where(right < 0, 1, size[right])[ready]
        done |= ready
    return size


def expand(seq: np.ndarray, rules: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: rules are spelled out once, then looked up."""
    begin = np.cumsum(size) - size
    pool = np.empty(int(size.sum()), np.uint32)
    # a rule's pieces come from rules before it; rules of one depth are spelled together
    depth = np.zeros(len(rules), np.int64)
    side = [np.where(rules[:, k] >= base, rules[:, k].astype(np.int64) - base, -1) for k in (0, 1)]
    while True:
        new = 1 + np.maximum(*(np.where(x < 0, 0, depth[x]) for x in side)) if len(rules) else depth
        if (new == depth).all():
            break
        depth = new
    for level in range(1, int(depth.max(initial=0)) + 1):
        own = np.flatnonzero(depth == level)
        shift = begin[own].copy()
        for k in (0, 1):
            leaf = side[k][own] < 0
            pool[shift[leaf]] = rules[own[leaf], k]
            inner, to = side[k][own[~leaf]], shift[~leaf]
            pool[ragged(to, size[inner])] = pool[ragged(begin[inner], size[inner])]
            shift += np.where(leaf, 1, size[np.maximum(side[k][own], 0)])
    which = seq.astype(np.int64) - base
    rule = np.flatnonzero(which >= 0)
    n = np.ones(len(seq), np.int64)
    n[rule] = size[which[rule]]
    start = len(pool) + np.arange(len(seq))
    start[rule] = begin[which[rule]]
    return np.concatenate([pool, seq.astype(np.uint32)])[ragged(start, n)]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of runs, one after another."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


def width(base: int, n_rules: int) -> str:
    return "<u2" if base + n_rules <= 0x10000 else "<u4"


@dataclass
class Shard:
    """One file, decoded as far as its tables; ids are expanded when asked for."""

    doc_ids: list[int | None]
    counts: np.ndarray
    first: int
    base: int
    rules: np.ndarray
    sizes: np.ndarray
    seq: np.ndarray

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the shard; expands only the symbols that hold them."""
        if begin == 0 and end is None:
            return expand(self.seq, self.rules, self.sizes, self.base)
        symbols = self.seq.astype(np.int64)
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        size[rule] = self.sizes[symbols[rule] - self.base]
        stop = np.cumsum(size)
        end = int(stop[-1]) if end is None and len(stop) else (end or 0)
        if begin >= end:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(stop, [begin, end - 1], "right")
        skipped = begin - int(stop[a] - size[a])
        return expand(self.seq[a : b + 1], self.rules, self.sizes, self.base)[skipped : skipped + end - begin]


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, base: int, first: int = 0) -> bytes:
    rules, seq = compress(ids, base)
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    body = b"".join([
        HEAD.pack(b"RPG1", len(doc_ids), base, len(rules), len(seq), len(ids), first),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.asarray(counts, "<u4").tobytes(),
        rules.astype("<u4").tobytes(), lengths(rules, base).astype("<u4").tobytes(), seq.astype(width(base, len(rules))).tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def read_shard(blob: bytes) -> Shard:
    body = memoryview(blob)[:-4]
    if zlib.crc32(body) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("the shard's checksum doesn't match")
    magic, docs, base, n_rules, n_seq, _, first = HEAD.unpack_from(body)
    if magic != b"RPG1":
        raise ValueError("not a token shard")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, n, at)
        at += out.nbytes
        return out

    ids, null = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs)
    counts, rules, sizes, seq = take("<u4", docs), take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules), take(width(base, n_rules), n_seq)
    return Shard([None if z else int(d) for d, z in zip(ids, null, strict=True)], counts, first, base, rules, sizes.astype(np.int64), seq)


SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("blob", pa.binary())])
READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, vocab: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", each: int = 5000, each_bytes: int = 32_000_000) -> DataFrame:
    """Encode whole texts and write shards in ascending ``doc_id`` order; returns the written table.

    Null texts count as empty; each document ends with ``end_id``; null ids come first; rows with
    equal ids are ordered by text.  Other columns are ignored.  The table (in the shared folder) has
    ``part, shard, n_ids, blob``: parts follow one another in id order, shards within a part too.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-count // each), -(-size // each_bytes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, shard, before = TaskContext.get().partitionId(), encoder(vocab), 0, 0
        base = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        held_ids, held, held_n = [], [], 0
        tail = np.array([end_id], np.uint32)

        def flush():
            nonlocal held_ids, held, held_n, shard, before
            sizes = np.array([len(h) for h in held])
            blob = write_shard(held_ids, sizes, np.concatenate(held), base, before)
            out = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_ids": held_n, "blob": blob}], SHARDS)
            shard, before, held_ids, held, held_n = shard + 1, before + held_n, [], [], 0
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, ids, counts in enc.encode_all(batch.column(1)):
                stop = np.cumsum(counts)
                for k, (e, c) in enumerate(zip(stop.tolist(), counts.tolist(), strict=True)):
                    held_ids.append(keys[at + k])
                    held.append(np.concatenate([ids[e - c : e], tail]))
                    held_n += c + 1
                    if held_n >= SHARD_IDS:
                        yield flush()
        if held:
            yield flush()

    # the beginning of the text is part of the range, so that rows with one id (or none) needn't meet in one task
    placed = rows.repartitionByRange(n, "doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    return cut(placed.mapInArrow(task, "part int, shard int, n_ids long, blob binary"), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Documents read back from shards: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before; one total per part (as many as there were
    partitions) is summed for it.
    """
    from pyspark.sql import Window

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = read_shard(blob.as_py())
                raw, stop = memoryview(s.ids().astype("<u4").tobytes()), np.cumsum(s.counts.astype(np.int64))
                begin = stop - s.counts
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(crc), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.first + begin, pa.int64()),
                    pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())], schema=READ)

    rows = shards.select("part", "blob").mapInArrow(task, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return rows.join(small(before, "before"), "part").select("doc_id", (F.col("before") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, vocabulary(), end_id=0))
