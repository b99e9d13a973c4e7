"""Components of documents whose sets of shingles have a Jaccard similarity of 0.8 or more, exactly.

Links come from three places, each time as pairs that are verified on whole sets before they count:
SimHash fingerprints a few bits apart; a forest over the texts that share a prefix shingle and whose sketches
allow it; and all such pairs of different components that are left.  A similarity of t needs ``ceil(t * n)`` common
shingles, so two such sets share one of the first ``n - ceil(t * n) + 1`` in any common order: the last
step misses no pair, whatever the fingerprints say.  The first two only leave it little to do.  The
order puts shingles that are counted often last, so that prefixes are of rare ones.

What is shuffled is small: prefix shingles travel as packed numbers and most of them, which one text has, end
where they arrive; pairs of a shared shingle are looked at inside a task, which gives those that sketches can't
rule out; and the few texts that are still to be compared travel once for each pair, not their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, hot_join, parts
from .simhash import links, simhash
from .text import partial_sums, slices, total

#: The least similarity as a fraction.
NUM, DEN = 4, 5
#: Counters of the order (as bits of a shingle's hash).
COUNTER_BITS = 18
#: Bits of a set's sketch, and of the folded one that texts of a shared shingle are compared by.
SKETCH_BITS, FOLD_BITS = 2048, 512
#: Prefix shingles that are packed at a time, and those that one part of the table has on average.
PACKED, PART_ENTRIES = 400_000, 1_000_000
#: Texts of a shared shingle that are compared in one task; of more each two chunks of them are a task's.
BUCKET_ROWS = 4096
#: Pairs of texts that one step looks at, by sizes and roots (an eighth of it by sketches).
STEP_PAIRS = 400_000
#: Texts that one task compares with another.
GROUP_ROWS = 256
#: Bits of the filter that tells which texts are in a pair: 8 a text, between these.
FILTER_BITS = (20, 28)


def shingles(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending; a text of fewer words is one shingle, none has none."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), joined), np.uint64))


def prefix(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the common order; a set without shingles has the prefix 0."""
    if not len(own):
        return np.zeros(1, np.uint64)
    order = np.lexsort((own, counts[own >> np.uint64(64 - COUNTER_BITS)]))
    return own[order[: len(own) + 1 + -NUM * len(own) // DEN]]


def near_sizes(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def shingle_counts(texts: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """In how many of the texts shingles of each counter occur."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        got = np.zeros(1 << COUNTER_BITS)
        for b in slices(batches):
            sets = [shingles(t, shingle, seed) for t in b.column(0).cast(pa.binary()).to_pylist()]
            if sets:
                got += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(got))
        return got

    got = total(partial_sums(texts.select("text"), add))
    return np.zeros(1 << COUNTER_BITS) if got is None else got


def odd_sketch(own: np.ndarray) -> np.ndarray:
    """Bits that say which of SKETCH_BITS classes have an odd number of shingles, as longs.

    The sketches of two sets differ in no more bits than the sets in shingles.
    """
    odd = np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def profiles(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``doc_id, h1, h2, fp, n, sketch`` for every row of ``doc_id, text``; h1 and h2 are hashes of the text, n counts distinct shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(3).cast(pa.binary()).to_pylist()
            fp = np.array([simhash(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            own = [shingles(t, shingle, seed) for t in texts]
            sketch = [odd_sketch(x).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp), pa.array([len(x) for x in own], pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "h1", "h2", "fp", "n", "sketch"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), "text").alias("h2"), "text")
    return rows.mapInArrow(task, "doc_id long, h1 long, h2 long, fp long, n long, sketch binary")


def shared_prefixes(docs: DataFrame, shingle: int, seed: int, entries: int) -> DataFrame:
    """``h, doc_id``: prefix shingles that several rows of ``doc_id, text`` have.

    Of rows with equal texts that one task meets together the first stands for all.
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(docs, shingle, seed).astype(np.uint32))
    n = parts(spark, entries, PART_ENTRIES)

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (h % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, ids, part = h[order], ids[order], part[order]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        stop = np.append(edge[1:], len(part))
        blobs = [h[x:y].tobytes() + ids[x:y].tobytes() for x, y in zip(edge, stop, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edge]), pa.array(blobs, pa.binary())], ["part", "blob"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches):
            texts: dict[bytes, int] = {}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts.setdefault(t, i)
            for t, i in texts.items():
                own = prefix(shingles(t, shingle, seed), counts.value)
                held.append((own, np.full(len(own), i, np.int64)))
                size += len(own)
            if size >= PACKED:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    def several(blobs: list[bytes]) -> pa.RecordBatch:
        half = [np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs]
        h, ids = (np.concatenate([x[k] for x in half]) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        near = h[1:] == h[:-1]
        kept = np.append(near, False) | np.append(False, near) if len(h) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(h[kept]), pa.array(ids[kept])], ["h", "doc_id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and part != now:
                    yield several(held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield several(held)

    packed = docs.select("doc_id", "text").mapInArrow(task, "part long, blob binary")
    return packed.repartition(n, "part").sortWithinPartitions("part").mapInArrow(meet, "h long, doc_id long")


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            held[spread(b.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], ["blob"])

    found = [np.frombuffer(r.blob, np.uint8) for r in keys.repartition(4).mapInArrow(task, "blob binary").collect()]
    return np.bitwise_or.reduce(found)


def spread(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys in a filter; row numbers of a file follow one another, so they are mixed."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Those of the pairs ``a, b`` of keys whose whole sets are similar enough.

    Sets of m and n shingles that differ in more than (m + n) / 9 can't be, so most pairs go by their
    sketches, which differ in no more; only the others' texts are read again.  A text meets those that it is
    compared with in groups of bounded size, in order, so that a task holds one set and one batch.
    """
    spark = docs.sparkSession
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")), s)

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (4, 5))
                few = (NUM + DEN) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (DEN - NUM) * (b.column(2).to_numpy() + b.column(3).to_numpy())
                yield b.filter(pa.array(few)).select(["a", "b"])

    near = pairs.where(near_sizes(F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    pairs = cut(near.mapInArrow(allowed, "a long, b long"), "pairs")
    count = pairs.count()
    if not count:
        return pairs
    chunks = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count("*") / GROUP_ROWS).alias("chunks"))
    member = pairs.join(chunks, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("s"), F.col("b").alias("id"), F.lit(1).alias("side"))
    wanted = cut(member.unionByName(member.select("a", "s", F.col("a").alias("id"), F.lit(0).alias("side")).distinct()), "wanted")
    bits = int(np.clip((16 * count).bit_length(), *FILTER_BITS))
    shared = spark.sparkContext.broadcast(key_filter(wanted.select("id"), bits))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = spread(b.column(0).to_numpy(), bits)
            yield b.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in slices(batches):
            a, s, ids, side = (b.column(k).to_pylist() for k in range(4))
            good = []
            for k, t in enumerate(b.column(4).cast(pa.binary()).to_pylist()):
                found = shingles(t, shingle, seed)
                if side[k] == 0:
                    own = (a[k], s[k], found)
                    continue
                assert own is not None and own[:2] == (a[k], s[k])
                common = len(np.intersect1d(own[2], found, assume_unique=True))
                if (NUM + DEN) * common >= NUM * (len(own[2]) + len(found)):
                    good.append((a[k], ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["a", "b"])

    texts = docs.select(F.col("doc_id").alias("_d"), "text").mapInArrow(needed, "_d long, text string")
    met = wanted.join(texts, F.col("id") == F.col("_d")).select("a", "s", "id", "side", "text")
    n = parts(spark, count, 20_000)
    return cut(met.repartition(n, "a", "s").sortWithinPartitions("a", "s", "side").mapInArrow(compare, "a long, b long"), "verified")


def fingerprint_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs of keys that fingerprints propose: equal ones, and a spanning forest of near ones."""
    heads = cut(nodes.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    same = nodes.join(heads, "fp").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = links(heads.select("fp"), radius)
    a, b = (heads.select(F.col("fp").alias(f"_{s}"), F.col("head").alias(f"head_{s}")) for s in "ab")
    near = near.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.union(near)


def opened(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """``h, key, root`` of the buckets (by shingle) that hold several components."""
    label = components(edges)
    rows = buckets.select("h", "key").join(label, F.col("key") == F.col("node"), "left").select("h", "key", F.coalesce("root", "key").alias("root"))
    rows = cut(rows, "rooted")
    open_ = rows.groupBy(F.col("h").alias("_h")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("_h")
    return cut(rows.join(open_, F.col("h") == F.col("_h")).drop("_h"), "open")


def close(n: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(i, j)``, i < j, of different roots that sizes and sketches allow, block by block."""
    step = max(1, STEP_PAIRS // max(1, len(n)))
    for at in range(0, len(n), step):
        own = np.arange(at, min(at + step, len(n)))
        m, k = n[own][:, None], n[None, at:]
        fit = (root[own][:, None] != root[None, at:]) & (DEN * np.minimum(m, k) >= NUM * np.maximum(m, k)) & (own[:, None] < np.arange(at, len(n))[None])
        i, j = np.nonzero(fit)
        for x in range(0, len(i), STEP_PAIRS // 8):  # sketches are some words each
            p, q = own[i[x : x + STEP_PAIRS // 8]], at + j[x : x + STEP_PAIRS // 8]
            apart = np.bitwise_count(sketch[p] ^ sketch[q]).sum(1, dtype=np.int64)
            good = (NUM + DEN) * apart <= (DEN - NUM) * (n[p] + n[q])
            yield p[good], q[good]
    yield np.zeros(0, np.int64), np.zeros(0, np.int64)


def bucket_pairs(open_: DataFrame, nodes: DataFrame, forest: bool) -> DataFrame:
    """Pairs ``a, b`` of keys of different components that share a shingle and may be similar: all of them, or
    (``forest``) those that join what no other pair of the same task does."""
    large = open_.groupBy(F.col("h").alias("_h")).count().select("_h", F.ceil(F.col("count") / BUCKET_ROWS).alias("chunks"))
    rows = open_.join(large, F.col("h") == F.col("_h")).drop("_h")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "key"), F.col("chunks"))
    # rows of a large bucket meet those of every chunk: each two chunks are a cell
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda other: F.xxhash64("h", F.least("own", other), F.greatest("own", other)))
    rows = rows.withColumn("own", own).select("h", "key", "root", F.explode(cells).alias("cell"))
    held = nodes.select(F.col("key").alias("_k"), "n", "sketch")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}  # roots that a pair of this task joins, for a forest

        def top(v: int) -> int:
            while up.get(v, v) != v:
                up[v] = v = up.get(up[v], up[v])
            return v

        def pairs(key: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, int]]:
            if forest:
                tops = [top(r) for r in root.tolist()]
                if len(set(tops)) == 1:
                    return
                root = np.array(tops)
            for i, j in close(n, root, sketch):
                if not forest:
                    yield from zip(key[i].tolist(), key[j].tolist(), strict=True)
                    continue
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = top(int(root[a])), top(int(root[b]))
                    if x != y:
                        up[x] = y
                        yield int(key[a]), int(key[b])

        def cells() -> Iterator[list[np.ndarray]]:
            """Whole runs of cells, a batch's worth at a time."""
            left: list[np.ndarray] | None = None
            for batch in batches:
                cols = [batch.column(k).to_numpy() for k in range(4)]
                if not len(cols[0]):
                    continue
                # parity classes fold as the shingles do
                sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(cols[0]), -1, FOLD_BITS // 64)
                cols.append(np.bitwise_xor.reduce(sketch, axis=1))
                if left is not None:
                    cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
                whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on
                left = [c[whole:] for c in cols]
                if whole:
                    yield [c[:whole] for c in cols]
            if left is not None:
                yield left

        for cell, key, root, n, sketch in cells():
            edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            found: set[tuple[int, int]] = set()
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(cell)], strict=True):
                if y - x > 1:
                    found.update(pairs(key[x:y], root[x:y], n[x:y], sketch[x:y]))
            made = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], ["a", "b"])

    rows = rows.join(held, F.col("key") == F.col("_k")).select("cell", "key", "root", "n", "sketch")
    n = parts(open_.sparkSession, open_.count(), 100_000)
    return rows.repartition(n, "cell").sortWithinPartitions("cell", "key").mapInArrow(task, "a long, b long")


def similar_documents(docs: DataFrame, shingle: int, radius: int, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row; the smallest doc_id reachable names a component.

    Ids are row numbers: none is null, none repeats.  Rows are taken for equal texts by two 64-bit hashes, and
    shingles by one.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = cut(profiles(docs, shingle, seed), "profiles")
    nodes = cut(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("key"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("fp", "n", "sketch"))), "nodes")
    member = cut(hot_join(rows.select("doc_id", "h1", "h2"), nodes.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "key", "times"), [("h1", "_h1"), ("h2", "_h2")], "times").select("doc_id", "key"), "members")
    check = partial(verified, nodes=nodes, docs=docs, shingle=shingle, seed=seed)
    edges = check(fingerprint_pairs(nodes.select("key", "fp"), radius))
    entries = rows.agg(F.coalesce(F.sum(F.floor(F.col("n") / DEN) + 1), F.lit(0))).first()[0]
    shared = shared_prefixes(docs, shingle, seed, entries)
    ids = member.select(F.col("doc_id").alias("_d"), "key")
    buckets = cut(shared.join(ids, F.col("doc_id") == F.col("_d")).select("h", "key").distinct(), "buckets")
    for forest in (True, False):
        buckets = opened(buckets, edges)
        if buckets.isEmpty():
            break
        edges = edges.union(check(bucket_pairs(buckets, nodes, forest)))
    label = components(edges)
    # a key is the smallest id of its text and a component's name its smallest key
    return member.join(label, F.col("key") == F.col("node"), "left").select("doc_id", F.coalesce("root", "key").alias("component_id"))
