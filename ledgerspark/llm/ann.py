"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids (about the square root of the number of vectors) and residual codebooks are fitted on a
bounded sample; every vector is indexed.  How many lists a query probes and how many codes it reranks
are not constants but come from an audit: for some queries the true neighbours are found by brute force,
and both numbers are the least that reach nearly all of them.

A query looks into the lists of the centroids nearest to it.  Inner products with what the codes stand for
score the codes there, for all queries of a task at once; only the best codes of each shelf, a small part of the
table that holds the best ones over all lists, get an exact inner product.  Equal vectors share one entry, which
keeps as many of their smallest ids as a result can hold.  Lists are dealt over shelves of bounded size (a long list
over several), and a query goes once to each shelf that it needs, so no task has to take a whole list.

What the audit's queries need isn't what every query needs, so an exact check follows.  A list comes with its radius,
which bounds inner products; only lists whose bound reaches a query's worst result so far can hold a better one.  Entries
of those are looked at in single precision, which may be wrong by so much at most, and scored exactly where that may reach
it.  Vectors are scaled (by powers of two), so large and small components neither overflow nor vanish.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, share, small

#: Vectors that centroids and codebooks are fitted on: so many for each list and at least so many, at most so many.
SAMPLE_PER_LIST, SAMPLE_LEAST, SAMPLE_MOST = 32, 8192, 1 << 18
#: Components of a sub-vector, and codes of a codebook.
SUB_WIDTH, CODES = 2, 256
#: Queries whose true neighbours are found by brute force, and the part of those that each of the two numbers reaches.
AUDIT, REACH = 100, 0.985
#: Entries of a shelf and queries that meet it in one task, at most; and what components either of them has at most.
SHELF, BLOCK, COMPONENTS = 32_000, 32_000, 1 << 21
#: Smaller tables are cut in shelves of so many entries at least, so that each core has this many tasks.
LEAST_SHELF, TASKS = 2000, 2
#: Estimates that a task holds at a time (as a core's cache does), and entries of those.
HELD, TILE = 1 << 19, 2048
TOP = 20


def usable(vec: str) -> F.Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vec)
    low, high = F.array_min(v), F.array_max(v)  # null components aside; NaN is above all others
    fine = ~F.array_contains(v, float("inf"))  # null if there is a null component instead
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine & (low > float("-inf")) & ~F.isnan(high) & ((low != 0) | (high != 0)), F.lit(False))


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of numbers as bytes."""
    at = np.append(0, np.cumsum(sizes)).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])


def unpacked(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def vectors_of(blobs: list[bytes], kind: str) -> np.ndarray:
    return unpacked(blobs, kind).astype(float)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's method; at most as many as there are distinct vectors."""
    x = np.unique(x, axis=0)
    g = np.random.default_rng(seed)
    c = x[g.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        s = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    # half a centroid's square is one more component, so that a product says it all; blocks stay in a core's cache
    x, ct = np.append(x, np.ones((len(x), 1)), axis=1), np.append(c.T, -(c * c).sum(1)[None] / 2, axis=0)
    out, step = np.empty(len(x), np.int64), max(1, (1 << 19) // max(1, len(c)))
    for at in range(0, len(x), step):
        out[at : at + step] = (x[at : at + step] @ ct).argmax(1)
    return out


#: Single precision's error of an estimate by tables, of what its parts could add up to; and below its least number.
ROUNDING, LEAST = 4e-6, 1e-35


def rounding(dim: int) -> float:
    """Single precision's error of an inner product, of the product of the lengths."""
    return (dim + 8) * 2.0**-24


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


class Index:
    """Coarse centroids and residual codebooks, of vectors scaled by ``2 ** -scale``."""

    def __init__(self, sample: np.ndarray, lists: int, sub_width: int = SUB_WIDTH, codes: int = CODES, seed: int = 5, scale: int = 0):
        self.dim, self.scale = sample.shape[1], scale
        sample = np.ldexp(sample, -scale)
        self.coarse = kmeans(sample, lists, seed)
        self.edges = np.append(np.arange(0, self.dim, sub_width), self.dim)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        rest = rest[np.random.default_rng(seed).permutation(len(rest))[: 32 * codes]]
        self.books = [kmeans(rest[:, a:b], codes, seed + 1 + k) for k, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False))]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and distance from the centroid."""
        x = np.ldexp(x, -self.scale)
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)], 1).astype(np.uint8)
        return own, codes, lengths(rest) * (1 + ROUNDING)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes stand for: the tables of unit vectors have the codes' components."""
        t, out = self.tables(np.eye(self.dim)), self.coarse.astype(np.float32)[own]
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            out[:, a:b] += t[a:b, k].T[codes[:, k]]
        return out

    @staticmethod
    def ask(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries scaled so that their largest component is about 1, and the exponents by which."""
        e = np.frexp(np.abs(q).max(1))[1]
        return np.ldexp(q, -e[:, None]), e

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by inner product with their centroid, largest first."""
        return np.argsort(-(self.ask(q)[0] @ self.coarse.T), axis=1, kind="stable")

    def nearest_lists(self, few: np.ndarray, probes: int) -> np.ndarray:
        """What the centroids of each query's nearest lists reach."""
        if probes >= len(self.coarse):
            return np.full(len(few), -np.inf)
        return -np.partition(-(few @ self.coarse.T), probes - 1, axis=1)[:, probes - 1]

    def wanted(self, few: np.ndarray, bar: np.ndarray, radius: np.ndarray, lists: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(queries, lists) whether a list's products, up to a radius from its centroid, may reach the query's bar."""
        c = self.coarse[lists]
        return few @ c.T + lengths(few)[:, None] * (radius[lists] + ROUNDING * lengths(c) + LEAST) >= bar[:, None]

    def scaled(self, score: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.ldexp(score, -(self.scale + e))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, sub-vectors, codes) inner products."""
        out = np.zeros((len(q), len(self.books), max(map(len, self.books))), np.float32)
        for k, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books, strict=False)):
            out[:, k, : len(book)] = q[:, a:b] @ book.T
        return out

    def estimates(self, q: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, entries) inner products as the lists ``own`` and the codes give them, scaled for each query."""
        return self.ask(q)[0].astype(np.float32) @ self.decoded(own, codes).T


@dataclass
class Settings:
    """What the audit found: lists, lists probed, codes reranked, and the part of true neighbours it reached."""

    entries: int
    lists: int
    probes: int
    rerank: int
    recall: float


def best_rows(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Columns of each row's ``top`` largest scores, ties by smaller id."""
    return np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :top]


def hits(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, of which there is little."""
    flat = np.append(m.ravel(), np.zeros(-m.size % 8, bool))
    eight = np.flatnonzero(flat.view(np.uint64))
    at, k = np.nonzero(flat.reshape(-1, 8)[eight])
    return np.divmod(eight[at] * 8 + k, m.shape[1])


def products(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of q and x."""
    return np.concatenate([np.zeros(0), *(np.einsum("kd,kd->k", q[r[a : a + 4000]], x[c[a : a + 4000]]) for a in range(0, len(r), 4000))])


def largest(r: np.ndarray, score: np.ndarray, rows: int, top: int) -> np.ndarray:
    """The ``top`` largest scores of each row, -inf where it has fewer; r ascends."""
    n = np.bincount(r, minlength=rows)
    out = np.full((rows, max(top, n.max(initial=0))), -np.inf)
    out[r, np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)] = score
    return -np.partition(-out, top - 1, axis=1)[:, :top]


class Cell:
    """Entries of a shelf, by list, and the queries of a block that meet them."""

    def __init__(self, index: Index, own: pd.DataFrame, ask: pd.DataFrame, kind: str, radius: np.ndarray):
        at = own["list"].to_numpy()
        order = np.argsort(at, kind="stable")
        self.index, self.own, at = index, own.iloc[order], at[order]
        self.start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        self.stop = np.append(self.start[1:], len(at))
        self.at, self.x = at, vectors_of(self.own.v.tolist(), kind)
        self.q, self.who, self.bar = vectors_of(ask.v.tolist(), kind), ask.query_id.to_numpy(), ask.bar.to_numpy()
        few = index.ask(self.q)[0]
        self.size, self.few = lengths(few), few.astype(np.float32)
        self.look = index.wanted(few, self.bar, radius, at[self.start])

    def tiles(self, look: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Queries (of ``look``) and the entries that they meet at a time; where most lists are wanted, all queries meet all entries."""
        if 3 * (look @ (self.stop - self.start)).sum() > len(look) * len(self.x):
            runs = [(np.arange(len(look)), 0, len(self.x))]
        else:
            runs = ((np.flatnonzero(look[:, k]), self.start[k], self.stop[k]) for k in np.flatnonzero(look.any(0)))
        for rows, lo, hi in runs:
            for at in range(lo, hi, TILE):
                yield rows, at, min(at + TILE, hi)

    def chosen(self, rerank: int, top: int) -> Iterator[np.ndarray]:
        """For some queries after others, the largest exact products of the ``rerank`` entries with the best codes (ties are taken too).

        An entry counts once, however many ids it has, and not where it has the query's own id alone.
        """
        ids = self.own.ids
        one, several = np.array([i[0] for i in ids], np.int64), np.array([len(i) > 1 for i in ids])
        near = self.index.decoded(self.at, unpacked(self.own.code.tolist(), "u1"))
        for a in range(0, len(self.q), step := HELD // TILE):
            few, look = self.few[a : a + step], self.look[a : a + step]
            # the best estimates so far, and a bar that the final ones are known to reach
            best, bar = np.full((len(few), rerank), -np.inf, np.float32), np.full(len(few), np.finfo(np.float32).min, np.float32)
            found = []
            for rows, lo, hi in self.tiles(look):
                est = few[rows] @ near[lo:hi].T
                if hi - lo > rerank and not np.isfinite(best[rows, 0]).all():
                    bar[rows] = np.maximum(bar[rows], np.partition(est, hi - lo - rerank, axis=1)[:, hi - lo - rerank])
                r, c = hits(est >= bar[rows, None])
                e = est[r, c]
                found.append((rows[r], lo + c, e))
                best[rows] = np.partition(np.append(best[rows], largest(r, e, len(rows), rerank).astype(np.float32), axis=1), rerank, axis=1)[:, rerank:]
                bar[rows] = np.maximum(bar[rows], best[rows, 0])  # the least of them
            r, c, e = (np.concatenate(z) for z in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)), *found, strict=True))
            kept = (e >= bar[r]) & (several[c] | (one[c] != self.who[a + r]))
            r, c = r[kept], c[kept]
            order = np.argsort(r, kind="stable")
            r, c = r[order], c[order]
            yield largest(r, products(self.q, self.x, a + r, c), len(few), top)

    def reaching(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, entries and exact products, of all that may reach a query's bar."""
        scaled = np.ldexp(self.x, -self.index.scale)
        off = rounding(scaled.shape[1]) * lengths(scaled) + LEAST * scaled.shape[1]
        x = scaled.astype(np.float32)
        for k, (lo, hi) in enumerate(zip(self.start, self.stop, strict=True)):
            rows = np.flatnonzero(self.look[:, k])
            for a in range(0, len(rows), step := max(1, HELD // (hi - lo))):
                some = rows[a : a + step]
                least = self.bar[some] - self.size[some] * off[lo:hi].max()
                est = self.few[some] @ x[lo:hi].T
                r, c = hits(est >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
                fit = est[r, c] + self.size[some[r]] * off[lo + c] >= self.bar[some[r]]
                r, c = some[r[fit]], lo + c[fit]
                yield r, c, products(self.q, self.x, r, c)


def audit(coded: DataFrame, asked: DataFrame, index: Index, shared, top: int, entries: int, kind: str) -> Settings:
    """The least numbers of probes and reranked codes that reach the true neighbours of some queries.

    The queries' vectors (a bounded number) go to all tasks, which give each query's best entries of
    their part by exact inner products; then the codes that score above each true neighbour are counted.
    """
    spark, lists = coded.sparkSession, len(index.coarse)
    rows = asked.select("query_id", "v").orderBy(F.xxhash64(F.lit("audit"), "query_id"), "query_id").limit(AUDIT).collect()
    if not rows:
        return Settings(entries, lists, lists, top, 1.0)
    q = spark.sparkContext.broadcast(vectors_of([bytes(r.v) for r in rows], kind))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, own = vectors_of(b.column(0).to_pylist(), kind), b.column(2).to_numpy()
                codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
                s = q.value @ x.T
                few = np.argpartition(-s, min(top, len(x) - 1), axis=1)[:, : top + 1]
                est = np.take_along_axis(shared.value.estimates(q.value, own, codes), few, 1)
                who = np.repeat(np.arange(len(s)), few.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.take_along_axis(s, few, 1).ravel()), pa.array(own[few].ravel()), pa.array(est.ravel())], ["who", "score", "list", "estimate"])

    best = Window.partitionBy("who").orderBy(F.desc("score"), "list")
    true = coded.mapInArrow(exact, "who long, score double, list int, estimate float").withColumn("place", F.row_number().over(best))
    true = true.where(F.col("place") <= top + 1).select("who", "list", "estimate").collect()  # the query's own entry is one of them
    who, own, est = (np.array([r[k] for r in true]) for k in range(3))
    rank = np.argsort(index.order(q.value), axis=1)[who, own] + 1
    bar = spark.sparkContext.broadcast((who, est.astype(np.float32)))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker, least = bar.value
        n = np.zeros(len(asker), np.int64)
        for b in batches:
            if b.num_rows:
                codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                got = np.sort(shared.value.estimates(q.value, b.column(2).to_numpy(), codes), axis=1)
                n += [got.shape[1] - np.searchsorted(got[w], e, "right") for w, e in zip(asker.tolist(), least, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["k", "n"])

    counted = {r.k: r.n for r in coded.mapInArrow(above, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    place = np.array([counted[k] for k in range(len(who))]) + 1
    probes = int(np.ceil(np.quantile(rank, REACH, method="inverted_cdf")))
    inside = place[rank <= probes]
    rerank = max(top + 1, int(np.ceil(np.quantile(inside, REACH, method="inverted_cdf"))))
    return Settings(entries, lists, probes, rerank, float(((rank <= probes) & (place <= rerank)).mean()))


def shelves(coded: DataFrame, most: int) -> DataFrame:
    """``list, chunk, chunks, shelf``: lists of one shelf hold about ``most`` entries; long ones are cut."""
    n = coded.groupBy("list").count().collect()  # a row for each list at most
    out, shelf, held = [], 0, 0
    for r in sorted(n, key=lambda r: r["list"]):
        chunks = -(-r["count"] // most)
        for c in range(chunks):
            size = r["count"] // chunks
            if held and held + size > most:
                shelf, held = shelf + 1, 0
            out.append((r["list"], c, chunks, shelf))
            held += size
    return coded.sparkSession.createDataFrame(out, "list int, chunk int, chunks int, shelf int")


def search(vectors: DataFrame, is_query: F.Column, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``top`` rows of largest inner product found.

    A query is never its own candidate; rows with an equal vector are.  A row that repeats an id and its
    vector counts once; an id that has several vectors is one query with all of them.  Ties go to the
    smaller vec_id.  Vectors that are null, zero, of another length than most, or hold null or non-finite
    components, and rows without id, take no part.  Other columns are ignored; an empty table gives no rows.
    ``settings`` replaces the audit.
    """
    found = Search(vectors, is_query, top, vec_id, embedding, settings)
    return found.result


class Search:
    """A search and the settings that it used."""

    def __init__(self, vectors: DataFrame, is_query: F.Column, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings | None = None):
        spark = vectors.sparkSession
        self.settings, self.result = settings, spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        # single precision stays so where it is stored or sent
        single = vectors.select(embedding).dtypes[0][1] == "array<float>"
        kind, kept = ("f4", "array<float>") if single else ("f8", "array<double>")
        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kept).alias("v"), is_query.alias("ask"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    flat, sizes = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind) + 0, b.column(1).value_lengths().to_numpy()  # -0 becomes 0
                    most = np.maximum.reduceat(np.abs(flat), np.append(0, np.cumsum(sizes)[:-1])).astype(float)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), packed(flat, sizes), pa.array(most), b.column(2)], ["vec_id", "dim", "v", "most", "ask"])

        # as bytes a vector is quickly compared
        rows = cut(rows.where(F.col("vec_id").isNotNull() & usable("v")).mapInArrow(pack, "vec_id long, dim int, v binary, most double, ask boolean"), "vectors")
        sizes = rows.groupBy("dim").agg(F.count("*").alias("count"), F.max("most").alias("most")).orderBy(F.desc("count"), "dim").limit(1).collect()
        if not sizes:
            return
        rows = rows.where(F.col("dim") == sizes[0]["dim"])
        asked = cut(rows.where("ask").select(F.col("vec_id").alias("query_id"), "v").distinct(), "asked")
        # equal vectors share an entry; a result holds at most top of them besides the query itself
        place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        entries = rows.select("vec_id", "v").repartition("v").distinct().withColumn("place", place)
        entries = cut(entries.where(F.col("place") <= top + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
        n = entries.count()
        lists = min(SAMPLE_MOST // SAMPLE_PER_LIST, max(1, round(n**0.5)))
        sample = share(entries.select("v", F.col("ids")[0].alias("id")), "id", min(SAMPLE_MOST, max(SAMPLE_LEAST, lists * SAMPLE_PER_LIST))).toArrow()
        if not sample.num_rows:
            return
        fitted = vectors_of(sample["v"].to_pylist(), kind)[np.argsort(sample["id"].to_numpy(), kind="stable")]
        index = Index(fitted, lists, scale=int(np.frexp(sizes[0]["most"])[1]))
        shared = spark.sparkContext.broadcast(index)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    own, codes, off = shared.value.encode(vectors_of(b.column(0).to_pylist(), kind))
                    codes = packed(codes, np.full(len(codes), codes.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), codes, pa.array(off)], ["v", "ids", "list", "code", "off"])

        coded = cut(entries.mapInArrow(encode, "v binary, ids array<long>, list int, code binary, off double"), "codes")
        self.settings = s = settings or audit(coded, asked, index, shared, top, n, kind)
        block_rows = max(1, min(BLOCK, COMPONENTS // index.dim))
        tasks = TASKS * spark.sparkContext.defaultParallelism
        shelf_rows = max(1, min(SHELF, COMPONENTS // index.dim, max(LEAST_SHELF, n * -(-asked.count() // block_rows) // tasks)))
        on = cut(shelves(coded, shelf_rows), "shelves")
        chunk = F.pmod(F.xxhash64(F.lit("chunk"), "v"), F.col("chunks")).cast("int")
        shelved = coded.join(F.broadcast(on.select("list", "chunks").distinct()), "list").withColumn("chunk", chunk).drop("chunks")
        shelved = shelved.join(F.broadcast(on.drop("chunks")), ["list", "chunk"]).select("shelf", "list", "v", "ids", "code")
        put = on.select("list", "shelf").distinct().collect()
        member = np.zeros((len(index.coarse), 1 + max(r["shelf"] for r in put)), np.float32)
        for r in put:
            member[r["list"], r["shelf"]] = 1
        radius = np.zeros(len(index.coarse))
        for r in coded.groupBy("list").agg(F.max("off").alias("off")).collect():  # a row for each list at most
            radius[r["list"]] = r["off"]
        places = spark.sparkContext.broadcast((member, radius))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each query and shelf that it needs, with what a list (or an entry) there has to reach: that of the nearest lists, or the least score wanted."""
            ix, (of, wide) = shared.value, places.value
            for b in batches:
                if b.num_rows:
                    few, e = ix.ask(vectors_of(b.column(1).to_pylist(), kind))
                    bar = ix.scaled(b.column(2).to_numpy(), e) if b.num_columns == 3 else ix.nearest_lists(few, s.probes)
                    needed = ix.wanted(few, bar, wide if b.num_columns == 3 else 0 * wide).astype(np.float32) @ of > 0
                    ids, v, bar = b.column(0), b.column(1), pa.array(bar)
                    for shelf in np.flatnonzero(needed.any(0)).tolist():
                        k = pa.array(np.flatnonzero(needed[:, shelf]))
                        yield pa.RecordBatch.from_arrays([ids.take(k), v.take(k), bar.take(k), pa.array(np.full(len(k), shelf, np.int32))], ["query_id", "v", "bar", "shelf"])

        def meeting(ask: DataFrame, columns: list[str], task, out: str) -> DataFrame:
            """What ``task`` makes of each shelf's entries and the queries that look at them, block by block."""
            sent = ask.mapInArrow(probe, "query_id long, v binary, bar double, shelf int")
            blocks = small(sent.groupBy("shelf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "blocks")
            block = F.pmod(F.xxhash64(F.lit("block"), "query_id", "v"), F.col("blocks")).cast("int")
            left = shelved.select("shelf", *columns).join(blocks, "shelf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            right = sent.join(blocks, "shelf").withColumn("block", block).drop("blocks")
            # some partitions for each cell, so that few have several
            parts = 4 * max(tasks, blocks.agg(F.coalesce(F.sum("blocks"), F.lit(1))).first()[0])
            left, right = (d.repartition(parts, "shelf", "block").groupBy("shelf", "block") for d in (left, right))
            return left.cogroup(right).applyInPandas(task, out)

        def choose(key, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            """The largest exact products of each query among the best codes of a shelf."""
            found = []
            if len(own) and len(ask):
                for best in Cell(shared.value, own, ask, kind, 0 * places.value[1]).chosen(s.rerank, top):
                    found += [x[x > -np.inf] for x in best]
            return pd.DataFrame({"query_id": ask.query_id if found else [], "best": found})

        best = meeting(asked, ["list", "v", "ids", "code"], choose, "query_id long, best array<double>").groupBy("query_id").agg(F.flatten(F.collect_list("best")).alias("best"))
        least = F.element_at(F.slice(F.sort_array("best", False), top, 1), 1)
        worst = cut(best.where(F.size("best") >= top).select("query_id", least.alias("least")), "worst")

        def check(key, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            """All results of a shelf that may reach the least score of a query, its top ones at most."""
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(own) and len(ask):
                cell = Cell(shared.value, own, ask, kind, places.value[1])
                for r, c, exact in cell.reaching():
                    ids = cell.own.ids.to_numpy()[c]
                    n = np.array([len(i) for i in ids], np.int64)
                    asker, score = np.repeat(cell.who[r], n), np.repeat(exact, n)
                    one = np.concatenate([np.zeros(0, np.int64), *ids])
                    other = one != asker
                    asker, one, score = asker[other], one[other], score[other]
                    order = np.lexsort((one, -score, asker))
                    asker, one, score = asker[order], one[order], score[order]
                    few = np.arange(len(asker)) - np.searchsorted(asker, asker) < top
                    found.append((asker[few], one[few], score[few]))
            a, b, c = (np.concatenate(z) for z in zip(*found, strict=True))
            return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

        again = asked.join(worst, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        pairs = meeting(again.select("query_id", "v", "least"), ["list", "v", "ids"], check, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        self.result = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
