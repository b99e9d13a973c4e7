"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors of a label are dealt over shards of bounded size, each with a graph of its own; every vector
queries every shard of its label.  A search keeps a beam of the best vectors seen; a query whose whole
beam is linked asks again with a wider one.  An audit compares some queries of each shard with brute
force: beams are widened until it finds all their links and nearly all their nearest neighbours (so that
it says something where there are no links).  Hits are verified in double precision, counted, and united
to components.

Tasks give a spanning forest and numbers of links, never all pairs.  An exact check follows: linked
vectors are always in one component, and those of a component up to a documented size are counted once
more within it, in cells of bounded size; larger components keep the counts of the verified hits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import usable
from .shared import components, cut, hot_join, spanning, with_least

COSINE = 0.98
#: Vectors of a graph at most; queries of a task.
SHARD_ROWS, BLOCK_ROWS = 8000, 8000
#: Shards of a label that has more vectors than PAIR_ROWS, at least.
LEAST_SHARDS, PAIR_ROWS = 2, 256
#: Neighbours that a node chooses and that choose it; beams for building and asking; queries audited.
DEGREE, BACK, BUILD_BEAM, BEAM, AUDIT = 12, 12, 40, 40, 256
#: Nearest neighbours that an audit looks for, and the part of them that it must find.
NEAREST, REACH = 4, 0.9
BATCH = 256


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.x = x.astype(np.float32)
        n = len(x)
        level = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE), 6).astype(int) if n else np.zeros(0, int)
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(int(level.max()) if n else -1, -1, -1):
            nodes = np.flatnonzero(level >= k)
            self.layers.insert(0, self._layer(nodes))

    def _layer(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Insert in batches that grow with the layer; a batch looks at the graph so far and at itself.

        A node chooses its neighbours once, spread over directions; of the nodes that choose it, the
        nearest are its neighbours too.
        """
        place = np.full(len(self.x), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        near = np.full((len(nodes), DEGREE + BACK), -1, np.int64)
        back = np.full((len(nodes), BACK), -np.inf, np.float32)
        v = self.x[nodes]
        at = 0
        while at < len(nodes):
            end = min(len(nodes), at + min(BATCH, max(16, at // 4)))
            new = np.arange(at, end)
            own = v[new] @ v[new].T
            np.fill_diagonal(own, -np.inf)
            k = min(BUILD_BEAM, len(new))
            pick = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids, sims = new[pick], np.take_along_axis(own, pick, 1)
            if at:
                got, score = beam_search(v, near, v[new], self._descend(v[new], place, at), BUILD_BEAM)
                ids, sims = np.concatenate([ids, got], 1), np.concatenate([sims, score], 1)
            near[new, :DEGREE], chosen = diverse(v, np.where(np.isfinite(sims), ids, -1), sims, DEGREE)
            self._back(near, back, new, chosen)
            at = end
        return nodes, place, near

    def _descend(self, q: np.ndarray, place: np.ndarray, limit: int) -> np.ndarray:
        """Entry nodes in the layer being built: the upper layers' best that is there already, else its first."""
        if not self.layers:
            return np.zeros(len(q), np.int64)
        got = self.entry(q, 0)
        at = place[got]
        return np.where((at >= 0) & (at < limit), at, 0)

    def _back(self, near: np.ndarray, back: np.ndarray, new: np.ndarray, sims: np.ndarray) -> None:
        """Tell the chosen neighbours of the new nodes; each keeps the nearest that chose it."""
        dst, src, sim = near[new, :DEGREE].ravel(), np.repeat(new, DEGREE), sims.ravel()
        ok = dst >= 0
        dst, src, sim = dst[ok], src[ok], sim[ok]
        order = np.lexsort((-sim, dst))
        dst, src, sim = dst[order], src[order], sim[order]
        to, begin = np.unique(dst, return_index=True)
        rank = np.arange(len(dst)) - np.repeat(begin, np.diff(np.append(begin, len(dst))))
        few = rank < BACK
        row = np.searchsorted(to, dst[few])
        ids, val = np.full((len(to), 2 * BACK), -1, np.int64), np.full((len(to), 2 * BACK), -np.inf, np.float32)
        ids[:, :BACK], val[:, :BACK] = near[to, DEGREE:], back[to]
        ids[row, BACK + rank[few]], val[row, BACK + rank[few]] = src[few], sim[few]
        order = np.argsort(-val, axis=1, kind="stable")[:, :BACK]
        near[to, DEGREE:], back[to] = np.take_along_axis(ids, order, 1), np.take_along_axis(val, order, 1)

    def entry(self, q: np.ndarray, down_to: int = 1) -> np.ndarray:
        """The best node on the layer above ``down_to``, by greedy descent from the top."""
        best = np.full(len(q), self.layers[-1][0][0])
        for nodes, place, near in reversed(self.layers[down_to:]):
            got, _ = beam_search(self.x[nodes], near, q, np.maximum(place[best], 0), 1)
            best = nodes[got[:, 0]]
        return best

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` nodes for each query and their cosines, best first; -1 and -inf where fewer."""
        q = q.astype(np.float32)
        _, place, near = self.layers[0]
        return beam_search(self.x, near, q, place[self.entry(q)] if len(self.layers) > 1 else np.zeros(len(q), np.int64), beam)


def beam_search(v: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once; each step opens the best unopened nodes of each beam."""
    n, rows = len(q), np.arange(len(q))
    many = max(1, min(64, beam // 12))
    width = beam + many * near.shape[1]
    ids, sims, opened = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32), np.ones((n, width), bool)
    ids[:, 0], sims[:, 0], opened[:, 0] = start, np.einsum("qd,qd->q", q, v[start]), False
    seen = np.full((n, len(v)), -1, np.int32)
    seen[rows, start] = 0
    live = rows
    while len(live):
        key = np.where(opened[live, :beam], -np.inf, sims[live, :beam])
        pick = np.argpartition(-key, min(many, beam) - 1, axis=1)[:, :many] if beam > many else np.broadcast_to(np.arange(beam), (len(live), beam))
        has = np.take_along_axis(key, pick, 1) > -np.inf
        on = has.any(1)
        live, pick, has = live[on], pick[on], has[on]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        node = np.where(has, ids[live[:, None], pick], 0)
        cand = np.where(has[:, :, None], near[node], -1).reshape(len(live), -1)
        r, c = np.nonzero(cand >= 0)
        to = cand[r, c]
        fresh = seen[live[r], to] < 0
        r, to = r[fresh], to[fresh]
        stamp = np.arange(1, len(r) + 1, dtype=np.int32)
        seen[live[r], to] = stamp
        first = seen[live[r], to] == stamp
        r, to = r[first], to[first]
        if len(r):
            s = np.einsum("kd,kd->k", q[live[r]], v[to])
            slot = beam + np.arange(len(r)) - np.searchsorted(r, r)
            l2 = live[r]
            ids[l2, slot], sims[l2, slot], opened[l2, slot] = to, s, False
            hit = np.unique(r)
            rows_hit = live[hit]
            order = np.argsort(-sims[rows_hit], axis=1, kind="stable")
            for arr in (ids, sims, opened):
                arr[rows_hit] = np.take_along_axis(arr[rows_hit], order, 1)
            ids[rows_hit, beam:], sims[rows_hit, beam:], opened[rows_hit, beam:] = -1, -np.inf, True
    return ids[:, :beam], sims[:, :beam]


def diverse(v: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``degree`` neighbours and their cosines: nearest first, each nearer to the node than to
    those taken before; free places go to the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * degree]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    valid = (ids >= 0) & np.isfinite(sims)
    x = v[np.maximum(ids, 0)]
    among = np.matmul(x, x.transpose(0, 2, 1))
    taken, blocked = np.zeros(ids.shape, bool), np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        take = valid[:, k] & ~blocked[:, k] & (taken.sum(1) < degree)
        taken[:, k] = take
        blocked |= take[:, None] & (among[:, k] > sims)
    want = np.where(taken, 0, np.where(valid, 1, 2))
    final = np.argsort(want, axis=1, kind="stable")[:, :degree]
    ok = np.take_along_axis(want, final, 1) < 2
    gap = ((0, 0), (0, degree - final.shape[1]))
    out, score = np.where(ok, np.take_along_axis(ids, final, 1), -1), np.where(ok, np.take_along_axis(sims, final, 1), -np.inf)
    return np.pad(out, gap, constant_values=-1), np.pad(score, gap, constant_values=-np.inf)


def hits(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of verified links; queries whose whole beam is linked ask again with a wider one."""
    todo, out = np.arange(len(q)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(todo):
        full = []
        for at in range(0, len(todo), BATCH):
            part = todo[at : at + BATCH]
            ids, sims = graph.search(q[part], beam)
            near = sims >= np.float32(cosine - 1e-5)
            again = near.all(1) & (beam < len(x))
            r, c = np.nonzero(near & ~again[:, None])
            out.append((part[r], ids[r, c]))
            full.append(part[again])
        todo, beam = np.concatenate(full), min(4 * beam, len(x))
    i, j = (np.concatenate(o) for o in zip(*out, strict=True))
    exact = np.concatenate([np.zeros(0, bool), *(np.einsum("kd,kd->k", q[i[k : k + 100_000]], x[j[k : k + 100_000]]) >= cosine for k in range(0, len(i), 100_000))])
    return i[exact], j[exact]


AUDITED = "beam int, links int, links_found int, nearest int, nearest_found int"


def links_to(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, names: tuple[np.ndarray, np.ndarray], times: np.ndarray, known: tuple[np.ndarray, np.ndarray], seed: int = 9) -> tuple:
    """Links between queries and the graph's vectors: a spanning forest of them and those ``known``, how many
    rows (``times`` of each vector) every query is linked to, and what the audit found.

    ``names`` are the node numbers of queries and vectors; a vector is no link of its own.  A sample of
    queries is compared with brute force; beams are doubled while a linked pair is missing or too few of
    the nearest neighbours are found.
    """
    beam, pick = min(BEAM, len(x)), np.random.default_rng(seed).permutation(len(q))[:AUDIT]
    s = q[pick] @ x.T
    s[names[0][pick][:, None] == names[1]] = -np.inf
    truth = {(pick[i], j) for i, j in zip(*np.nonzero(s >= cosine), strict=True)}
    few = min(NEAREST, len(x) - 1)
    best = np.argpartition(-s, few - 1, axis=1)[:, :few] if few else np.zeros((len(pick), 0), np.int64)
    while True:
        i, j = hits(graph, x, q, cosine, beam)
        other = names[0][i] != names[1][j]
        i, j = i[other], j[other]
        looked = np.isin(i, pick)
        seen = len(truth & set(zip(i[looked].tolist(), j[looked].tolist(), strict=True)))
        got, _ = graph.search(q[pick], beam)
        near = int((best[:, :, None] == got[:, None, :]).any(2).sum())
        if beam >= len(x) or seen == len(truth) and near >= REACH * best.size:
            break
        beam = min(2 * beam, len(x))
    a, b = spanning(np.concatenate([known[0], names[0][i]]), np.concatenate([known[1], names[1][j]]))
    return a, b, np.bincount(i, times[j], len(q)).astype(np.int64), (beam, len(truth), seen, best.size, near)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing; vectors of different length don't either.  A row without an id links
    with nothing and isn't kept.  Equal vectors of a label are one node of a graph, which counts as
    many links as it has rows (rows that repeat an id are rows); other columns are ignored; an empty
    table gives no rows.
    """
    return Search(vectors, cosine, vec_id, embedding, label).result


class Search:
    """A search: its ``result``, and ``audits`` with what the audit of each (shard, block of queries) found."""

    def __init__(self, vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"):
        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
        good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v")
        rows = rows.select("vec_id", F.when(good, F.col("v")).alias("v"), F.when(good, F.struct("label", F.size("v").alias("dim"))).alias("group"))
        used = rows.where(F.col("group").isNotNull())
        nodes = used.groupBy("group", "v").agg(F.count("*").alias("times"), F.min("vec_id").alias("low"))
        nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        edges, hit = self._links(nodes, cosine)
        linked = nodes.join(components(edges).withColumnRenamed("node", "_node"), nodes.node == F.col("_node"), "left").drop("_node")
        linked = cut(linked.withColumn("root", F.coalesce("root", "node")), "linked")
        counted = hit.groupBy("node").agg(F.sum("n").alias("n"))
        named = with_least(linked.select("group", "v", "times", "low", "node", "root"), "root", "low", "node").join(counted, "node", "left")
        named = cut(named.select(F.col("group").alias("_group"), F.col("v").alias("_v"), "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.col("least").alias("component_id")), "named")
        part = hot_join(used, named, [("group", "_group"), ("v", "_v")], "times").select("vec_id", "n_links", "component_id")
        lone = rows.where(F.col("group").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        self.result = part.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

    def _links(self, nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
        """Edges ``a, b`` that span the links, and ``node, n`` rows whose sums are numbers of linked rows."""
        shards = F.greatest(F.ceil(F.count("*") / SHARD_ROWS), F.when(F.count("*") > PAIR_ROWS, LEAST_SHARDS).otherwise(1))
        per = nodes.groupBy("group").agg(shards.cast("int").alias("shards"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        shard, block = (F.pmod(F.xxhash64(F.lit(k), "node"), F.col(f"{k}s")).cast("int").alias(k) for k in ("shard", "block"))
        dealt = cut(nodes.join(per, "group").select("*", shard, block), "dealt")
        found = f"a array<long>, b array<long>, nodes array<long>, n array<long>, {AUDITED}"
        kind, columns = dealt.schema["group"].dataType.simpleString(), [c.split()[0] for c in found.split(", ")]

        def row(got: tuple, node: np.ndarray) -> dict:
            a, b, n, audit = got
            some = n > 0
            return dict(zip(columns, ([a], [b], [node[some]], [n[some]], *([x] for x in audit)), strict=True))

        def build(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values("node")
            x, node, times = unit(np.stack(batch.v.to_numpy())), batch.node.to_numpy(), batch.times.to_numpy()
            graph, none = Graph(x), np.zeros(0, np.int64)
            one = batch.iloc[0]
            head = {"group": [one["group"]], "shard": [one["shard"]], "blocks": [one["blocks"]], "graph": [pickle.dumps((graph, x, node, times))]}
            return pd.DataFrame(head | row(links_to(graph, x, x, cosine, (node, node), times, (none, none)), node))

        graphs = dealt.select("group", "shard", "blocks", "node", "times", "v").groupBy("group", "shard").applyInPandas(build, f"group {kind}, shard int, blocks int, graph binary, {found}")
        graphs = cut(graphs, "graphs")
        trees = graphs.join(per.where("shards > 1").select(F.col("group").alias("_g")), F.col("group") == F.col("_g"), "left_semi")
        trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", "shard", "block", "graph", "a", "b")
        away = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("shard"))
        asks = dealt.where("shards > 1").withColumn("shard", F.explode(away)).select("group", "shard", "block", "node", "v")

        def ask(graph: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(graph) or not len(q):
                return pd.DataFrame({c: [] for c in columns})
            g, x, node, times = pickle.loads(graph["graph"].iloc[0])
            q = q.sort_values("node")
            own, known = q.node.to_numpy(), (np.asarray(graph[c].iloc[0], np.int64) for c in "ab")
            return pd.DataFrame(row(links_to(g, x, unit(np.stack(q.v.to_numpy())), cosine, (own, node), times, tuple(known)), own))

        cross = cut(trees.groupBy("group", "shard", "block").cogroup(asks.groupBy("group", "shard", "block")).applyInPandas(ask, found), "cross")
        every = graphs.select(*columns).unionByName(cross)
        self.audits = every.select(*columns[4:])
        pairs = lambda x, y: every.select(F.explode(F.arrays_zip(x, y)).alias("e")).select(f"e.{x}", f"e.{y}")
        return pairs("a", "b"), pairs("nodes", "n").withColumnRenamed("nodes", "node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by brute force in SQL, for the oracle.
SQL = """
with recursive e as (select vec_id, label, cast(embedding as double[]) v from embeddings),
g as (select *, sqrt(list_inner_product(v, v)) n from e
  where vec_id is not null and label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id a, b.vec_id b from g a join g b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where a.n > 0 and b.n > 0 and list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r as (select a as id, b as seen from p union select r.id, p.b from r join p on r.seen = p.a),
c as (select id, min(seen) low from r group by id),
k as (select a as id, count(*) n from p group by a),
o as (select e.vec_id, cast(coalesce(k.n, 0) as bigint) n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) component_id
  from e left join k on e.vec_id = k.id left join c on e.vec_id = c.id)
select *, coalesce(vec_id = component_id, false) kept from o
"""
