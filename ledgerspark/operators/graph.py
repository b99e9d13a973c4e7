"""Reachability over session edges, which may be cyclic."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Edges that are sent to every task; more are followed by joins.
SENT_EDGES = 500_000


def reach(edges: DataFrame, roots: DataFrame, most: int = SENT_EDGES) -> DataFrame:
    """``root, node``: each root and everything below it, once.

    ``edges`` has ``parent_id, child_id``; ``roots`` has ``root``.  Up to ``most`` edges go to all tasks, and
    each follows them for its own roots in one pass.  Beyond that the edges are written once, and the
    frontier is joined with them until nothing new comes; each step is a table.
    """
    links = edges.select(F.col("parent_id").alias("_from"), F.col("child_id").alias("_to")).where("_from is not null and _to is not null")
    start = roots.select("root").where("root is not null").distinct()
    sent = links.limit(most + 1).toArrow() if most else None
    if sent is not None and sent.num_rows <= most:
        return _reach_sent(start, sent)
    links = materialize(links.distinct(), "links")
    known = [materialize(start.select("root", F.col("root").alias("node")), "reach")]
    while True:
        step = known[-1].join(links, F.col("node") == F.col("_from")).select("root", F.col("_to").alias("node")).distinct()
        for before in known:
            step = step.join(before, ["root", "node"], "left_anti")
        found = materialize(step, "frontier")
        if found.isEmpty():
            break
        known.append(found)
        if len(known) > 8:  # the tables before the frontier become one, so plans stay short
            known = [materialize(_union(known[:-1]), "reach"), known[-1]]
    return _union(known)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _reach_sent(roots: DataFrame, links: pa.Table) -> DataFrame:
    below: dict[str, list[str]] = {}
    for a, b in zip(links["_from"].to_pylist(), links["_to"].to_pylist(), strict=True):
        below.setdefault(a, []).append(b)
    shared = roots.sparkSession.sparkContext.broadcast(below)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in batch.column(0).to_pylist():
                seen, todo = {root}, [root]
                while todo:
                    new = [n for n in shared.value.get(todo.pop(), ()) if n not in seen]
                    seen.update(new)
                    todo += new
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(seen), pa.string()), pa.array(list(seen), pa.string())], ["root", "node"])

    return roots.mapInArrow(task, "root string, node string")


def ancestors(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session, ancestor``: strict ancestors, never the session itself."""
    turned = edges.select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))
    found = reach(turned, sessions.select(F.col("session").alias("root")))
    return found.where("root <> node").select(F.col("root").alias("session"), F.col("node").alias("ancestor"))


def related(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``session``: everything linked to the seeds in either direction."""
    return expand(components(edges), seeds)


def expand(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """``session``: the seeds and all that share a component with one, by labels ``(session, component)``."""
    own = seeds.select("session").where("session is not null").distinct()
    hit = labels.join(own, "session", "left_semi").select("component").distinct()
    return own.unionByName(labels.join(hit, "component", "left_semi").select("session")).distinct()


def merge_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``session, component`` rows that new edges change or add; labels that no edge touches stay as they are.

    Edges become edges between components, of which there are no more than new edges, and only components that
    these join are renamed.
    """
    links = edges.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")).where("a is not null and b is not null").distinct()
    known = lambda c: labels.select(F.col("session").alias(f"_{c}"), F.col("component").alias(f"_l{c}"))
    named = links.join(known("a"), F.col("a") == F.col("_a"), "left").join(known("b"), F.col("b") == F.col("_b"), "left")
    named = materialize(named.select("a", "b", F.coalesce("_la", "a").alias("la"), F.coalesce("_lb", "b").alias("lb"), F.col("_la").isNull().alias("new_a"), F.col("_lb").isNull().alias("new_b")), "named")
    joined = components(named.select(F.col("la").alias("parent_id"), F.col("lb").alias("child_id"))).select(F.col("session").alias("_old"), F.col("component").alias("_new"))
    moved = labels.join(joined, F.col("component") == F.col("_old")).where("_new <> component").select("session", F.col("_new").alias("component"))
    added = named.where("new_a").select(F.col("a").alias("session")).unionByName(named.where("new_b").select(F.col("b").alias("session"))).distinct()
    return moved.unionByName(added.join(joined, F.col("session") == F.col("_old")).select("session", F.col("_new").alias("component")))


def components(edges: DataFrame, most: int = SENT_EDGES) -> DataFrame:
    """``session, component``: the smallest session id linked in either direction.

    Up to ``most`` edges are joined in one place.  Beyond that labels fall to the smallest neighbour's and then
    follow their own label, so the number of rounds is logarithmic; every step is a join or a partial
    minimum, safe for hubs.
    """
    pairs = edges.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")).where("a is not null and b is not null")
    sent = pairs.limit(most + 1).toArrow() if most else None
    if sent is not None and sent.num_rows <= most:
        return _joined(edges.sparkSession, sent)
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    label = materialize(both.groupBy(F.col("a").alias("session")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "label")
    while True:
        near = both.join(label, both.b == label.session).select(F.col("a").alias("session"), "component")
        low = near.unionByName(label).groupBy("session").agg(F.min("component").alias("low"))
        up = label.select(F.col("session").alias("via"), F.col("component").alias("up"))
        new = materialize(low.join(up, low.low == up.via).select("session", F.least("low", "up").alias("component")), "label")
        if new.join(label.withColumnRenamed("component", "old"), "session").where("component <> old").isEmpty():
            return new
        label = new


def _joined(spark, links: pa.Table) -> DataFrame:
    up: dict[str, str] = {}

    def top(v: str) -> str:
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    names = list(up)
    return spark.createDataFrame(pa.table({"session": pa.array(names, pa.string()), "component": pa.array([top(v) for v in names], pa.string())}))
