"""Ordered overlap of copies of a counter.

Two histories of one session are laid over each other by the blocks that both have in the same order: the
longest common block first (the earliest of several), then what lies left and right of it.  Copies of which one
is the other, shifted by at most a row, are told by their places, also where marks repeat (``shifts``).  Marks that occur
once in each history, in the same order in both, need no search: their blocks are the runs of one diagonal, found
by a join and running values (``lay_over``).  Anything else is searched with a suffix automaton
(``matching_blocks``), which finds a longest common block in time proportional to both lengths, however
often marks repeat.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Running, Scan
from .storage import materialize


class Automaton:
    """Suffix automaton of a sequence: every block of it is a path from the start."""

    def __init__(self, items: Sequence[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, x in enumerate(items):
            new = self._state(self.length[last] + 1, at)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][x]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(self.length[p] + 1, self.end[q])  # the first end of the longer block is its own
                    self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, length: int, end: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, items: Sequence[int]) -> tuple[int, int, int]:
        """(start in ``items``, start in the automaton's sequence, size) of the longest common block: of
        several the one that starts first in ``items``, then in the sequence."""
        best, state, size = (0, 0, 0), 0, 0
        for at, x in enumerate(items):
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state, size = self.next[state][x], size + 1
            if size > best[2]:
                best = (at - size + 1, self.end[state] - size + 1, size)
        return best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """Blocks ``(start in a, start in b, size)`` in order; neighbours on both sides are one block."""
    names: dict[Hashable, int] = {}
    x, y = ([names.setdefault(m, len(names)) for m in side] for side in (a, b))
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        i, j, size = Automaton(y[b0:b1]).longest(x[a0:a1])
        if size:
            i, j = a0 + i, b0 + j
            found.append((i, j, size))
            todo += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return out


def shifts(placed: DataFrame, segmented: bool = False) -> DataFrame:
    """``_s, _shift, _ours``: sessions whose copies agree wherever they overlap if the other one is moved by ``_shift``
    rows (at most one), and rows of the main copy.

    That overlap is the longest common block, as it is longer than all that any other shift has in common (beyond one
    row: could have), and nothing lies left or right of it in both copies.
    """
    mark = lambda main: F.max(F.when(F.col("is_main") == main, F.col("mark")))
    cells = placed.groupBy("session_id", "at").agg(mark(True).alias("m"), mark(False).alias("o"))
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("mark")))
    cells = Scan(cells, ("session_id",), ("at",), segmented).add(om=Running("last", known("m"), "before"), oo=Running("last", known("o"), "before")).rows
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    last = lambda c: F.when(F.col(c)["at"] == F.col("at") - 1, F.col(c)["mark"])
    found = cells.groupBy(F.col("session_id").alias("_s")).agg(
        F.count("m").alias("a"), F.count("o").alias("b"), count(F.col("m") == F.col("o")).alias("n0"), count(F.col("m") == last("oo")).alias("n1"), count(F.col("o") == last("om")).alias("n2"))
    a, b = F.col("a"), F.col("b")
    room = {0: F.least(a, b), 1: F.least(a - 1, b), -1: F.least(a, b - 1)}
    beyond = F.greatest(F.least(a - 2, b), F.least(a, b - 2))
    seen = {0: F.col("n0"), 1: F.col("n1"), -1: F.col("n2")}
    whole = lambda k: reduce(and_, [seen[k] == room[k], room[k] > 1, beyond < room[k], *(seen[x] < room[k] for x in seen if x != k)])
    shift = F.when(whole(0), 0).when(whole(1), 1).when(whole(-1), -1)
    return found.select("_s", shift.alias("_shift"), a.alias("_ours")).where("_shift is not null")


def lay_over(counters: DataFrame, segmented: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions with two copies of a counter: ``(one stream, ambiguous rows, sessions that need a search)``.

    ``counters`` has ``row`` (no two share it), ``session_id, generation_id, ordinal, record_id, timestamp, turn_id,
    superseded, mark, refs`` and the place of a record's bytes.  The main copy is the one that isn't superseded, then the longer, then
    the newer; rows of the other that it has too only add their references, rows before or after all its time
    are added, the rest is ambiguous.
    """
    size = counters.groupBy("session_id", "generation_id").agg(F.count("*").alias("n"), F.min_by(F.struct("superseded", "record_id"), F.struct("ordinal", "record_id")).alias("head"), F.min(F.nullif("timestamp", F.lit(""))).alias("low"), F.max(F.nullif("timestamp", F.lit(""))).alias("high"))
    rank = F.struct((F.coalesce("head.superseded", F.lit(0)) == 0).cast("int"), "n", "head.record_id")
    main = size.groupBy(F.col("session_id").alias("_s")).agg(F.max_by(F.struct("generation_id", "low", "high"), rank).alias("_main"))
    placed = Scan(counters, ("session_id", "generation_id"), ("ordinal", "record_id"), segmented).add(at=Running("sum", F.lit(1).cast("long"))).rows
    placed = placed.join(main, F.col("session_id").eqNullSafe(F.col("_s"))).withColumn("is_main", F.col("generation_id").eqNullSafe(F.col("_main.generation_id"))).drop("_s")
    placed = materialize(placed, "placed")
    drop = ("at", "_main", "is_main")
    outside = F.coalesce((F.col("timestamp") != "") & ((F.col("timestamp") < F.col("_main.low")) | (F.col("timestamp") > F.col("_main.high"))), F.lit(False))
    shifted = materialize(shifts(placed, segmented), "shifts")
    moved = placed.join(shifted, F.col("session_id").eqNullSafe(F.col("_s"))).withColumn("place", F.col("at") + F.when(F.col("is_main"), 0).otherwise(F.col("_shift")))
    more = moved.where("not is_main").select(F.col("session_id").alias("_t"), F.col("place").alias("_place"), F.col("refs").alias("more"))
    stream = moved.where("is_main").join(more, F.col("session_id").eqNullSafe(F.col("_t")) & (F.col("place") == F.col("_place")), "left").drop("_t", "_place")
    stream = stream.withColumn("refs", F.concat("refs", F.coalesce("more", F.array().cast("array<bigint>")))).drop("more")
    rest = moved.where(~F.col("is_main") & ~F.col("place").between(1, F.col("_ours")))
    gone = (*drop, "_s", "_shift", "_ours", "place")
    stream, ambiguous = stream.unionByName(rest.where(outside)).drop(*gone), rest.where(~outside).drop(*gone)
    placed = placed.join(shifted, F.col("session_id").eqNullSafe(F.col("_s")), "left_anti")
    if placed.isEmpty():
        return stream, ambiguous, placed.select("session_id")
    often = placed.groupBy("session_id", "generation_id", "mark").count().where("count > 1").select("session_id")
    same = ("source_id", "digest", "byte_start")
    ours = placed.where("is_main").select(F.col("session_id").alias("_s"), F.col("mark").alias("_m"), F.col("at").alias("i"), *(F.col(c).alias(f"_{c}") for c in same), F.col("row").alias("to"))
    theirs = placed.where("not is_main")
    both = theirs.join(ours, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("mark") == F.col("_m"))).withColumn("bytes", F.col("source_id").isNotNull() & F.col("source_id").eqNullSafe(F.col("_source_id")) & F.col("digest").eqNullSafe(F.col("_digest")) & F.col("byte_start").eqNullSafe(F.col("_byte_start")))
    pairs = both.select("session_id", "i", F.col("at").alias("j"), "to", "row", "turn_id", "refs", "bytes")
    # a run ends where the diagonal changes or a row is left out on either side
    run = Scan(pairs, ("session_id",), ("i", "j"), segmented).add(before=Running("last", F.struct("i", "j"), "before"))
    run = run.map(lambda r: r.withColumn("crosses", F.coalesce(F.col("j") <= F.col("before.j"), F.lit(False))).withColumn("begins", F.when(F.coalesce((F.col("i") - F.col("before.i") == 1) & (F.col("j") - F.col("before.j") == 1), F.lit(False)), 0).otherwise(1).cast("long")))
    runs = materialize(run.add(run=Running("sum", F.col("begins"))).rows, "runs")
    search = materialize(often.unionByName(runs.where("crosses").select("session_id")).distinct(), "search")
    clear = lambda df: df.join(search.select(F.col("session_id").alias("_x")), F.col("session_id").eqNullSafe(F.col("_x")), "left_anti")
    sizes = runs.groupBy(F.col("session_id").alias("_rs"), F.col("run").alias("_run")).agg(F.count("*").alias("size"))
    kept = clear(runs).join(sizes, F.col("session_id").eqNullSafe(F.col("_rs")) & (F.col("run") == F.col("_run"))).where((F.col("size") > 1) | F.coalesce(F.col("turn_id") != "", F.lit(False)) | F.col("bytes"))
    kept = materialize(kept.select("to", "row", F.col("refs").alias("more")), "paired")
    gained = kept.select(F.col("to").alias("_to"), "more")
    found = clear(placed.where("is_main")).join(gained, F.col("row") == F.col("_to"), "left").withColumn("refs", F.concat("refs", F.coalesce("more", F.array().cast("array<bigint>")))).drop("_to", "more")
    rest = clear(placed.where("not is_main")).join(kept.select(F.col("row").alias("_r")), F.col("row") == F.col("_r"), "left_anti")
    return stream.unionByName(found.unionByName(rest.where(outside)).drop(*drop)), ambiguous.unionByName(rest.where(~outside).drop(*drop)), search
