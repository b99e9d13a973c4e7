"""Prefix tries of conversations by partition refinement.

All sequences start in one class, the root.  In each round the classes that hold several different
sequences are split by the next turn; every part is a node.  A part with one sequence left is retired: the
rest of it is a chain of nodes with one child each, which is read off the turns at once.  At the end subtree
values are folded back, level by level, over the nodes that were split; chains come with theirs.

Equal sequences are found before by digests and are one sequence with a weight, so rounds go only as deep
as different sequences agree.  Turns are held as digests of role and text.  Splitting is a join and an
aggregate by (class, turn): what most sequences share is summed before it is shuffled.  The numbers of a
conversation's turns come from prefix sums over range partitions, and the ids that end at a node are hashed
in ascending order from pieces that sorted partitions make of them, so no conversation and no group of
copies of any size has to fit a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, parts, running_totals, words

#: Turns that a conversation takes from the first one of its block of so many ids.
BLOCK, BORROWED = 20, 4
#: Rows of a partition where turns are ordered; ids that one piece of a list holds; characters of a text that order equal turns.
ORDERED_ROWS, PIECE_IDS, HEAD = 50_000, 20_000, 64
#: Levels that are folded back in one plan.
FOLDS = 4


def digest(role: Column, text: Column) -> Column:
    """A digest of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, pos, h, words``: turns of each conversation numbered from 1, by turn (null first) and role, then
    by the first HEAD characters of the text and its digest, so that whole texts aren't sorted."""
    empty = F.lit("")
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.left("text", F.lit(HEAD)).alias("head"), digest(F.col("role"), F.col("text")).alias("h"), F.size(words(F.col("text"))).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    rows = cut(rows, "turns")
    n = parts(turns.sparkSession, rows.count(), ORDERED_ROWS)
    rows = running_totals(rows, None, "one", ["conv_id", "turn", "role", "head", "h"], "place", n).select("conv_id", "place", "h", "words")
    rows = cut(rows, "places")
    first = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.min("place").alias("_first"))
    return rows.join(first, rows.conv_id == F.col("_c")).select("conv_id", (F.col("place") - F.col("_first") + 1).alias("pos"), "h", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns where each conversation's first ones are those of the first conversation of its block, and all ids.

    ``crc32`` of the decimal id says how many; a conversation that is missing has none.
    """
    turns = cut(turns, "own")
    ids = cut(turns.select("conv_id").distinct().withColumn("take", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("long")), "ids")
    donor = F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK).cast("long"))
    heads = turns.where(F.col("pos") < BORROWED).select(F.col("conv_id").alias("_d"), "pos", "h", "words")
    lent = ids.withColumn("_from", donor).join(heads, (F.col("_from") == F.col("_d")) & (F.col("pos") <= F.col("take"))).select("conv_id", "pos", "h", "words")
    taken = lent.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("_lent"))
    kept = ids.join(taken, F.col("conv_id") == F.col("_c"), "left").select(F.col("conv_id").alias("_c"), "take", F.coalesce("_lent", F.lit(0)).alias("_lent"))
    own = turns.join(kept, F.col("conv_id") == F.col("_c")).where("pos > take").select("conv_id", (F.col("pos") - F.col("take") + F.col("_lent")).alias("pos"), "h", "words")
    return lent.unionByName(own), ids.select("conv_id")


def sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv_id, seq, len, total``: each conversation's sequence, named by the smallest id that has it, its turns and words."""
    marks = [F.bit_xor(F.conv(F.substring(F.sha2(F.concat(F.hex("h"), F.lit(":"), F.col("pos").cast("string")), 256), 1 + 15 * k, 15), 16, 10).cast("long")).alias(f"m{k}") for k in range(4)]
    per = turns.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("len"), F.sum("words").alias("total"), *marks)
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("len", "total", "m0", "m1", "m2", "m3")]
    own = cut(ids.join(per, F.col("conv_id") == F.col("_c"), "left").select("conv_id", *none), "digests")
    mark = ("len", "m0", "m1", "m2", "m3")
    names = own.groupBy(*(F.col(c).alias(f"_{c}") for c in mark)).agg(F.min("conv_id").alias("seq"))
    return cut(own.join(names, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in mark))).select("conv_id", "seq", "len", "total"), "sequences")


def id_hashes(members: DataFrame) -> DataFrame:
    """``seq, ends``: SHA-256 of each sequence's ids in ascending order, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        now, ids = None, []
        for b in batches:
            for seq, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (seq != now or len(ids) >= PIECE_IDS):
                    held.append((now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = seq
                ids.append(i)
            if held:
                yield table(held)
                held = []
        if ids:
            yield table([(now, ids[0], ",".join(map(str, ids)))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["seq", "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for b in batches:
            out = []
            for seq, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if seq != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["seq", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["seq", "ends"])

    rows = members.select("seq", "conv_id")
    n = parts(members.sparkSession, rows.count(), 4 * ORDERED_ROWS)
    made = rows.repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(pieces, "seq long, first long, piece string")
    return made.repartition(n, "seq").sortWithinPartitions("seq", "first").mapInArrow(hashes, "seq long, ends string")



def prefix_trie(turns: DataFrame, all_sequences: DataFrame) -> DataFrame:
    """A row for each node from ``(seq, pos, h, words)`` turns of distinct sequences and ``(conv_id, seq, len,
    total)`` of all conversations; see ``query`` for the columns."""
    spark = turns.sparkSession
    weights = all_sequences.groupBy("seq", "len", "total").agg(F.count("*").alias("m"))
    weights = cut(weights, "weights")
    n = parts(spark, turns.count(), ORDERED_ROWS)
    turns = cut(turns.repartitionByRange(n, "pos", "seq").sortWithinPartitions("pos", "seq"), "levels")  # a level is few row groups
    whole = weights.agg(F.min("seq").alias("low"), F.sum("m").alias("n")).first()
    if whole.low is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    inner, tops, depth = [], [], 0
    active = weights.select("seq", "len", "total", "m", F.lit(whole.low).alias("cls"))
    level = spark.createDataFrame([(whole.low, 0, None, whole.n, 0)], "conv_id long, depth long, parent_conv_id long, n_convs long, words long")
    while True:
        # what ends here names its node; the others go on by their next turn
        ended = active.where(F.col("len") == depth).select(F.col("cls").alias("_k"), F.col("seq").alias("ended"))
        inner.append(level.join(ended, F.col("conv_id") == F.col("_k"), "left").drop("_k"))
        depth += 1
        at = turns.where(F.col("pos") == depth).select(F.col("seq").alias("_q"), "h", "words")
        going = active.where(F.col("len") >= depth).join(at, F.col("seq") == F.col("_q")).drop("_q")
        split = going.groupBy(F.col("cls").alias("_cls"), F.col("h").alias("_h")).agg(F.min("seq").alias("low"), F.sum("m").alias("n"), F.count("*").alias("kinds"), F.first("words").alias("_words"))
        split = cut(split, "split")
        single = split.where("kinds = 1").select(F.col("low").alias("seq"), F.col("_cls").alias("parent"), F.lit(depth).cast("long").alias("top"))
        tops.append(single)
        level = split.where("kinds > 1").select(F.col("low").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("_cls").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("_words").alias("words"))
        if level.isEmpty():
            break
        going = going.join(split.where("kinds > 1").select("_cls", "_h", "low"), (F.col("cls") == F.col("_cls")) & (F.col("h") == F.col("_h")))
        active = cut(going.select("seq", "len", "total", "m", F.col("low").alias("cls")), "active")
    retired = cut(reduce(DataFrame.unionByName, tops).join(weights, "seq"), "retired")
    tail = chains(turns, retired)
    # values of subtrees, from the deepest split nodes up
    suffix = tail.groupBy(F.col("conv_id").alias("seq")).agg(F.sum("words").alias("below"))
    own = retired.join(suffix, "seq").select("top", "parent", (F.col("below") * (F.col("m") - 1)).alias("saved"), F.lit(1).cast("long").alias("leaves"))
    under = cut(own.groupBy("top", "parent").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.count("*").alias("children")), "under")
    folded, above = [], None
    for k in range(len(inner) - 1, -1, -1):
        children = under.where(F.col("top") == k + 1).select("parent", "saved", "leaves", "children")
        if above is not None:
            more = above.groupBy(F.col("parent_conv_id").alias("parent")).agg(F.sum("saved_tokens").alias("saved"), F.sum("n_leaves").alias("leaves"), F.count("*").alias("children"))
            children = children.unionByName(more).groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("saved", "leaves", "children")))
        nothing = F.lit(0).cast("long")
        above = inner[k].join(children, F.col("conv_id") == F.col("parent"), "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", nothing).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            (F.coalesce("saved", nothing) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), "ended")
        if k % FOLDS == 0:  # plans stay short, however deep the trie is
            above = cut(above, "folded")
        folded.append(above)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended"]
    nodes = reduce(DataFrame.unionByName, folded).select(*columns).unionByName(tail.select(*columns))
    # a sequence of one conversation hashes by itself; lists are made where several end
    shared = all_sequences.join(weights.where("m > 1").select("seq"), "seq", "left_semi")
    lists = cut(id_hashes(shared), "ends").select(F.col("seq").alias("_s"), "ends")
    alone = F.when(F.col("ended").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.sha2(F.col("ended").cast("string"), 256))
    return nodes.join(lists, F.col("ended") == F.col("_s"), "left").select(*columns[:-1], F.coalesce("ends", alone).alias("ends_sha256"))


def chains(turns: DataFrame, retired: DataFrame) -> DataFrame:
    """Nodes of the tails of retired sequences: one child each but the last."""
    tail = turns.join(retired.select(F.col("seq").alias("_q"), "top", "parent", "m", "len"), (F.col("seq") == F.col("_q")) & (F.col("pos") >= F.col("top")))
    tail = cut(tail.select("seq", "pos", "words", "top", "parent", "m", "len"), "tails")
    last = F.col("pos") == F.col("len")
    # words from each turn to the end; only sequences that several conversations have need them
    weighed = tail.where("m > 1").withColumn("back", -F.col("pos"))
    n = parts(turns.sparkSession, weighed.count(), ORDERED_ROWS)
    summed = running_totals(weighed, "seq", "words", ["back"], "after", n).select("seq", "pos", "words", "top", "parent", "m", "len", (F.col("after") + F.col("words")).alias("rest"))
    both = summed.unionByName(tail.where("m = 1").withColumn("rest", F.lit(0).cast("long")))
    return both.select(
        F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("m").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("m") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("seq")).alias("ended"), "words")


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", borrow: bool = False) -> DataFrame:
    """The prefix trie of all conversations: ``conv_id`` (a node's smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts count as empty; null turns come first, and turns with equal numbers are ordered by
    role and text (see ``numbered_turns``), repeated rows each by itself.  Rows without a conversation id are left out.
    With ``borrow`` conversations begin with turns of another (see ``rebuilt``).  Other columns are ignored;
    an empty table has no root and gives no rows.
    """
    rows = numbered_turns(turns, conv_id, turn, role, text)
    if borrow:
        rows, ids = rebuilt(rows)
        rows = cut(rows, "rebuilt")
    else:
        rows = cut(rows, "numbered")
        ids = rows.select("conv_id").distinct()
    every = sequences(rows, ids)
    kept = every.where("conv_id = seq").select("seq")
    return prefix_trie(rows.join(kept, F.col("conv_id") == F.col("seq")).select("seq", "pos", "h", "words"), every)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), borrow=True)


SQL = r"""
with ids as (
  select distinct conv_id as c,
    xor(list_reduce([4294967295] || list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 as h
  from conversations where conv_id is not null),
turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
built as (
  select i.c, 0 as own, t.pos, t.role, t.text from ids i join turns t on t.c = i.c - i.c % 20 and t.pos <= i.h
  union all select i.c, 1, t.pos, t.role, t.text from ids i join turns t on t.c = i.c and t.pos > i.h),
placed as (select c, role, text, row_number() over (partition by c order by own, pos) as d from built),
paths as (
  select c, d, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words,
    sha256(string_agg(len(role) || ':' || len(text) || ':' || role || text, '') over (partition by c order by d)) as p
  from placed
  union all select c, 0, 0, '' from ids),
lens as (select c, max(d) as len from paths group by c),
nodes as (select d, p, min(c) as c, count(*) as n, any_value(words) as words from paths group by d, p),
member as (select p.c, p.d, n.c as node, n.n, n.words from paths p join nodes n on n.d = p.d and n.p = p.p),
linked as (select n.c, n.d, n.n, n.words, m.node as parent from nodes n left join member m on m.c = n.c and m.d = n.d - 1),
kids as (select parent, d - 1 as d, count(*) as k from linked where parent is not null group by all),
full_ as (select l.*, coalesce(k.k, 0) as k from linked l left join kids k on k.parent = l.c and k.d = l.d),
under as (
  select m.node as c, m.d, sum((f.n - 1) * f.words) as saved, count(*) filter (f.k = 0) as leaves
  from full_ f join member m on m.c = f.c and m.d <= f.d group by m.node, m.d),
ends as (select m.node as c, m.d, string_agg(cast(m.c as varchar), ',' order by m.c) as ids from member m join lens l on l.c = m.c and l.len = m.d group by all)
select cast(f.c as bigint) as conv_id, cast(f.d as bigint) as depth, cast(f.parent as bigint) as parent_conv_id, cast(f.n as bigint) as n_convs, cast(f.k as bigint) as n_children,
  cast(u.leaves as bigint) as n_leaves, cast(u.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_ f join under u on u.c = f.c and u.d = f.d left join ends e on e.c = f.c and e.d = f.d
"""
