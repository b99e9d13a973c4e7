"""Chat formatting of reply trees.

Replies point to their parents.  Self-joins double every pointer until it passes the root, so a path
of n replies takes log2(n) rounds; on the way each reply learns its depth, its path's score and where
its text starts in the formatted path.  Leaves are ranked by score in each tree, the chosen leaves'
ancestors are listed by the same jumps, and each path becomes one conversation.

A turn is written as ``<|role|>text<|end|>`` and a line feed.  In roles and texts a backslash is
doubled, and a backslash goes behind the first character of every control string, so no text can end
a turn and every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, parts, running_totals

#: Control strings of this template and of common ones.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
END = "<|end|>\n"
#: Roles whose texts are learned.
LEARNED = "assistant"
#: Turns of a path that are joined before the path is.
RUN = 256


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith("<|", at):
            raise ValueError("a turn doesn't start with a mark")
        bar, end = text.index("|>", at + 2), text.index(END, at)
        turns.append((unescape(text[at + 2 : bar]), unescape(text[bar + 2 : end])))
        at = end + len(END)
    return turns


def climb(nodes: DataFrame, sums: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """``node, top, <sums over the path from the root>`` of ``(node, parent, <values>)`` rows, and the
    jump tables ``(node, up)`` over 1, 2, 4, ... replies.

    A parent that isn't there makes a root.  Replies on a cycle, or below one, have no root and are
    left out.
    """
    there = nodes.select(F.col("node").alias("_p"))
    state = cut(nodes.join(there, nodes.parent == F.col("_p"), "left").select("node", F.col("_p").alias("up"), F.coalesce("_p", "node").alias("top"), *sums), "climb")
    done, jumps, most = state.where("up is null"), [], nodes.count().bit_length() + 1
    moving = state.where("up is not null")
    while moving.limit(1).count() and len(jumps) < most:
        jumps.append(moving.select("node", "up"))
        # only replies that aren't at their root yet move on; those that are were written before
        above = done.unionByName(moving).select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("top").alias("_t"), *[F.col(s).alias(f"_{s}") for s in sums])
        step = moving.join(above, moving.up == above._n).select("node", F.col("_u").alias("up"), F.col("_t").alias("top"), *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])
        step = cut(step, "climb")
        done, moving = done.unionByName(step.where("up is null")), step.where("up is not null")
    return done.drop("up"), jumps


def paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``leaf, node`` for each leaf and all its ancestors.

    Every distance is a sum of different powers of two, so each jump table is joined once.
    """
    found = leaves.select("leaf", F.col("leaf").alias("node"))
    for jump in reversed(jumps):
        j = jump.select(F.col("node").alias("_n"), "up")
        found = cut(found.unionByName(found.join(j, found.node == j._n).select("leaf", F.col("up").alias("node"))), "paths")
    return found


def format_trees(replies: DataFrame, branches: int = 1) -> DataFrame:
    """``leaf, formatted, loss, depth, score`` of the ``branches`` best paths of every tree.

    ``replies`` has ``node`` (unique long), ``parent`` (null: a root), ``role``, ``text`` and ``score``
    (a path's score is the sum).  Null roles and texts count as empty, null scores as 0; ties go to the
    smaller leaf.  ``loss`` lists the spans (start, end in code points) of learned texts.  The table is
    in the shared folder.
    """
    empty = F.lit("")
    rows = replies.select("node", "parent", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.withColumn("mark", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("piece", F.concat("mark", "body", F.lit(END)))
    rows = cut(rows.select("node", "parent", "score", "piece", F.lit(1).cast("long").alias("depth"), F.char_length("piece").cast("long").alias("chars"), F.char_length("mark").alias("lead"), F.char_length("body").alias("own"), (F.col("role") == LEARNED).alias("learn")), "replies")
    state, jumps = climb(rows.select("node", "parent", "depth", "score", "chars"), ["depth", "score", "chars"])
    has = rows.where("parent is not null").select(F.col("parent").alias("_p")).distinct()
    leaves = state.join(has, state.node == has._p, "left_anti")
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.desc("score"), "node"))
    leaves = leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select(F.col("node").alias("leaf"), F.col("depth").alias("turns"), F.col("score").alias("total"), "rank")
    leaves = cut(leaves, "leaves")
    listed = paths(leaves, jumps)
    ends = state.select(F.col("node").alias("_n"), F.col("depth").alias("_depth"), F.col("chars").alias("_end"))
    text = rows.select(F.col("node").alias("_m"), "piece", "chars", "lead", "own", "learn")
    each = listed.join(ends, listed.node == ends._n).join(text, listed.node == text._m)
    begin = F.col("_end") - F.col("chars") + F.col("lead")
    span = F.when(F.col("learn"), F.struct(begin.alias("start"), (begin + F.col("own")).alias("end")))
    joined = lambda order, part: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda s: s[part]), "")
    runs = each.withColumn("span", span).groupBy("leaf", F.floor(F.col("_depth") / RUN).alias("run")).agg(joined("_depth", "piece").alias("piece"), F.array_sort(F.array_compact(F.collect_list("span"))).alias("spans"))
    whole = runs.groupBy("leaf").agg(joined("run", "piece").alias("formatted"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("loss"))
    return cut(whole.join(leaves, "leaf").select("leaf", "formatted", "loss", F.col("turns").alias("depth"), F.col("total").alias("score")), "chat")


def chains(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Replies of plain conversations: each turn answers the one before.

    Turns with equal numbers are ordered by role and text; null numbers come first; rows with a null
    conversation id are one conversation.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"))
    rows = cut(rows, "turns")
    n = parts(turns.sparkSession, rows.count(), 50_000)
    rows = cut(running_totals(rows, None, "one", ["conv_id", "turn", "role", "text"], "node", n).drop("one"), "numbered")
    first = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.min("node").alias("first"))
    rows = rows.join(first, rows.conv_id.eqNullSafe(first._c), "left").drop("_c")
    return rows.select("conv_id", "node", F.when(F.col("node") > F.col("first"), F.col("node") - 1).alias("parent"), "role", "text", F.char_length("text").alias("score"))


def read_back(chats: DataFrame) -> DataFrame:
    """``leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from formatted text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for leaf, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest, learned, chars = hashlib.sha256(), hashlib.sha256(), 0
                turns = read_turns(text)
                for role, own in turns:
                    digest.update(f"{role}\n{own}\n".encode())
                for s in loss:
                    own = unescape(text[s["start"] : s["end"]])
                    learned.update(own.encode())
                    chars += len(own)
                out.append((leaf, len(turns), digest.hexdigest(), chars, learned.hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("leaf", "formatted", "loss").mapInArrow(task, "leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    replies = cut(chains(rows.unionByName(more)), "chains")
    found = read_back(format_trees(replies.drop("conv_id")))
    names = replies.select(F.col("node").alias("_n"), "conv_id")
    return found.join(names, found.leaf == names._n).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _sql() -> str:
    esc = "replace({}, '\\', '\\\\')"
    for c in CONTROLS:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(len({esc.format("role")}) + len({esc.format("text")}) + {4 + len(END)}) as bigint) formatted_chars
from c group by conv_id"""


SQL = _sql()
