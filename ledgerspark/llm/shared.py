"""What several operators use: the shared folder, prefix sums over sorted rows, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: The ASCII white space that separates words.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where none is set, a local session has a folder of its own; a cluster raises, as its executors
    would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    The table replaces the lineage, so that a lost executor costs a read and not a recomputation.
    It goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that is sent to every task.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for a broadcast join if it is counted to have no more than ``most`` rows."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Plan nodes that give each row of a file at most once.
ROW_WISE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}
#: Rows of a file are numbered within so many bits.
FILE_BITS = 36


def from_files(df: DataFrame) -> bool:
    """Whether every row is a row of a Parquet file, so that file and place in it tell rows apart."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ROW_WISE:
        if plan.children().isEmpty():
            return "parquet" in plan.toString().lower()
        plan = plan.children().head()
    return False


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number each (unique, not gapless), which repeated and null ids don't share.

    A number must be the same whenever a row is read.  Rows of Parquet files get theirs from their file and
    their place in it; anything else is written with numbers first.
    """
    if not from_files(df):
        return cut(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    path, place, file, at = (fresh(df, c) for c in ("_path", "_place", "_file", "_at"))
    files = df.select(F.col("_metadata.file_path").alias(file)).distinct()
    files = small(files.withColumn(at, F.row_number().over(Window.orderBy(file)).cast("long")), "files")
    rows = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place)).join(files, F.col(path) == F.col(file))
    return rows.withColumn(name, F.shiftleft(at, FILE_BITS) + F.col(place)).drop(path, place, file, at)


#: Tasks that a group's rows are dealt over where they meet a value of the group.
SALTS = 16


def with_total(rows: DataFrame, group: str, total: Column, key: str) -> DataFrame:
    """``rows`` and an aggregate (an aliased column) of each one's ``group``.

    Aggregates are taken in part before they are shuffled; each group's then goes to some tasks, over
    which the group's rows are dealt by ``key``, so that no group of any size meets in one task.
    """
    found = rows.groupBy(F.col(group).alias("_g")).agg(total).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(SALTS)).cast("int"))
    return dealt.join(found, (dealt[group] == found["_g"]) & (dealt["_salt"] == found["_s"])).drop("_g", "_s", "_salt")


def with_least(rows: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """``rows`` and ``least``, the least ``value`` of each one's ``group``."""
    return with_total(rows, group, F.min(value).alias("least"), key)


#: Rows of a key from which the key's entry is sent to the rows instead of these to it.
HOT_ROWS = 10_000


def hot_join(rows: DataFrame, table: DataFrame, on: list[tuple[str, str]], times: str) -> DataFrame:
    """Inner join of rows with their entry of ``table``, which has one for each key and how many rows it has.

    Entries of keys with many rows are few; they are broadcast (if counted to be), so such a key's rows stay where
    they are.
    """
    hot = small(table.where(F.col(times) > HOT_ROWS), "hot")
    match = lambda t: reduce(and_, (rows[a] == t[b] for a, b in on))
    rest = table.where(F.col(times) <= HOT_ROWS)
    return rows.join(hot, match(hot)).unionByName(rows.join(hot, match(hot), "left_anti").join(rest, match(rest)))


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """How many partitions hold so many rows at about ``each`` rows, at least one per core slot."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def running_totals(df: DataFrame, group: str | None, value: str, order: list[str], out: str, n: int) -> DataFrame:
    """Exclusive running sum of ``value`` in the order ``(group, *order)``, within each group.

    Rows are range-partitioned and summed in each partition; only one total per (partition, group)
    travels, so a group of any size spreads over many tasks.  ``df`` should be a table: ranges are
    found by a pass over it.  The result has the columns of ``df`` and ``out`` (long).
    """
    keys = [*([group] if group else []), *order]
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "sorted")
    # the table's files hold the sorted partitions; a partition's rows are summed in order again
    totals = placed.groupBy("_part", *([group] if group else [])).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*([group] if group else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *([F.col(group).alias("_group")] if group else []), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    match = placed["_part"] == before["_part"]
    if group:
        match &= placed[group].eqNullSafe(before["_group"])
    within = Window.partitionBy("_part", *([group] if group else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(before, match, "left").drop(before["_part"])
    return joined.withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long")).drop("_before", "_group", "_part")


def share(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows (all, if there are no more), chosen by a hash of a key.

    Unlike an ordered limit, no task sends more than its part to the driver.
    """
    part = min(1.0, most / max(1, df.count()))
    return df if part == 1 else df.where(F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1_000_000)) < int(part * 1_000_000))


def words(text: Column) -> Column:
    """The words of a text, natively."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one of its component."""
    ids, k = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = k[: len(a)], k[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


#: Links that a task contracts.
TASK_LINKS = 200_000


def contract(edges: DataFrame) -> DataFrame:
    """Fewer links ``(a, b)`` with the same components: each task keeps a spanning forest of its part.

    Tasks that saw the same group of nodes give much the same links; meeting in fewer tasks, those
    become one forest.  It ends when one task holds all links or a round no longer helps.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            a, b = spanning(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    edges = cut(edges.select("a", "b"), "links")
    n = edges.count()
    while n > 1:
        tasks = -(-n // TASK_LINKS)
        edges = cut(edges.repartition(tasks).mapInArrow(task, "a long, b long"), "links")
        before, n = n, edges.count()
        if tasks == 1 or n > 0.7 * before:
            break
    return edges


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """The smallest node id that each node reaches over undirected edges ``(a, b)`` (longs).

    Returns ``(node, root)`` for nodes that have an edge.  Labels fall to the smallest neighbour's
    and then jump along their own label, so long chains close in a logarithmic number of rounds.
    Every step is a join or a minimum with partial aggregation: a hub of any degree is summed before
    it is shuffled, and skewed joins can be split.  Each round is written to the shared folder.
    """
    edges = contract(edges)
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "label")
    for _ in range(rounds):
        near = both.join(label, both.b == label.node).select(both.a.alias("node"), "root")
        low = near.union(label).groupBy("node").agg(F.min("root").alias("low"))
        up = label.select(F.col("node").alias("via"), F.col("root").alias("up"))
        jump = low.join(up, low.low == up.via).select("node", F.least("low", "up").alias("root"))
        new = cut(jump, "label")
        changed = new.join(label.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
