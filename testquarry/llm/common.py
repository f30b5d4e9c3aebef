"""Shared pieces: scratch tables, stable hashing, distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and the five controls from tab to carriage return.
SPACE = " \t-\r"

#: Most edges of a graph that one task joins: 16 bytes each on the wire, some 200 in memory.
TASK_EDGES = 20_000
#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 32 << 20

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all executors share.

    Only a local session that sets none gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="testquarry-")
    return "file://" + _OWN["root"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to a table in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks it ran.
    """
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Have the executors' heaps collected, so that they give back what the last stage took.

    A few short tasks for each core call the collector. An executor that gets none only
    keeps its memory; no result depends on it.
    """
    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def unused(name: str, columns: list[str]) -> str:
    """A column name like `name` that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def unsigned_crc(value: Column) -> Column:
    return F.crc32(F.encode(value.cast("string"), "UTF-8"))


def _forest_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a task's edges by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): the smallest id each node reaches; nodes without edges don't appear.

    Alternating large-star and small-star steps: each is a grouped minimum (combined before
    the shuffle) and an equi join whose hot side adaptive execution can split, so a
    component that holds most rows never meets in one task. Every round is written to the
    scratch folder, and rounds grow with the logarithm of a component's size. A graph of at
    most task_edges distinct edges, a fixed bound of a few megabytes, is one task's union-find.
    Nulls and self-loops are dropped; an empty edge list gives an empty result.
    """
    work = (
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where("a <> b").distinct()
    )
    work = materialize(work, "cc")
    if work.count() <= task_edges:
        return work.repartition(1).mapInArrow(_forest_labels, "node long, component long")
    before = None
    while True:
        # large star: every larger neighbour of a node joins the node's smallest neighbour
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        work = (
            both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: a node's smaller neighbours join the smallest of them
        low = work.groupBy("a").agg(F.min("b").alias("m"))
        work = (
            work.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        work = materialize(work, "cc")
        now = work.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
        if now == before or not now[0]:
            break
        before = now
    return work.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        work.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def merged_components(parts: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """parts (node, component), a written table, after more edges: only the graph of the
    components that these join is searched, and nodes take their component's new label."""
    a, b = (parts.select(F.col("node").alias(k), F.col("component").alias("c_" + k)) for k in (src, dst))
    joined = edges.join(a, src, "left").join(b, dst, "left").select(F.coalesce("c_" + src, src).alias("src"), F.coalesce("c_" + dst, dst).alias("dst"))
    over = materialize(connected_components(joined), "cc-over")
    moved = parts.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(over.join(parts, "node", "left_anti"))


def small_enough(table: DataFrame, lists: str, width: int, rows_of: int = 64, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table whose rows hold `lists`, of `width` bytes an entry, and rows_of
    bytes besides, takes `most` bytes in memory at most."""
    rows, entries = table.agg(F.count("*"), F.sum(F.size(lists))).first()
    return rows * rows_of + (entries or 0) * width <= most
