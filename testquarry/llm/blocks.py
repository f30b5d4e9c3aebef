"""Groups of any size as bounded blocks, and streaming over the groups of sorted batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textkernels import task

#: Most rows of one side of a block pair.
BLOCK = 2048
#: One ident in so many measures the buckets.
SAMPLE = 16
#: Edges of one part of a star.
STAR = 256


def block_pairs(rows: DataFrame, bucket: list[str], ident: str, block: int = BLOCK) -> DataFrame:
    """rows with blk, bi, bj: a bucket of over `block` rows is dealt into blocks by a hash of
    ident, and each pair of blocks becomes a unit of work of its own; others are one unit.

    Rows come sorted by bucket, bi, bj within partitions that are dealt by (bucket, bi, bj): a hot bucket spreads over the cluster, and no task holds more than two blocks
    of a bucket at once. Buckets are measured in a first pass by the rows of one ident in
    SAMPLE, drawn by a hash, so a block is of about the size asked for; which pairs meet
    doesn't depend on it. The large ones, fewer than one for `block` rows, are a written
    table when they are joined.
    """
    drawn = rows.where(F.pmod(F.xxhash64(ident, F.lit(3)), F.lit(SAMPLE)) == 0) if block >= 16 * SAMPLE else rows
    rate = SAMPLE if block >= 16 * SAMPLE else 1
    large = materialize(drawn.groupBy(*bucket).agg(F.count("*").alias("_n")).where(f"_n * {rate} > {block}").select(*bucket, F.ceil(F.col("_n") * rate / block).cast("int").alias("_b")), "large")
    keys = [*bucket, "bi", "bj"]
    if large.isEmpty():
        whole = rows.withColumns({k: F.lit(0) for k in ("blk", "bi", "bj")})
        return whole.repartition(*bucket).sortWithinPartitions(*bucket)
    parts = F.coalesce("_b", F.lit(1))
    blk = F.pmod(F.xxhash64(ident, F.lit(7)), parts.cast("long")).cast("int")
    unit = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, F.col("blk")).alias("bi"), F.greatest(k, F.col("blk")).alias("bj")))
    return (
        rows.join(large, bucket, "left").withColumn("blk", blk)
        .select(*rows.columns, "blk", F.explode(unit).alias("_u")).select(*rows.columns, "blk", "_u.bi", "_u.bj")
        .repartition(*keys).sortWithinPartitions(*keys)
    )


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches sorted by them; holds one group and one batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _star_batches(same: Callable[[list[str], list[str]], list[bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = "", (None, None)
        for batch in batches:
            src, dst, chunk, payload = (batch[k].to_pylist() for k in ("src", "dst", "chunk", "payload"))
            rows, heads = [], []
            for i, d in enumerate(dst):
                if d is None:
                    head, at = payload[i], (src[i], chunk[i])
                else:
                    assert (src[i], chunk[i]) == at
                    rows.append(i)
                    heads.append(head)
            kept = pa.array([i for i, ok in zip(rows, same(heads, [payload[i] for i in rows])) if ok], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["src"].take(kept), batch["dst"].take(kept)], names=["src", "dst"])

    return run


def confirm_stars(edges: DataFrame, texts: DataFrame, owner: str, same: Callable[[list[str], list[str]], list[bool]]) -> DataFrame:
    """The edges (src, dst), from a written table, for which `same` of the payloads holds, given for many edges at once.

    A src of many edges is dealt into parts of some STAR edges: its payload (texts: node,
    payload) is shipped once for each part, a dst's once for each of its edges, and no task
    holds more than one src's payload and a batch.
    """
    edges = edges.select("src", "dst")
    parts = edges.groupBy("src").agg(F.ceil(F.count("*") / STAR).alias("n"))
    dealt = edges.join(parts, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("n")).alias("chunk"))
    members = dealt.join(texts.withColumnRenamed("node", "dst"), "dst").select("src", "chunk", "dst", "payload")
    heads = dealt.select("src", "chunk").distinct().join(texts.withColumnRenamed("node", "src"), "src").select("src", "chunk", F.lit(None).cast("long").alias("dst"), "payload")
    rows = heads.unionByName(members).repartition("src", "chunk").sortWithinPartitions("src", "chunk", F.col("dst").asc_nulls_first())
    return rows.mapInArrow(task(owner, _star_batches(same)), "src long, dst long")


class Forest:
    """Union-find over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
