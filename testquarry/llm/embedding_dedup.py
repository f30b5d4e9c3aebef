"""Embedding near-dedup: sign hashes of random hyperplanes, exact cosine check, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, block_pairs, sorted_groups
from .common import connected_components, materialize
from .textkernels import task

SIMILAR = 0.95
#: Share of pairs at exactly SIMILAR that some table must bring together; closer pairs meet oftener.
RECALL = 0.995
#: Vectors that a bucket holds on average, which sets the bits of a table.
FILL = 64
SEED = 20240229


def tables_for(n: int, similar: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables). Bits follow the logarithm of n, so buckets stay the same size; a
    pair at the threshold shares a table with p ** bits, and tables reach the recall."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / FILL + 1)))
    p = 1 - math.acos(similar) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def hyperplanes(bits: int, tables: int, dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dim))


def _signature(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket numbers."""
    sign = (vectors @ hyperplanes(bits, tables, vectors.shape[1]).T > 0).reshape(len(vectors), tables, bits)
    return sign @ (1 << np.arange(bits, dtype=np.int64))


def near_vectors(embeddings: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked by a cosine of `similar` or more.

    Equal vectors form a class, represented by its least vec_id. Each class goes to one
    bucket of every table. A bucket's pairs are checked as matrix products in bounded
    blocks, in double precision; a pair counts in the first table that brings it together,
    so links are added up without a list of pairs, and a block gives only a spanning forest
    of its links for the components. Members count their class's other members and all
    members of linked classes.

    Null, empty and zero vectors and those with null or non-finite components link with
    nothing, as do vectors of unlike dimension with each other. Rows that share a vec_id
    must have the same vector. Other columns, labels included, are dropped. An empty table
    gives an empty result.
    """
    raw = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    bad = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) | ~F.exists("v", lambda x: x != 0)
    keyed = materialize(
        raw.select("vec_id", F.when(F.coalesce(bad, F.lit(True)), None).otherwise(F.col("v")).alias("v"))
        .withColumn("mark", F.sha2(F.to_json(F.struct("v")), 256)), "vectors",
    )
    classes = materialize(
        keyed.where("v is not null").groupBy("mark").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("members"), F.any_value("v").alias("v")), "classes"
    )
    n = classes.count()
    bits, tables = tables_for(n, similar, recall)
    kind = "rep long, members long, v array<double>, signature array<int>, bucket array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"].combine_chunks() if isinstance(batch["v"], pa.ChunkedArray) else batch["v"]
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(sizes)))
            sig = np.zeros((len(sizes), tables), np.int64)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                sig[rows] = _signature(flat[at[rows][:, None] + np.arange(d)], bits, tables)
            bucket = ((sizes.astype(np.int64)[:, None] * tables + np.arange(tables)) << bits) + sig
            cut = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables)
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.ravel())) for x in (sig.astype(np.int32), bucket)]
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["members"], v, *lists], names=["rep", "members", "v", "signature", "bucket"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["bucket", "bi", "bj"]):
            ids, members, blk = (g[k].to_numpy() for k in ("rep", "members", "blk"))
            v = np.stack(g["v"].to_numpy())
            v = v / np.abs(v).max(1)[:, None]
            sig = np.stack(g["signature"].to_numpy())
            norm = np.sqrt((v * v).sum(1))
            table = (int(g["bucket"][0].as_py()) >> bits) % tables
            cross = g["bi"][0].as_py() != g["bj"][0].as_py()
            left = np.flatnonzero(blk == g["bi"][0].as_py()) if cross else np.arange(len(ids))
            right = np.flatnonzero(blk == g["bj"][0].as_py()) if cross else left
            count, forest, kept = np.zeros(len(ids), np.int64), Forest(len(ids)), []
            for k in range(0, len(left), 256):
                a = left[k : k + 256]
                near = (v[a] @ v[right].T) / (norm[a][:, None] * norm[right][None, :]) >= similar
                if not cross:
                    near &= right[None, :] > a[:, None]
                x, y = np.nonzero(near)
                x, y = a[x], right[y]
                if table and len(x):
                    first = ~(sig[x, :table] == sig[y, :table]).any(1)
                    x, y = x[first], y[first]
                np.add.at(count, x, members[y])
                np.add.at(count, y, members[x])
                kept += [(i, j) for i, j in zip(x.tolist(), y.tolist()) if forest.join(i, j)]
            some = np.flatnonzero(count)
            if len(some):
                other = np.full(len(ids), -1)
                a = np.array([i for i, _ in kept]), np.array([j for _, j in kept])
                rows_id = np.concatenate((ids[some], ids[a[0]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows_id), pa.array(np.concatenate((count[some], np.zeros(len(kept), np.int64)))),
                     pa.array(np.concatenate((other[some], ids[a[1]])))], names=["rep", "links", "other"],
                )

    signed = classes.select("rep", "members", "v").mapInArrow(task("embedding_dedup", sign), kind)
    rows = signed.select("rep", "members", "v", "signature", F.explode("bucket").alias("bucket"))
    found = materialize(block_pairs(rows, ["bucket"], "rep").mapInArrow(task("embedding_dedup", links), "rep long, links long, other long"), "links")
    counts = found.where("other = -1").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other <> -1").select("rep", "other"), "rep", "other")
    classes = classes.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("mark").alias("class"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c")
    )
    out = keyed.select("vec_id", F.when(F.col("v").isNotNull(), F.col("mark")).alias("mark")).join(classes, F.col("mark") == F.col("class"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
