"""Minimax contiguous sharding of atomic groups by binary search on the capacity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unsigned_crc

SHARDS = 40
#: Bytes that each document adds to those of its text.
OVERHEAD = 16
#: Hex digits of the first cells, and parts by which each shard's rows are numbered.
FIRST_DIGITS, PARTS = 4, 256


def _cut(ends: list[int], capacity: int, shards: int, start: int = 0) -> list[int]:
    """Greedy cut places in bytes: each shard takes units while it holds them."""
    at, out = start, []
    for _ in range(shards):
        k = bisect_right(ends, at + capacity)
        at = max(at, ends[k - 1] if k else 0)
        out.append(at)
    return out


def _even_cut(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cut places at the given capacity, each as near as can be to an even share of the rest.

    A place may lie anywhere between the least one from which the later shards still hold
    the rest and the greedy one; so the capacity stays, and slack isn't left to the last.
    """
    places = [0, *ends]
    least = [places[-1]]
    for _ in range(shards):
        least.append(places[bisect_left(places, least[-1] - capacity)])
    at, out = 0, []
    for left in range(shards, 0, -1):
        share = at + (places[-1] - at) / left
        i = bisect_left(places, max(at, least[left - 1]))
        j = bisect_right(places, at + capacity) - 1
        k = min(max(bisect_left(places, share), i), j)
        at = min(places[max(k - 1, i)], places[k], key=lambda x: abs(x - share))
        out.append(at)
    return out


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which a greedy pass puts all sizes, in order, into the shards."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if _cut(ends, mid, shards)[-1] == ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _cells(groups: DataFrame, digits: int) -> DataFrame:
    return groups.groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("n")).select("cell", "bytes", "n")


def _boundaries(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Least keys of shards 1.. and the capacity.

    groups (key: hex digits, bytes) lie in key order. Cells of equal leading digits are
    summed and only the sums come to the driver. Taken as whole, cells bound the capacity
    from above; taken as divisible, from below. Only cells in which a cut may fall at a
    capacity between the two are divided by a further digit, until each of them is a
    single group, when both bounds are the exact answer.
    """
    cells = sorted((r.cell, r.bytes, r.n) for r in _cells(groups, FIRST_DIGITS).collect())
    if not cells:
        return [], 0
    while True:
        sizes = [c[1] for c in cells]
        ends = list(accumulate(sizes))
        high = smallest_capacity(sizes, shards)
        low = max(-(-ends[-1] // shards), max((b for _, b, n in cells if n == 1), default=0))
        least = [min(x, ends[-1] - high * (shards - 1 - k)) for k, x in enumerate(_cut(ends, low, shards))]
        most = [min(ends[-1], high * (k + 1)) for k in range(shards)]
        wide, k = [], 0
        for i, (cell, b, n) in enumerate(cells):
            start = ends[i] - b
            while k < shards - 1 and most[k] < start:
                k += 1
            if n > 1 and any(least[j] < ends[i] and most[j] > start for j in range(k, shards)):
                wide.append(cell)
        if not wide:
            break
        deeper = {}
        for d in sorted({len(c) for c in wide}):
            part = [c for c in wide if len(c) == d]
            got = _cells(groups.where(F.substring("key", 1, d).isin(part)), d + (2 if len(part) < 400 else 1)).collect()
            for r in got:
                deeper.setdefault(r.cell[:d], []).append((r.cell, r.bytes, r.n))
        cells = sorted(x for c in cells for x in deeper.get(c[0], [c]))
    cuts = _even_cut(ends, high, shards)
    starts = {0: cells[0][0]} | {ends[i]: cells[i + 1][0] for i in range(len(cells) - 1)}
    return [starts.get(at, "~") for at in cuts[:-1]], high


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: all documents in shards of near equal bytes.

    Atomic groups are documents of equal text. Their order: groups that are larger than a
    fair share of what is left come first, the largest first (fewer than there are shards,
    so the driver can hold them), then all others by the SHA-256 of the text. The order is
    cut into contiguous shards; a large group is a shard, which is the least that holds it,
    and the others are cut at the smallest capacity at which a greedy pass puts them all
    into the shards left. Where that capacity leaves slack, cuts are placed evenly within
    it, so that slack isn't left to the last shard. Slots number each shard's rows from 0: rows are ranked within PARTS parts of a
    shard, whose counts (shards * PARTS rows, a fixed bound) give the parts' offsets, so
    that no shard is numbered by a single task.

    A null text counts as empty: size OVERHEAD, CRC 0, grouped with empty texts. Repeated
    rows get slots of their own. An empty table gives an empty result. Other columns are
    dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        documents.select(
            "doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), unsigned_crc(text).alias("text_crc32"),
            F.sha2(F.encode(text, "UTF-8"), 256).alias("key"),
        ),
        "sizes",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    own = [(r.bytes, r.key) for r in groups.where(F.col("bytes") * shards > total).collect()] if total else []
    hot, left, free = [], total, shards
    for b, key in sorted(own, reverse=True):
        if free > 1 and b * free > left:
            hot, left, free = [*hot, key], left - b, free - 1
    rest = groups.where(~F.col("key").isin(hot)) if hot else groups
    cuts, _ = _boundaries(rest, free)
    shard: Column = F.lit(len(hot))
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    for i, key in enumerate(hot):
        shard = F.when(F.col("key") == key, i).otherwise(shard)
    placed = rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)).cast("int").alias("part"))
    counts = {(r["shard"], r["part"]): r["n"] for r in placed.groupBy("shard", "part").agg(F.count("*").alias("n")).collect()}
    ends, at = [], {}
    for (s, p), n in sorted(counts.items()):
        ends.append((s, p, at.get(s, 0)))
        at[s] = at.get(s, 0) + n
    spark = documents.sparkSession
    offsets = spark.createDataFrame(ends, "shard int, part int, first long")
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    return (
        placed.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
