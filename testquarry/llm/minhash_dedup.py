"""MinHash near-dedup: one-permutation sketches, banded buckets, star-shaped candidates, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, block_pairs, confirm_stars, sorted_groups
from .common import connected_components, materialize, merged_components
from .textkernels import CHUNK, U, chunks, lower_ascii, mix, shingle_sets, task

WIDTH = 5
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Independent one-permutation sketches (rows of a band) and bins of each (bands).
ROWS, BANDS = 5, 40
#: Pairs of one bucket whose sketches agree in less than this share are taken as too far
#: apart in the search that follows the stars: 4 deviations below SIMILAR for 200 bins.
LEAST_AGREED = 0.62
#: Most ids that are broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Most texts of one side of a unit in which full sets are compared.
EXACT_BLOCK = 512

_SEEDS = mix(np.arange(1, ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_EMPTY = np.uint32(0xFFFFFFFF)


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, ROWS, BANDS) uint32 minima. Each hash goes to one bin of each sketch.

    An empty bin copies a full bin chosen by a hash of the bin and the attempt (optimal
    densification), the same way for all texts, so that two bins agree with the sets'
    similarity as probability however few shingles there are. Empty sets stay all empty.
    """
    n = len(at) - 1
    out = np.full((n, ROWS, BANDS), _EMPTY, np.uint32)
    text = np.repeat(np.arange(n), np.diff(at))
    bins = np.arange(BANDS, dtype=U)
    for r in range(ROWS):
        g = mix(sets * _SEEDS[r] + U(r))
        place = ((g >> U(32)) * U(BANDS)) >> U(32)
        value = np.minimum((g & U(0xFFFFFFFF)).astype(np.uint32), _EMPTY - np.uint32(1))
        flat = np.full(n * BANDS, _EMPTY, np.uint32)
        np.minimum.at(flat, text * BANDS + place.astype(np.int64), value)
        flat = flat.reshape(n, BANDS)
        some = (flat != _EMPTY).any(1)
        t, b = np.nonzero((flat == _EMPTY) & some[:, None])
        filled, attempt = flat.copy(), 0
        while len(t):
            attempt += 1
            source = (mix(bins * U(0xD6E8FEB86659FD93) + U(attempt * ROWS + r)) % U(BANDS)).astype(np.int64)[b]
            got = flat[t, source]
            hit = got != _EMPTY
            filled[t[hit], b[hit]] = got[hit]
            t, b = t[~hit], b[~hit]
        out[:, r, :] = filled
    return out


def _band_hashes(sk: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(BANDS, dtype=U) * U(0xA0761D6478BD642F), (len(sk), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h + sk[:, r, :].astype(U))
    return h.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in chunks(batch["text"]):
            sets, offsets = shingle_sets(lower_ascii(data), at, WIDTH)
            sk, sizes = sketches(sets, offsets), np.diff(offsets)
            full = sizes > 0
            marks = []
            for salt in (0x51, 0xA3):
                v = np.concatenate((np.zeros(1, U), np.cumsum(mix(sets ^ U(salt)))))
                marks.append(pa.array((v[offsets[1:]] - v[offsets[:-1]]).view(np.int64)))
            bands = _band_hashes(sk)
            low = (sk & 255).astype(np.uint8).reshape(len(sk), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(first, last - first), pa.array(sizes.astype(np.int64)), *marks,
                    _lists(bands[full].ravel(), np.concatenate(([0], np.cumsum(full * BANDS)))),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "mark1", "mark2", "bands", "low"],
            )


def _sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    out = []
    for _, _, data, at in chunks(pa.array(texts, pa.large_string())):
        x, f = shingle_sets(lower_ascii(data), at, WIDTH)
        out += [x[a:b] for a, b in zip(f[:-1], f[1:])]
    return out


def _alike(a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs of texts have full shingle sets that are similar enough. Equal neighbours
    in a, as the texts of a star's centre, are hashed once."""
    keep, first = np.zeros(len(a), bool), 0
    ends = np.cumsum([len(x) for x in b])
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 4 * CHUNK, "right")))
        heads = list(dict.fromkeys(a[first:last]))
        of = dict(zip(heads, _sets(heads)))
        for k, y in zip(range(first, last), _sets(b[first:last])):
            x = of[a[k]]
            if 100 * min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= SIMILAR * (len(x) + len(y) - both)
        first = last
    return keep


def _agreeing(low: np.ndarray, comp: np.ndarray, blk: np.ndarray, cross: bool, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Later members of other components whose sketches agree enough with the i-th, and how far.

    Only the lowest byte of each bin is compared: unequal bins agree by chance once in 256.
    """
    js = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((blk[i + 1 :] != blk[i]) if cross else True)) + i + 1
    agreed = (low[js] == low[i]).mean(1) if len(js) else np.zeros(0)
    ok = agreed >= LEAST_AGREED
    return js[ok], agreed[ok]


def _unit(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    ids, comp, blk = (group[k].to_numpy() for k in ("doc_id", "component", "blk"))
    low = np.frombuffer(b"".join(group["low"].to_pylist()), np.uint8).reshape(len(ids), -1)
    return ids, comp, blk, low, group["bi"][0].as_py() != group["bj"][0].as_py()


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the agreeing pairs of each unit of a bucket, most similar first."""
    for group in sorted_groups(batches, ["bucket", "bi", "bj"]):
        ids, comp, blk, low, cross = _unit(group)
        if comp.min() == comp.max():
            continue
        place = {c: k for k, c in enumerate(sorted(set(comp.tolist())))}
        local, best = np.array([place[c] for c in comp.tolist()]), {}
        for i in range(len(ids)):
            js, agreed = _agreeing(low, comp, blk, cross, i)
            for j, g in zip(js.tolist(), agreed.tolist()):
                key = (min(local[i], local[j]), max(local[i], local[j]))
                if g > best.get(key, (0.0,))[0]:
                    best[key] = (g, i, j)
        forest = Forest(len(place))
        found = [x for x in sorted(best.values(), reverse=True) if forest.join(local[x[1]], local[x[2]])]
        if found:
            a, b = ids[[x[1] for x in found]], ids[[x[2] for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["center", "doc_id"])


def _suspect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a bucket that agree enough with a member of another component."""
    for group in sorted_groups(batches, ["bucket", "bi", "bj"]):
        ids, comp, blk, low, cross = _unit(group)
        if comp.min() == comp.max():
            continue
        hit = np.zeros(len(ids), bool)
        for i in range(len(ids)):
            js, _ = _agreeing(low, comp, blk, cross, i)
            hit[js] = True
            hit[i] |= len(js) > 0
        if hit.any():
            yield pa.RecordBatch.from_arrays([group["bucket"].combine_chunks().filter(pa.array(hit)), pa.array(ids[hit])], names=["bucket", "doc_id"])


def _exact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between components in each unit, on full sets.

    A pair is checked in the first bucket that it shares, and not once its components are
    joined in the unit; nothing but the forest leaves the task.
    """
    for group in sorted_groups(batches, ["bucket", "bi", "bj"]):
        ids, comp, blk, low, cross = _unit(group)
        bands = np.stack(group["bands"].to_numpy())
        band = int((bands[0] == group["bucket"][0].as_py()).argmax())
        place = {c: k for k, c in enumerate(sorted(set(comp.tolist())))}
        local, forest, found = [place[c] for c in comp.tolist()], Forest(len(place)), []
        sets = []
        for _, _, data, at in chunks(group["text"]):
            x, f = shingle_sets(lower_ascii(data), at, WIDTH)
            sets += [x[a:b] for a, b in zip(f[:-1], f[1:])]
        for i in range(len(ids)):
            js, _ = _agreeing(low, comp, blk, cross, i)
            js = js[(bands[js] == bands[i]).argmax(1) == band] if len(js) else js
            for j in js.tolist():
                if forest.root(local[i]) == forest.root(local[j]):
                    continue
                a, b = sets[i], sets[j]
                if 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= SIMILAR * (len(a) + len(b) - both):
                    forest.join(local[i], local[j])
                    found.append((i, j))
        if found:
            a, b = ids[[x[0] for x in found]], ids[[x[1] for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["center", "doc_id"])


def _texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id ids, a written table, names: by broadcast where it has at
    most BROADCAST_IDS rows, and otherwise by a sorted join."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.select("doc_id").distinct()
    return documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _verified(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges (center, doc_id), from a written table, whose full sets are similar enough; only
    texts that an edge names are shuffled, and a centre's once for each part of its star."""
    ids = edges.select("doc_id").unionByName(edges.select(F.col("center").alias("doc_id")))
    texts = _texts_of(documents, ids).select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("payload")).dropDuplicates(["node"])
    texts = materialize(texts, "texts")
    edges = edges.select(F.col("center").alias("src"), F.col("doc_id").alias("dst"))
    return confirm_stars(edges, texts, "minhash_dedup", _alike).select(F.col("src").alias("center"), F.col("dst").alias("doc_id")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by shingle similarity.

    1. One pass over texts: set size, a 128-bit mark of the set, band hashes. Documents of
       equal sets form a class, represented by its least doc_id; only classes go on.
    2. Each bucket of a band gives edges from its least document to the others: as many
       edges as rows, however large the bucket.
    3. Edges are confirmed on full sets, for each document the center it shares most bands
       with first, then those that still join different components.
    4. Buckets that still hold several components are searched in bounded blocks for pairs
       whose sketches agree enough: first a spanning forest of such pairs is confirmed;
       then members that still agree with another component's meet with their texts, block
       by block, and give a forest of links. So a link that is no star's is not lost, and
       pairs of a bucket are never listed.

    Null and empty texts have empty sets, link with nothing and are kept; so is a row without
    a doc_id. Rows that share a
    doc_id count as one document, by any one of their texts. Ties go to the least doc_id. Other columns are dropped.
    An empty table gives an empty result.
    """
    documents = documents.select("doc_id", "text")
    sketch = materialize(
        documents.mapInArrow(task("minhash_dedup", _sketch_batches), "doc_id long, n_shingles long, mark1 long, mark2 long, bands array<long>, low binary"), "sketch"
    )
    marks = ["mark1", "mark2", "n_shingles"]
    classes = materialize(sketch.where("n_shingles > 0").groupBy(*marks).agg(F.min("doc_id").alias("rep")), "classes")
    reps = materialize(
        sketch.join(classes.select(*marks, F.col("rep").alias("doc_id")), [*marks, "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "bands", "low"), "reps"
    )
    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = materialize(rows.join(heads, "bucket").select("bucket", "doc_id", "center"), "crowded")
    stars = materialize(crowded.where("doc_id <> center").groupBy("center", "doc_id").agg(F.count("*").alias("shared")), "stars")
    best = materialize(stars.groupBy("doc_id").agg(F.max_by("center", F.struct("shared", -F.col("center"))).alias("center")), "best")
    links = materialize(_verified(best, documents), "links")
    parts = materialize(connected_components(links, "center", "doc_id"), "parts")

    def apart(edges: DataFrame) -> DataFrame:
        a, b = (parts.select(F.col("node").alias(k), F.col("component").alias("c_" + k)) for k in ("center", "doc_id"))
        return edges.join(a, "center", "left").join(b, "doc_id", "left").where(
            F.coalesce("c_center", "center") != F.coalesce("c_doc_id", "doc_id")
        ).select("center", "doc_id")

    def joined(more: DataFrame) -> None:
        nonlocal parts
        more = materialize(more, "links")
        if not more.isEmpty():
            parts = materialize(merged_components(parts, more, "center", "doc_id"), "parts")

    def mixed() -> DataFrame:
        label = parts.select(F.col("node").alias("doc_id"), "component")
        member = crowded.select("bucket", "doc_id").join(label, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        several = member.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
        member = materialize(member.join(several, "bucket"), "mixed")
        return member.join(reps.select("doc_id", "low"), "doc_id")

    edges = stars.join(best.select("center", "doc_id"), ["center", "doc_id"], "left_anti").select("center", "doc_id")
    joined(_verified(materialize(apart(edges), "edges"), documents))
    edges = block_pairs(mixed(), ["bucket"], "doc_id").mapInArrow(task("minhash_dedup", _tree_batches), "center long, doc_id long").distinct()
    joined(_verified(materialize(edges, "edges"), documents))
    member = materialize(mixed(), "members")
    suspects = block_pairs(member, ["bucket"], "doc_id").mapInArrow(task("minhash_dedup", _suspect_batches), "bucket long, doc_id long").distinct()
    suspects = materialize(suspects, "suspects")
    if not suspects.isEmpty():
        texts = _texts_of(documents, suspects)
        unit = member.join(suspects, ["bucket", "doc_id"]).join(reps.select("doc_id", "bands"), "doc_id").join(texts.dropDuplicates(["doc_id"]), "doc_id")
        joined(block_pairs(unit, ["bucket"], "doc_id", EXACT_BLOCK).mapInArrow(task("minhash_dedup", _exact_batches), "center long, doc_id long").distinct())

    classes = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*marks, F.coalesce("component", "rep").alias("component_id"))
    result = sketch.select("doc_id", *marks).join(classes, marks, "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull()).alias("kept"))
