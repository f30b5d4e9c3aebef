"""Fuzzy line dedup: MinHash bands of character n-grams, edit similarity, one occurrence per connected group."""

from __future__ import annotations

import gc
import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, Forest, block_pairs, confirm_stars
from .common import connected_components, let, materialize, merged_components, small_enough
from .textkernels import U, chunks, mix, span_hashes, task

#: Lines of fewer words and characters are only compared exactly, where they are compared at all.
MIN_WORDS, MIN_CHARS = 5, 20
#: Least edit similarity of a link: 1 - distance / length of the longer line.
SIMILAR = 0.75
#: Bytes of the n-grams, MinHashes of a line (one permutation, so many bins), and of a band.
#: Fixed: which lines meet doesn't depend on how many other lines there are.
GRAM, BINS, ROWS, BANDS = 10, 36, 2, 12
#: A line's sketch has three bits of each MinHash. Lines that meet go on if at least so many
#: cells agree: of unlike lines one in eight does, at Jaccard similarity J that and J of the rest.
CELL, LEAST_AGREED = 3, 14
#: Bands that are searched in one pass, and a number above that of all bands.
PASS, MOST_BANDS = 6, 1024
#: Most lines of one side of a unit in which lines themselves are compared.
LINKED_BLOCK = 512

#: Bytes of text hashed at once: as much as a core's cache holds with its work space.
PIECE = 1 << 17

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum() and i != 10]] = 32
_FOLD[48:58] = 48


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ASCII letters lower-cased, digit runs as one 0, and runs of blanks,
    controls and ASCII punctuation as one space; line feeds stay. Offsets are adapted."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != folded[:-1]) | ((folded[1:] != 32) & (folded[1:] != 48))
    edge = at[(at > 0) & (at < len(folded))]
    keep[edge] = True
    seen = np.concatenate(([0], np.cumsum(keep)))
    return folded[keep], seen[at]


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, number in the text, start and end of every line; an empty text has one empty line."""
    feeds = np.flatnonzero(data == 10)
    count = np.searchsorted(feeds, at[1:]) - np.searchsorted(feeds, at[:-1]) + 1
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(text)) - first[text]
    start, end = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    is_first, is_last = number == 0, number == count[text] - 1
    start[is_first], end[is_last] = at[:-1], at[1:]
    start[~is_first], end[~is_last] = feeds + 1, feeds
    return text, number, start, end


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = (data != 32) & (data != 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    return starts, ends


def minima(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, BINS) MinHashes of the byte n-grams of lines of eight bytes or more.

    One permutation: an n-gram's hash gives its bin and its value. An empty bin copies a
    full one, the same way for all lines (optimal densification).
    """
    sizes = np.maximum(ends - starts - GRAM + 1, 1)
    first, n = np.cumsum(sizes) - sizes, len(starts)
    tail = np.concatenate((data, np.full(2 * GRAM, 10, np.uint8))).astype(U)
    x = tail
    for width in (1, 2, 4):  # eight bytes as one number
        x = x[:-width] | x[width:] << U(8 * width)
    gram = x[: len(data)] * U(0x9E3779B97F4A7C15) + (tail[8 : len(data) + 8] | tail[9 : len(data) + 9] << U(8))
    h = mix(gram[np.repeat(starts - first, sizes) + np.arange(sizes.sum())] + U(1))
    place = np.repeat(np.arange(n) * BINS, sizes) + ((h >> U(48)) * U(BINS) >> U(16)).astype(np.int64)
    low = np.full(n * BINS, _EMPTY, np.uint32)
    np.minimum.at(low, place, np.minimum((h >> U(12)).astype(np.uint32), _EMPTY - np.uint32(1)))
    low = low.reshape(n, BINS)
    t, b = np.nonzero(low == _EMPTY)
    filled, attempt = low.copy(), 0
    while len(t):
        attempt += 1
        got = low[t, (mix(np.arange(BINS, dtype=U) * U(0xD6E8FEB86659FD93) + U(attempt)) % U(BINS)).astype(np.int64)[b]]
        hit = got != _EMPTY
        filled[t[hit], b[hit]] = got[hit]
        t, b = t[~hit], b[~hit]
    return filled


_EMPTY = np.uint32(0xFFFFFFFF)
#: The lowest bit of each cell of half a sketch.
_CELLS = U(sum(1 << CELL * k for k in range(BINS // 2)))


def sketched(low: np.ndarray) -> np.ndarray:
    """(lines, 2) numbers of CELL bits of each MinHash."""
    cell = mix(low.astype(U)).reshape(len(low), 2, -1) >> U(64 - CELL)
    return (cell << np.arange(0, CELL * BINS // 2, CELL, dtype=U)).sum(2, dtype=U)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many cells of two half sketches are equal."""
    d = x ^ y
    return BINS // 2 - np.bitwise_count((d | d >> U(1) | d >> U(2)) & _CELLS).astype(np.int16)


def band_hashes(low: np.ndarray) -> np.ndarray:
    """(lines, BANDS) 32-bit hashes of each band's MinHashes."""
    total = np.zeros((len(low), BANDS), U)
    for k in range(ROWS):
        total = mix(total * U(0x9E3779B97F4A7C15) + low[:, k : ROWS * BANDS : ROWS].astype(U) + U(1))
    return np.ascontiguousarray((total >> U(32)).astype(np.uint32))


#: A line's band hashes, two to a number, and its sketch.
BAND_WORDS, SKETCH_WORDS = [f"b{i}" for i in range(BANDS // 2)], ["w0", "w1"]
SIGNATURE = [*BAND_WORDS, *SKETCH_WORDS]


def _line_batches(shortest: int = MIN_WORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in chunks(batch["text"], PIECE):
                data, at = normalised(data, at)
                text, number, start, end = line_spans(data, at)
                ws, we = _words(data, at)
                fw = np.append(np.searchsorted(ws, start), len(ws))
                count = np.searchsorted(ws, end) - fw[:-1]
                ok = np.flatnonzero(count > 0)
                a, b = ws[fw[ok]], we[fw[ok] + count[ok] - 1]
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                fuzzy = (count[ok] >= MIN_WORDS) | (chars[b] - chars[a] >= MIN_CHARS)
                use = fuzzy | (count[ok] >= shortest)
                ok, a, b, fuzzy = ok[use], a[use], b[use], fuzzy[use]
                if not len(ok):
                    continue
                # a line that is only compared exactly is in no band
                signature = np.zeros((len(ok), len(SIGNATURE)), np.int64)
                if fuzzy.any():
                    low = minima(data, a[fuzzy], b[fuzzy])
                    signature[fuzzy] = np.concatenate((band_hashes(low).view(np.int64), sketched(low).view(np.int64)), 1)
                of, which = batch.slice(first, last - first), pa.array(text[ok])
                yield pa.RecordBatch.from_arrays(
                    [of["doc_id"].take(which), of["mark"].take(which), pa.array(number[ok].astype(np.int32)), pa.array(span_hashes(data, a, b).view(np.int64)),
                     pa.array((chars[b] - chars[a]).astype(np.int32)), *(pa.array(c, mask=~fuzzy) for c in signature.T)],
                    names=["doc_id", "mark", "line", "key", "size", *SIGNATURE],
                )

    return run


def whole_units(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, several at a time, from sorted batches."""
    held, n = [], 0
    for group in _runs(batches, keys):
        held.append(group)
        n += group.num_rows
        if n >= rows:
            yield pa.concat_tables(held)
            held, n = [], 0
    if held:
        yield pa.concat_tables(held)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """As sorted_groups, but all runs that a batch ends come as one table."""
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
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _close_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of a unit whose sketches agree in enough cells, and the units' numbers.

    All units of the table at once: each row meets the d-th row after it while that is in
    its unit, for d = 1, 2, ...
    """
    n = table.num_rows
    w0, w1 = (table[w].to_numpy().view(U) for w in SKETCH_WORDS)
    new = np.zeros(n, bool)
    for k in ("bucket", "bi", "bj"):
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    unit = np.cumsum(new)
    end = np.searchsorted(unit, unit, "right")
    cross, blk = table["bi"].to_numpy() != table["bj"].to_numpy(), table["blk"].to_numpy()
    size = table["size"].to_numpy()
    rows, d, left, right = np.arange(n), 0, [], []
    while len(rows):
        d += 1
        rows = rows[rows + d < end[rows]]
        far = rows + d
        ok = agreeing(w0[rows], w0[far]) + agreeing(w1[rows], w1[far]) >= LEAST_AGREED
        ok &= ~cross[rows] | (blk[rows] != blk[far])
        # characters differ by no more than the edits
        ok &= np.minimum(size[rows], size[far]) >= SIMILAR * np.maximum(size[rows], size[far]) - 1e-6
        left.append(rows[ok])
        right.append(far[ok])
    a, b = np.concatenate(left or [rows]), np.concatenate(right or [rows])
    return a, b, unit


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each unit's close pairs."""
    for table in whole_units(batches, ["bucket", "bi", "bj"]):
        a, b, _ = _close_pairs(table)
        if not len(a):
            continue
        # rows are told apart by unit, so one forest serves all units
        place = {x: k for k, x in enumerate(np.unique(np.concatenate((a, b))).tolist())}
        forest = Forest(len(place))
        kept = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if forest.join(place[i], place[j])]
        node = table["node"].to_numpy()
        x, y = node[[i for i, _ in kept]], node[[j for _, j in kept]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["src", "dst"])


def _suspect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a bucket that are close to one of another component."""
    for table in whole_units(batches, ["bucket", "bi", "bj"]):
        a, b, _ = _close_pairs(table)
        comp = table["component"].to_numpy()
        ok = comp[a] != comp[b]
        hit = np.unique(np.concatenate((a[ok], b[ok])))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(table[k].to_numpy()[hit]) for k in ("bucket", "node")], names=["bucket", "node"])


def _linked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between components in each unit, on the lines themselves.

    A pair is compared in the first band that it shares, and not once its components are
    joined in the unit; nothing but the forest leaves the task.
    """
    for table in whole_units(batches, ["bucket", "bi", "bj"], BLOCK):
        a, b, unit = _close_pairs(table)
        comp, node, bucket = (table[k].to_numpy() for k in ("component", "node", "bucket"))
        bands = np.stack([table[w].to_numpy() for w in BAND_WORDS], 1).view(np.uint32)
        ok = comp[a] != comp[b]
        a, b = a[ok], b[ok]
        ok = (bands[a] == bands[b]).argmax(1) == bucket[a] % MOST_BANDS if len(a) else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        words = table["payload"]
        # a joined pair of components needs no more links in a unit, nor do those it joins
        ranked = np.lexsort((b, a, unit[a]))
        a, b = a[ranked], b[ranked]
        place = {c: k for k, c in enumerate(np.unique(np.concatenate((comp[a], comp[b]))).tolist())}
        label, forests, found = [place.get(c, -1) for c in comp.tolist()], {}, []
        for lo in range(0, len(a), 8 * PAIRS):
            todo = []
            for i, j in zip(a[lo : lo + 8 * PAIRS].tolist(), b[lo : lo + 8 * PAIRS].tolist()):
                forest = forests.get(unit[i])
                if forest is None:
                    forest = forests[unit[i]] = Forest(len(place))
                if forest.root(label[i]) != forest.root(label[j]):
                    todo.append((i, j))
            left, right = ([words[k].as_py() for k in side] for side in zip(*todo)) if todo else ([], [])
            for (i, j), ok in zip(todo, similar_pairs(left, right, likely=False)):
                if ok and forests[unit[i]].join(label[i], label[j]):
                    found.append((i, j))
        if found:
            x, y = node[[i for i, _ in found]], node[[j for _, j in found]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["src", "dst"])


def edit_distance(a, b, most: int | None = None) -> int:
    """Edits between two sequences, bit-parallel over whole numbers of len(a) bits; some number
    above `most`, where that is given, once the items left can't bring the edits down to it."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for k, x in enumerate(b):
        if most is not None and not k % LOOK and score - (len(b) - k) > most:
            return score
        eq = places.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full | 1, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
    return score


def _common(x, y, n: int) -> int:
    """Length of the longest common start, of n items at most."""
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid)
    return low


def _trimmed(x, y):
    """Two sequences without their common start and end."""
    i = _common(x, y, min(len(x), len(y)))
    x, y = x[i:], y[i:]
    j = _common(x[::-1], y[::-1], min(len(x), len(y)))
    return x[: len(x) - j], y[: len(y) - j]


def _codes(items: Sequence[str] | Sequence[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All characters or numbers of the items as numbers, and the items' lengths."""
    size = np.array([len(x) for x in items])
    if isinstance(items[0], str):
        return np.frombuffer("".join(items).encode("utf-32-le"), np.uint32).astype(np.int64), size
    return np.fromiter(chain.from_iterable(items), np.int64, int(size.sum())), size


def edit_distances(short: Sequence, long: Sequence, most: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs at once, bit-parallel over rows of up to 63 64-bit
    numbers; a pair is two strings or two lists of numbers below 2**32, none of them empty.

    A pair whose characters left can't bring its distance down to `most` may be given up:
    what is returned for it is then some number above `most`.
    """
    n, one, top = len(short), U(1), U(63)
    (x, size), (y, steps) = _codes(short), _codes(long)
    words = int(size.max() + 63) // 64
    of_x, of_y = np.repeat(np.arange(n), size), np.repeat(np.arange(n), steps)
    # a row of bits for each character of each short string, and a last one for all others
    own, x = np.unique(of_x << 32 | x, return_inverse=True)
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    equal = np.zeros((len(own) + 1, words), U)
    np.bitwise_or.at(equal, (x, place >> 6), one << (place & 63).astype(U))
    y = of_y << 32 | y
    at = np.searchsorted(own, y)
    y = np.where(own[np.minimum(at, len(own) - 1)] == y, at, len(own))
    text = np.full((int(steps.max()), n), len(own), np.int32)
    text[np.arange(len(y)) - np.repeat(np.cumsum(steps) - steps, steps), of_y] = y
    end, last = (size - 1) >> 6, one << ((size - 1) & 63).astype(U)
    up, down = np.full((n, words), ~U(0)), np.zeros((n, words), U)
    out, score, row, line = np.empty(n, np.int64), size.astype(np.int64), np.arange(n), np.arange(n)
    number = np.arange(words, dtype=U)
    power = one << number
    for j in range(len(text)):
        if not j % LOOK:
            going = (steps > j) & (score - (steps - j) <= most)
            if 4 * np.count_nonzero(going) <= 3 * len(row):
                out[row] = score
                row, score, steps, most, end, last, up, down = (v[going] for v in (row, score, steps, most, end, last, up, down))
                line = np.arange(len(row))
                if not len(row):
                    break
        eq = equal[text[j, row]]
        xh = eq & up
        total = xh + up
        if words > 1:
            # carries between the 64-bit numbers: those that overflow, and those that hand one on
            made, passed = (total < xh) @ power, (total == ~U(0)) @ power
            total += (((made << one) + passed) ^ passed)[:, None] >> number & one
        total ^= up
        total |= eq
        eq |= down
        ph = total | up
        np.invert(ph, out=ph)
        ph |= down
        mh = np.bitwise_and(up, total, out=total)
        live = j < steps
        score += live & ((ph[line, end] & last) != 0)
        score -= live & ((mh[line, end] & last) != 0)
        over, under = ph[:, :-1] >> top, mh[:, :-1] >> top
        ph <<= one
        mh <<= one
        ph[:, 1:] |= over
        mh[:, 1:] |= under
        ph[:, 0] |= one
        np.bitwise_or(eq, ph, out=up)
        np.invert(up, out=up)
        up |= mh
        np.bitwise_and(ph, eq, out=down)
    out[row] = score
    return out


#: Pairs that are compared at once, and 64-bit numbers of a line; longer ones go one by one,
#: as do fewer than FEW pairs. Steps after which it is looked which pairs are settled.
PAIRS, NUMBERS, FEW, LOOK = 2048, 32, 24, 32


def distances(pairs: list[tuple[Sequence, Sequence, int]]) -> np.ndarray:
    """Edit distances of pairs (shorter, longer, most), those of like length together; above
    `most` some number above it."""
    out = np.array([len(y) for _, y, _ in pairs], np.int64)
    order = sorted((-(-len(x) // 64), len(y), k) for k, (x, y, _) in enumerate(pairs) if len(x))
    sizes, at = [o[0] for o in order], 0
    while at < len(order):
        # those of up to twice as many numbers go along
        to = min(at + max(FEW, 8 * PAIRS // sizes[at]), at + PAIRS, bisect_right(sizes, 2 * sizes[at]))
        if sizes[to - 1] > NUMBERS or to - at < FEW:
            to = min(to, bisect_right(sizes, sizes[at]))
            for _, _, k in order[at:to]:
                out[k] = edit_distance(*pairs[k])
        else:
            ks = [o[2] for o in order[at:to]]
            short, long, most = zip(*(pairs[k] for k in ks))
            out[ks] = edit_distances(short, long, np.array(most))
        at = to
    return out


def similar_pairs(a: list[str], b: list[str], least: float = SIMILAR, likely: bool = True) -> np.ndarray:
    """similar_lines of many pairs. Where most are likely to be similar, and for the longest
    lines, words are compared first, which settles many."""
    out = np.zeros(len(a), bool)
    rest: list[tuple[int, str, str, int]] = []
    for k, (x, y) in enumerate(zip(a, b)):
        most = most_edits(x, y, least)
        if abs(len(x) - len(y)) > most:
            continue
        x, y = sorted(_trimmed(x, y), key=len)
        if len(y) <= most or not x:
            out[k] = len(y) <= most
        else:
            rest.append((k, x, y, most))
    asked = [r for r in rest if likely or len(r[1]) > 64 * NUMBERS]
    out[np.array([r[0] for r in asked], np.int64)] = _by_words([r[1:] for r in asked])
    rest = [r for r in rest if not out[r[0]]]
    out[np.array([r[0] for r in rest], np.int64)] = distances([r[1:] for r in rest]) <= np.array([r[3] for r in rest], np.int64)
    return out


def _by_words(pairs: list[tuple[str, str, int]]) -> list[bool]:
    """Whether words alone show that a pair's distance is its `most` at most: no more characters
    change than the longest of as many words as change have, with a space each."""
    ids: dict[str, int] = {}
    sides, todo = [], []
    for x, y, most in pairs:
        v, w = sorted(_trimmed(x.split(" "), y.split(" ")), key=len)
        sides.append((v, w))
        todo.append(([ids.setdefault(t, len(ids)) for t in v], [ids.setdefault(t, len(ids)) for t in w], most))
    found = []
    for (v, w), (_, _, most), changed in zip(sides, todo, distances(todo).tolist()):
        found.append(changed <= most and sum(sorted(map(len, (*v, *w)), reverse=True)[:changed]) + changed <= most)
    return found


def most_edits(a: str, b: str, least: float = SIMILAR) -> int:
    """The greatest distance at which two lines are similar."""
    return math.floor((1 - least) * max(len(a), len(b)) + 1e-9)


def similar_lines(a: str, b: str, least: float = SIMILAR) -> bool:
    """Whether two lines' edit similarity, by characters, is at least `least`, at any length."""
    return bool(similar_pairs([a], [b], least)[0])


def _wanted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, payload): the normalised text of wanted lines (numbers and nodes by document)."""
    for batch in batches:
        lines, nodes = batch["lines"].to_pylist(), batch["nodes"].to_pylist()
        done = 0
        for first, last, data, at in chunks(batch["text"]):
            data, at = normalised(data, at)
            text, number, start, end = line_spans(data, at)
            begin = np.searchsorted(text, np.arange(last - first))
            out_n, out_t = [], []
            for k in range(last - first):
                for line, node in zip(lines[done + k], nodes[done + k]):
                    i = begin[k] + line
                    out_n.append(node)
                    out_t.append(data[start[i] : end[i]].tobytes().decode().strip(" "))
            done += last - first
            yield pa.RecordBatch.from_arrays([pa.array(out_n, pa.int64()), pa.array(out_t, pa.string())], names=["node", "payload"])


def _lines_of(documents: DataFrame, shortest: int) -> DataFrame:
    """doc_id, mark, line and key of the lines to remove, and of no others.

    mark: a hash of the text, which tells rows of one doc_id apart.
    """
    kind = "doc_id long, mark long, line int, key long, size int, " + ", ".join(f"{w} long" for w in SIGNATURE)
    lines = materialize(documents.mapInArrow(task("line_dedup", _line_batches(shortest)), kind), "lines")
    classes = materialize(
        lines.groupBy(F.col("key").alias("node")).agg(F.min(F.struct("doc_id", "mark", "line")).alias("at"), *(F.any_value(c).alias(c) for c in ("size", *SIGNATURE)), F.count("*").alias("n")), "line-classes"
    )

    def bucket(first: int = 0, count: int = BANDS):
        """A row for each of some bands, the bucket being the band's hash and number."""
        hashes = [F.shiftright(f"b{k // 2}", 32 * (k % 2)).bitwiseAND(0xFFFFFFFF) * MOST_BANDS + k for k in range(first, first + count)]
        return F.explode(F.array(*hashes)).alias("bucket")

    banded, edges = classes.where("b0 is not null"), None
    for first in range(0, BANDS, PASS):
        met = block_pairs(banded.select("node", "size", *SKETCH_WORDS, bucket(first, PASS)), ["bucket"], "node", BLOCK)
        part = materialize(met.mapInArrow(task("line_dedup", _forest_batches), "src long, dst long").distinct(), "line-edges")
        edges = part if edges is None else edges.unionByName(part)
        # the pass's shuffle files go when the driver drops what refers to them
        del met
        gc.collect()
        documents.sparkSession.sparkContext._jvm.System.gc()
    edges = materialize(edges.distinct(), "line-edges")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, payload) of a written table's nodes, read from their first occurrence."""
        wanted = classes.join(nodes, "node", "left_semi").groupBy(F.col("at.doc_id").alias("_d"), F.col("at.mark").alias("_m")).agg(
            F.collect_list("at.line").alias("lines"), F.collect_list("node").alias("nodes")
        )
        wanted = materialize(wanted, "wanted-lines")
        wanted = F.broadcast(wanted) if small_enough(wanted, "nodes", 12) else wanted
        texts = documents.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))).select("text", "lines", "nodes")
        return materialize(texts.mapInArrow(task("line_dedup", _wanted_batches), "node long, payload string").dropDuplicates(["node"]), "line-texts")

    def apart(edges: DataFrame, parts: DataFrame) -> DataFrame:
        a, b = (parts.select(F.col("node").alias(k), F.col("component").alias("c_" + k)) for k in ("src", "dst"))
        joined = edges.join(a, "src", "left").join(b, "dst", "left")
        return joined.where(F.coalesce("c_src", "src") != F.coalesce("c_dst", "dst")).select("src", "dst")

    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    texts = texts_of(materialize(ends.distinct(), "line-ends"))

    def confirmed(edges: DataFrame) -> DataFrame:
        return materialize(confirm_stars(edges, texts, "line_dedup", similar_pairs), "line-links")

    # every line to its least neighbour first: a group of like lines then is one component
    best = materialize(edges.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst"), "line-best")
    parts = materialize(connected_components(confirmed(best)), "line-parts")
    other = materialize(apart(edges.join(best, ["src", "dst"], "left_anti"), parts), "line-edges")
    if not other.isEmpty():
        parts = materialize(merged_components(parts, confirmed(other)), "line-parts")
    failed = materialize(apart(edges, parts), "line-failed")
    if not failed.isEmpty():
        ends = failed.select(F.col("src").alias("node")).unionByName(failed.select(F.col("dst").alias("node"))).distinct()
        touched = ends.join(parts, "node", "left").select(F.coalesce("component", "node").alias("component")).distinct()
        again = banded.select("node", "size", *SIGNATURE).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        again = materialize(again.join(touched, "component", "left_semi"), "line-again").select("*", bucket())
        suspects = materialize(block_pairs(again.select("node", "size", *SKETCH_WORDS, "component", "bucket"), ["bucket"], "node").mapInArrow(task("line_dedup", _suspect_batches), "bucket long, node long").distinct(), "line-suspects")
        unit = again.join(suspects, ["bucket", "node"]).join(texts, "node")
        more = materialize(block_pairs(unit, ["bucket"], "node", LINKED_BLOCK).mapInArrow(task("line_dedup", _linked_batches), "src long, dst long").distinct(), "line-links")
        if not more.isEmpty():
            parts = materialize(merged_components(parts, more), "line-parts")
    grouped = classes.join(parts, "node", "left").select("node", "at", "n", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked"))
    firsts = grouped.where("linked").groupBy("component").agg(F.min("at").alias("keep"))
    # a class that stands alone keeps its first; without a second line there is nothing to remove
    several = grouped.where("linked or n > 1").join(firsts, "component", "left").select(F.col("node").alias("key"), F.coalesce("keep", "at").alias("keep"))
    several = materialize(several, "line-keep")
    own = F.struct("doc_id", "mark", "line")
    return lines.select("doc_id", "mark", "line", "key").join(several, "key").where(~own.eqNullSafe(F.col("keep"))).select("doc_id", "mark", "line").distinct()


def _marked(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))


def duplicate_lines(documents: DataFrame, shortest: int = MIN_WORDS) -> DataFrame:
    """doc_id, line: the lines to remove, numbered from 0; all but the first of each group.

    Lines are normalised; those of `shortest` words or more or of MIN_CHARS characters count,
    and a line without a word never does. Those of fewer than MIN_WORDS words and MIN_CHARS
    characters only equal others exactly. Equal lines form a class,
    represented by its first occurrence by (doc_id, line). Classes meet in the buckets of
    BANDS bands of ROWS MinHashes each, of n-grams; a unit of a bucket gives a spanning forest of
    its close pairs, which are confirmed on the lines by edit similarity, each line's with its least neighbour first. Where pairs
    fail and leave components apart, these components' lines meet once more: those that are
    close to a line of another component come with their texts, in bounded units, and every
    close pair between components is compared. So no link between lines that share a band
    and have close sketches is lost, close pairs are never listed, and which lines are
    linked doesn't depend on the other lines of the table. A class is told by 64 bits of its hash.

    Null and empty texts have no lines that count. A null doc_id is an id that comes before
    all others. Rows that share doc_id and text count as one document; rows that share a
    doc_id alone are ordered by a hash of the text. Ties can't occur otherwise. An empty
    table gives an empty result.
    """
    return _lines_of(_marked(documents), shortest).select("doc_id", "line").distinct()


def dedup_lines(documents: DataFrame, shortest: int = MIN_WORDS) -> DataFrame:
    """documents with n_lines, n_removed and text without duplicate lines (see duplicate_lines).

    A text keeps its other lines, joined by line feeds as they were; a null text stays null
    with no lines. All columns and rows of the input stay, whatever their names, except that
    n_lines and n_removed are replaced where it has them. Removed lines' numbers are
    broadcast where they take some tens of megabytes at most, and otherwise meet the
    documents in a sorted join.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    removed = _lines_of(_marked(documents), shortest).groupBy("doc_id", "mark").agg(F.collect_list("line").alias("lines"))
    removed = materialize(removed, "removed")
    removed = (F.broadcast(removed) if small_enough(removed, "lines", 4) else removed).alias("_r")
    text = F.col("_d.text")
    same = F.col("_d.doc_id").eqNullSafe(F.col("_r.doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_r.mark"))
    joined = documents.alias("_d").join(removed, same, "left")
    split, lines = F.split(text, "\n"), F.col("_r.lines")
    kept = let(split, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), lines), lambda i: ls[i]), "\n"))
    return joined.select(
        *(F.when(lines.isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(f"_d.`{c}`") for c in names),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_removed"),
    )
