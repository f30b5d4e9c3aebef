"""Vectorised numpy kernels over the bytes of many texts at once; no Spark here."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Odd multipliers for the places of a shingle.
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_drops: list[Callable[[], None]] = []
_owner = [""]


def on_switch(drop: Callable[[], None]) -> None:
    """Register what forgets an operator's memory in a worker process."""
    _drops.append(drop)


def release() -> None:
    """Give freed memory back to the system: an idle worker should hold little."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def task(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run as an Arrow task of an operator. A worker process serves one operator after the
    other: when the operator changes, what the last one remembered is dropped, and memory
    that a task has freed goes back to the system when it ends."""

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _owner[0] not in ("", owner):
            for drop in _drops:
                drop()
        _owner[0] = owner
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return owned


_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=U)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs only give equal outputs."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the texts' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about limit bytes."""
    data, at = packed(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each text's first word (with the total at the end)."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(at), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _table("up", _BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _table("down", _BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(U))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, joined, and the sets' offsets.

    A text of fewer words than width has its whole sequence as one shingle; one without
    words has an empty set.
    """
    starts, ends, first = words(data, at)
    counts = np.diff(first)
    h = span_hashes(data, starts, ends)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    if not offsets[-1]:
        return np.zeros(0, U), offsets
    begin = np.repeat(first[:-1] - offsets[:-1], sizes) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, width), sizes)
    total = length.astype(U) * U(0x2545F4914F6CDD1D)
    for k in range(width):
        here = np.minimum(begin + k, len(h) - 1)
        total += np.where(k < length, mix(h[here] + _PLACES[k]) * _PLACES[k], U(0))
    total = mix(total)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a > 1:
            total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[offsets[:-1][sizes > 0]] = True
    seen = np.concatenate(([0], np.cumsum(new)))
    return total[new], seen[offsets]
