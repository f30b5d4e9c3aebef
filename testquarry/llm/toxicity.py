"""Toxicity of deobfuscated text: Viterbi over character lattices, then a word classifier."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernels import U, chunks, mix, span_hashes, task, words

#: Bound of the training sample: toxic and other documents, as expected.
TRAIN_TOXIC, TRAIN_OTHER = 2000, 3000
#: Bound of a training text; texts that are scored are whole.
TRAIN_BYTES = 1 << 18
#: Texts that a feature must be in to count.
MIN_DOCS = 4
SEED = 23
THRESHOLD = 0.7
#: Symbols of the character model: 0 for all that isn't a letter, a to z, other UTF-8 bytes.
SYMBOLS = 27 + 128

# fixed values: what a written character may stand for, besides itself
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c",
}
#: Costs, in nats: of reading a sign as a letter, of dropping a repeated letter in a run of three
#: or more and in one of two, a sign between letters, and a sign that may be a letter.
READ, REPEAT, DOUBLE, BETWEEN, SKIP = 1.5, 0.7, 4.0, 0.3, 9.0
#: Letters and signs in a row, each a word, that count as spaced out.
SPACED = 3
#: Bytes of the readings that a worker remembers, the longest span among them, and steps
#: after which a reading's certain part is read out.
MEMORY, LONGEST, WINDOW = 32 << 20, 200, 2048

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = _SYMBOL > 0
_ASCII = _LETTER & (np.arange(256) < 128)
_SIGN = np.isin(np.arange(256), [ord(c) for c in LEET])
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, _, data, at in chunks(batch["text"]):
            s = _SYMBOL[data]
            n = len(at) - 1
            padded = np.zeros(len(s) + 3 * n, np.int32)
            padded[np.arange(len(s)) + np.repeat(3 * np.arange(n) + 2, np.diff(at))] = s
            if len(padded) > 2:
                total += np.bincount((padded[:-2] * SYMBOLS + padded[1:-1]) * SYMBOLS + padded[2:], minlength=len(total))
    code = np.flatnonzero(total)
    if len(code):
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])


def character_costs(codes: np.ndarray, counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """(SYMBOLS, SYMBOLS, SYMBOLS) float32: -log of the interpolated trigram probabilities."""
    c3 = np.zeros(SYMBOLS**3, np.float32)
    c3[codes] = counts
    c3 = c3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2, c1 = c3.sum(0, dtype=np.float64), c3.sum((0, 1), dtype=np.float64)
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
    whole = c3.sum(2, keepdims=True) + np.float32(weight)
    c3 += (weight * p2).astype(np.float32)
    c3 /= whole
    return -np.log(c3, out=c3)


def character_model(documents: DataFrame) -> np.ndarray:
    """Costs from the trigrams of all texts: tasks count, a grouped sum adds; the driver gets
    SYMBOLS ** 3 sums at most, whatever the input."""
    sums = documents.select("text").mapInArrow(task("toxicity", _count_batches), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return character_costs(sums["code"].to_numpy(), sums["n"].to_numpy())


class SpanReader:
    """Reads spans under one character model, and remembers readings up to a bound in bytes.

    The memory belongs to the model: another model reads anew. It doesn't travel with it.
    """

    def __init__(self, costs: np.ndarray):
        self.costs = np.ascontiguousarray(costs, np.float32)
        self.flat = memoryview(self.costs.reshape(-1))
        self.known: dict[str, str] = {}
        self.size = 0

    def __reduce__(self):
        return SpanReader, (self.costs,)

    def read(self, span: str) -> str:
        """read_span of a lower-cased span without the punctuation that ends it."""
        got = self.known.get(span)
        if got is None:
            got = read_span(span.rstrip("!.,;:?\"')"), self.flat)
            if len(span) <= LONGEST:
                self.size += 200 + 4 * (len(span) + len(got))
                if self.size > MEMORY:
                    self.known, self.size = {}, 0
                self.known[span] = got
        return got


def _steps(span: str, i: int) -> list[tuple[str, float]]:
    """What the i-th character of a span may stand for, with costs."""
    c = span[i]
    if ord(c) > 127 or c.isalpha():
        return [(c, 0.0)] + ([("", REPEAT if c in (span[i - 2 : i - 1], span[i + 1 : i + 2]) else DOUBLE)] if i and c == span[i - 1] else [])
    if c in LEET:
        return [(x, READ) for x in LEET[c]] + [("", SKIP)]
    return [("", BETWEEN), (c, 0.0)]


def read_span(span: str, costs: memoryview) -> str:
    """The likeliest reading of a written span: a Viterbi path through its character lattice.

    A letter stands for itself, and may be dropped after another in a run. A sign stands for
    one of its letters or is dropped; other characters are dropped, or stay and part words.
    costs: flat, of three symbols each. Of two paths of equal cost that meet, the one that
    comes from the lesser state with the lesser letter stays. Time is linear in the span:
    steps keep back-pointers, and whatever all open paths share is read out every WINDOW steps.
    """
    # state: the last two symbols, as one number
    cost: dict[int, float] = {0: 0.0}
    back: list[dict[int, tuple[int, str]]] = []
    read: list[str] = []
    symbols: dict[str, list[int]] = {}

    def unwind(state: int, last: int) -> None:
        """Read out the steps before `last` on the path to a state there."""
        letters = []
        for step in reversed(back[:last]):
            state, letter = step[state]
            letters.append(letter)
        read.extend(reversed(letters))

    for i in range(len(span)):
        following: dict[int, float] = {}
        come: dict[int, tuple[int, str]] = {}
        steps = _steps(span, i)
        for letter, _ in steps:
            if letter not in symbols:
                symbols[letter] = [int(_SYMBOL[k]) for k in letter.encode()]
        for state, so_far in cost.items():
            for letter, step in steps:
                at, total = state, so_far + step
                for z in symbols[letter]:
                    total += costs[at * SYMBOLS + z]
                    at = at % SYMBOLS * SYMBOLS + z
                old = following.get(at)
                if old is None or total < old or (total == old and (state, letter) < come[at]):
                    following[at] = total
                    come[at] = (state, letter)
        cost = following
        back.append(come)
        if len(back) >= WINDOW:
            shared, k = set(cost), len(back)
            while len(shared) > 1 and k:
                k -= 1
                shared = {back[k][x][0] for x in shared}
            if k:
                unwind(shared.pop(), k)
                del back[:k]
    end = min(cost, key=lambda x: (cost[x] + costs[x * SYMBOLS], x))
    unwind(end, len(back))
    return "".join(read)


def suspicious(data: np.ndarray, at: np.ndarray, doubled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spans that may hide a word: words with a sign or digit beside a letter, with anything
    between letters, with a letter three times in a row (twice, if doubled), and runs of
    SPACED or more words of one letter or sign each."""
    starts, ends, first = words(data, at)
    if not len(starts):
        return starts, ends
    low = _LOWER[data]
    letter, n = _LETTER[data], len(data)
    after, prior = np.append(letter[1:], False), np.concatenate(([False], letter[:-1]))
    # an exclamation mark after a word ends it
    odd = (_SIGN[data] & (after | (prior & (data != 33))))
    double = np.zeros(n, bool)
    double[1:] = letter[1:] & (low[1:] == low[:-1]) & (data[1:] < 128)
    if not doubled:
        double[1:] &= double[:-1]
    begins = letter & ~prior

    def inside(mask: np.ndarray, margin: int = 0) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[ends] > sums[np.minimum(starts + margin, ends)]

    flagged = inside(odd) | inside(double, 1 if doubled else 2)
    runs = np.concatenate(([0], np.cumsum(begins)))
    flagged |= runs[ends] - runs[starts] + (letter[starts] & ~begins[starts]) >= 2
    letters = np.concatenate(([0], np.cumsum(letter)))
    flagged &= letters[ends] - letters[starts] >= 2
    single = (ends - starts == 1) & (_ASCII | _SIGN)[data[starts]]
    edge = np.zeros(len(starts) + 1, bool)
    edge[first] = True
    run = np.cumsum(~single | edge[:-1] | np.concatenate(([True], ~single[:-1])))
    size = np.bincount(run, single)[run]
    spaced = single & (size >= SPACED) & (np.bincount(run, single & letter[starts])[run] >= 2)
    head = spaced & np.concatenate(([True], (run[1:] != run[:-1]) | ~spaced[:-1]))
    tail = spaced & np.concatenate(((run[1:] != run[:-1]) | ~spaced[1:], [True]))
    a, b = np.concatenate((starts[flagged], starts[head])), np.concatenate((ends[flagged], ends[tail]))
    order = np.argsort(a)
    return a[order], b[order]


def restore(data: np.ndarray, at: np.ndarray, reader: SpanReader) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every suspicious span read; others as they are."""
    a, b = suspicious(data, at, doubled=True)
    if not len(a):
        return data, at
    pieces, delta, done = [], np.zeros(len(a), np.int64), 0
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        got = reader.read(data[i:j].tobytes().decode(errors="replace").lower())
        raw = got.encode()
        pieces += [data[done:i], np.frombuffer(raw, np.uint8)]
        delta[k], done = len(raw) - (j - i), j
    pieces.append(data[done:])
    shift = np.concatenate(([0], np.cumsum(delta)))
    return np.concatenate(pieces), at + shift[np.searchsorted(a, at)]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of letters and of its first four and five bytes."""
    low = _LOWER[data]
    inside, n = _LETTER[data], len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    text = np.searchsorted(at, starts, "right") - 1
    out_t, out_h = [text], [span_hashes(low, starts, ends)]
    for size in (4, 5):
        long = ends - starts > size
        out_t.append(text[long])
        out_h.append(mix(span_hashes(low, starts[long], starts[long] + size) + U(size)))
    return np.concatenate(out_t), np.concatenate(out_h)


@dataclass
class Model:
    reader: SpanReader
    known: np.ndarray  # sorted feature hashes
    weight: np.ndarray
    scale: tuple[float, float, float]  # of a text's largest weight, its sum, and 1

    def evidence(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, 2): the largest and the sum of the weights of a text's distinct features."""
        out = np.zeros((len(at) - 1, 2))
        text, h = features(data, at)
        if len(h) and len(self.known):
            place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[place] == h
            pairs = np.unique(text[hit] * len(self.known) + place[hit])
            t, w = pairs // len(self.known), self.weight[pairs % len(self.known)]
            np.maximum.at(out[:, 0], t, w)
            np.add.at(out[:, 1], t, w)
        return out

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = self.evidence(*restore(data, at, self.reader))
        z = self.scale[0] * x[:, 0] + self.scale[1] * np.log1p(x[:, 1]) + self.scale[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(texts: list[str], step: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i in range(0, len(texts), step):
        raw = [t.encode() for t in texts[i : i + step]]
        yield i, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def fit(texts: list[str], labels: list[int], reader: SpanReader) -> Model:
    """Weights are lower bounds (two deviations) of the features' log odds over documents;
    those below 1 are dropped. Two of three texts give the weights, the others the logistic
    scale, so that it is fitted on weights it did not shape."""
    y = np.array(labels, bool)
    tune = np.arange(len(y)) % 3 == 2
    hashes, owners = [], []
    for i, data, at in _parts(texts):
        text, h = features(*restore(data, at, reader))
        use = ~tune[text + i]
        text, h = text[use].astype(np.int32), h[use]
        order = np.lexsort((text, h))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        hashes.append(h[new])
        owners.append(y[text[new] + i])
    h, toxic = np.concatenate(hashes), np.concatenate(owners)
    del hashes, owners
    # a feature of fewer than MIN_DOCS texts can't reach a weight: drop what surely is one
    place = (h >> U(42)).astype(np.int32)
    often = np.bincount(place, minlength=1 << 22)[place] >= MIN_DOCS
    h, toxic = h[often], toxic[often]
    known, inverse = np.unique(h, return_inverse=True)
    pos = np.bincount(inverse, toxic, len(known))
    neg = np.bincount(inverse, ~toxic, len(known))
    n_pos, n_neg = (y & ~tune).sum(), (~y & ~tune).sum()
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    low = odds - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    keep = (low >= 1) & (pos + neg >= MIN_DOCS)
    model = Model(reader, known[keep], low[keep], (0.0, 0.0, 0.0))
    x = np.concatenate([model.evidence(*restore(data, at, reader)) for _, data, at in _parts([t for t, k in zip(texts, tune) if k])] or [np.zeros((0, 2))])
    x = np.column_stack((x[:, 0], np.log1p(x[:, 1]), np.ones(len(x))))
    t, w = y[tune].astype(float), np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - t) + 0.5 * w * [1, 1, 0]
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.5, 1e-3]), grad)
    model.scale = tuple(float(v) for v in w)
    return model


def training_rows(documents: DataFrame, labels: DataFrame, eligible: Column, seed: int = SEED) -> list:
    """Bounded sample (doc_id, text, toxic): labels are drawn by a hash of doc_id, and only the
    documents of those drawn are read out, one for each doc_id and TRAIN_BYTES of a text at
    most: the sample takes a bounded number of bytes however large the input. A doc_id with
    two labels counts as toxic; null ids and labels count for nothing."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(eligible)
    counts = dict(marks.groupBy("toxic").count().collect())
    space, draw, chosen = 1 << 30, F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)), F.lit(False)
    for value, most in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER)):
        if n := counts.get(value):
            chosen = chosen | ((F.col("toxic") == value) & (draw < int(space * min(1.0, most / n))))
    drawn = marks.where(chosen)
    text = F.substring("text", 1, TRAIN_BYTES // 4).alias("text")
    found = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text is not null")
    return found.groupBy("doc_id", "toxic").agg(F.min(text).alias("text")).collect()


def train(documents: DataFrame, labels: DataFrame, eligible: Column) -> Model:
    """A character model of all texts and a word model of a bounded sample of labelled ones."""
    reader = SpanReader(character_model(documents))
    rows = sorted(training_rows(documents, labels, eligible), key=lambda r: (r.doc_id, r.text))
    if not any(r.toxic for r in rows) or all(r.toxic for r in rows):
        return Model(reader, np.zeros(0, U), np.zeros(0), (0.0, 0.0, -3.0))
    return fit([r.text for r in rows], [r.toxic for r in rows], reader)


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; no shuffle.

    Null and empty texts get the score of a text without evidence. Without labels of both
    kinds every score is low. Repeated rows stay; other columns are dropped.
    """
    broad = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in chunks(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(broad.value.scores(data, at))], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(task("toxicity", run), "doc_id long, score double")


def restore_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and restored: every text with its suspicious spans read; null stays null."""
    broad = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in chunks(batch["text"]):
                data, at = restore(data, at, broad.value.reader)
                raw, null = data.tobytes(), batch["text"].slice(first, last - first).is_null().to_pylist()
                out = [None if x else raw[a:b].decode() for x, a, b in zip(null, at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return documents.select("doc_id", "text").mapInArrow(task("toxicity", run), "doc_id long, restored string")
