"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused
from .textkernels import U, chunks, mix, task

#: Bound of the training sample: documents of each language, and languages (most frequent first).
TRAIN_PER_LANG, MAX_LANGS = 400, 200
#: Bound of a training text; texts that are predicted are whole.
TRAIN_BYTES = 1 << 18
#: Hashed subwords (byte n-grams of lower-cased text), their buckets and dimensions.
ORDERS, BUCKETS, DIM = (2, 3, 4), 1 << 16, 8
#: Bytes scored at once, each with some 150 bytes of work space.
PIECE = 1 << 18
#: Passes over the sample, and steps at least; examples of a step; rates of the two layers.
EPOCHS, STEPS, BATCH, RATE, EMB_RATE = 4, 600, 256, 1.0, 100.0
SEED = 11
#: Least score that is ever accepted, and precision that accepted predictions must reach on the calibration rows.
LEAST_SCORE, PRECISION = 0.5, 0.995
#: Share of correctly recognised calibration rows that the bound may reject at most.
MOST_LOST = 0.01
UNKNOWN = "und"


def subwords(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of all n-grams inside texts, and each text's first of them."""
    n, last = len(data), np.repeat(at[1:], np.diff(at))
    for order in ORDERS:
        m = max(0, n - order + 1)
        code = np.full(m, U(order))
        for k in range(order):
            code = code * U(0x100000001B3) + data[k : k + m].astype(U)
        inside = np.arange(m) + order <= last[:m]
        seen = np.concatenate(([0], np.cumsum(inside)))
        yield (mix(code[inside]) & U(BUCKETS - 1)).astype(np.int64), seen[np.minimum(at, m)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, langs): the embeddings times the softmax's weights
    bias: np.ndarray
    heat: float  # logits are divided by it
    least: float  # accepted scores are at least this

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, langs) probabilities; the mean over a text's subwords is one lookup each."""
        total, count = np.zeros((len(at) - 1, len(self.langs))), np.zeros(len(at) - 1)
        for bucket, first in subwords(data, at):
            got = np.zeros((len(bucket) + 1, len(self.langs)))
            np.cumsum(self.table[bucket], axis=0, dtype=np.float64, out=got[1:])
            total += got[first[1:]] - got[first[:-1]]
            count += np.diff(first)
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.heat
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def _segments(data: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Offsets that cut every text whole into pieces of varied length, as training examples."""
    cuts = [at]
    for a, b in zip(at[:-1], at[1:]):
        steps = rng.choice([24, 48, 96, 192, 384], size=int(b - a) // 24 + 1)
        places = a + np.cumsum(steps)
        cuts.append(places[places < b])
    return np.unique(np.concatenate(cuts))


def fit(texts: list[str], labels: list[str], seed: int = SEED) -> Model:
    """Train on four fifths of the texts by minibatch gradient descent; calibrate on the rest.

    The temperature minimises the log loss of the calibration texts. The rejection bound is
    the least score above which accepted calibration texts are right in PRECISION of cases;
    it is LEAST_SCORE at least, and no more than nine of ten right texts exceed.
    """
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    hold = order[: len(texts) // 5]
    train = order[len(texts) // 5 :] if len(texts) >= 10 else order
    raw = [t.lower().encode() for t in texts]
    y = np.array([langs.index(x) for x in labels], np.int64)

    def join(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [raw[i] for i in rows]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    data, at = join(train)
    cut = _segments(data, at, rng)
    owner = y[train][np.searchsorted(at, cut[:-1], "right") - 1]
    per_order = list(subwords(data, cut))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(owner))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for start in np.arange(0, len(owner), BATCH)[rng.permutation(-(-len(owner) // BATCH))]:
            # texts were permuted, so a run of segments is a mixed batch
            part = slice(start, min(start + BATCH, len(owner)))
            idx = np.concatenate([b[f[part.start] : f[part.stop]] for b, f in per_order])
            sizes = [np.diff(f[part.start : part.stop + 1]) for _, f in per_order]
            seg = np.concatenate([np.repeat(np.arange(part.stop - part.start), s) for s in sizes])
            n = np.maximum(sum(sizes), 1).astype(np.float32)
            b = part.stop - part.start
            hidden = np.stack([np.bincount(seg, emb[idx, d], b) for d in range(DIM)], 1).astype(np.float32) / n[:, None]
            logits = hidden @ w + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), owner[part]] -= 1
            back = (p @ w.T) / n[:, None]
            w -= rate * (hidden.T @ p) / b
            bias -= rate * p.mean(0)
            for d in range(DIM):
                emb[:, d] -= rate * EMB_RATE * np.bincount(idx, back[seg, d], BUCKETS).astype(np.float32) / b
    model = Model(langs, (emb @ w).astype(np.float32), bias.astype(np.float64), 1.0, LEAST_SCORE)
    if len(hold) >= 2:
        data, at = join(hold)
        truth = y[hold]
        logits = np.log(np.maximum(model.scores(data, at), 1e-300))
        best = None
        for heat in np.geomspace(0.2, 5, 33):
            z = logits / heat
            z -= z.max(1, keepdims=True)
            loss = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean()
            if best is None or loss < best[0] - 1e-9:
                best = (loss, float(heat))
        model.heat = best[1]
        p = model.scores(data, at)
        top, right = p.max(1), p.argmax(1) == truth
        for least in np.concatenate(([0.0], np.sort(top))):
            if right[top >= least].mean() >= PRECISION:
                break
        model.least = max(model.least, float(min(least, np.quantile(top[right], MOST_LOST) if right.any() else 0.0)))
    return model


def training_rows(documents: DataFrame, eligible: Column, per_lang: int = TRAIN_PER_LANG, seed: int = SEED) -> list:
    """About per_lang rows (text, lang) of each language, chosen by a hash of doc_id, one for each
    doc_id and language and TRAIN_BYTES of a text at most: bounded in bytes however large the
    input. Rows without a doc_id aren't learned from. Counting reads no text."""
    able = documents.where(eligible & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return []
    space = 1 << 30
    draw, chosen = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(space)), F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (draw < int(space * min(1.0, per_lang / r["n"]))))
    drawn = able.where(chosen & F.col("text").isNotNull()).groupBy("doc_id", "lang").agg(F.min(F.substring("text", 1, TRAIN_BYTES // 4)).alias("text"))
    return drawn.select("doc_id", "text", "lang").collect()


def train(documents: DataFrame, eligible: Column | None = None, per_lang: int = TRAIN_PER_LANG) -> Model | None:
    """A model from a bounded sample of the eligible documents; None without labelled text."""
    rows = sorted(training_rows(documents, F.lit(True) if eligible is None else eligible, per_lang), key=lambda r: (r.doc_id, r.lang, r.text))
    rows = [r for r in rows if any(c.isalpha() for c in r.text)]
    return fit([r.text for r in rows], [r.lang for r in rows]) if rows else None


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with lang_pred, lang_score and lang_rejected; no shuffle.

    A null text, or one without a letter, is UNKNOWN with score 0 and rejected, as is
    everything where there is no model. Otherwise lang_pred is the likeliest language, the
    score its calibrated probability, and it is rejected below the model's bound. Columns
    of the input of these three names are replaced; all others stay, whatever their names.
    Repeated rows stay; an empty table gives an empty result.
    """
    names = [c for c in documents.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    plain = documents.select(*names)
    if model is None:
        return plain.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0), "lang_rejected": F.lit(True)})
    broad = documents.sparkSession.sparkContext.broadcast(model)

    low_name, letter_name = (unused(c, documents.columns) for c in ("low", "letter"))
    schema = plain.schema.add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broad.value
        for batch in batches:
            parts = [m.scores(data, at) for _, _, data, at in chunks(batch[low_name], PIECE)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(m.langs)))
            letter = batch[letter_name].to_numpy(zero_copy_only=False).astype(bool)
            score = np.where(letter, p.max(1), 0.0)
            lang = np.array(m.langs, object)[p.argmax(1)]
            lang[~letter] = UNKNOWN
            cols = [batch[c] for c in names] + [pa.array(lang, pa.string()), pa.array(score), pa.array(~letter | (score < m.least))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return plain.withColumns({low_name: low, letter_name: F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")}).mapInArrow(task("langid", run), schema)
