"""Language ID and toxicity: held-out accuracy on made text, odd inputs, deobfuscation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from testquarry.llm import langid, toxicity

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["str", "ein", "sch", "ung"], "cc": ["éa", "oui", "ç", "eau"]}
SCHEMA = "doc_id long, text string, lang string, lang_pred int"


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [(i, sentence(rng, lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(list(SYLLABLES) * 100)]


def test_language_is_learned(spark, texts):
    docs = spark.createDataFrame([(*r, 1) for r in texts], SCHEMA)
    held = F.col("doc_id") % 5 == 0
    model = langid.train(docs, ~held)
    odd = spark.createDataFrame([(900, None, "aa", 1), (901, "", None, 1), (902, "12 + 3 !?", "bb", 1), (903, "kato " * 40_000, "aa", 1), (None, "kato mi", None, 1)], SCHEMA)
    got = langid.identify(docs.where(held).union(odd), model).collect()
    known = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.lang_pred == r.lang for r in known]) >= 0.97 and np.mean([r.lang_rejected for r in known]) <= 0.03
    rest = {r.doc_id: r for r in got if r not in known}
    for i in (900, 901, 902):
        assert (rest[i].lang_pred, rest[i].lang_score, rest[i].lang_rejected) == ("und", 0.0, True)
    assert rest[903].lang_pred == rest[None].lang_pred == "aa" and all(0 <= r.lang_score <= 1 for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "lang_score", "lang_rejected"}


def test_training_is_repeatable_and_reads_no_labels_of_held_out_rows(spark, texts):
    docs = spark.createDataFrame([(*r, 1) for r in texts], SCHEMA)
    swapped = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "aa").otherwise(F.col("lang")))
    a, b = (langid.train(d.repartition(n), F.col("doc_id") % 5 != 0) for d, n in ((docs, 1), (swapped, 5)))
    assert a.langs == b.langs and (a.table == b.table).all() and a.least == b.least


def test_without_labels_everything_is_unknown(spark):
    docs = spark.createDataFrame([(1, "kato", None, 1)], SCHEMA)
    model = langid.train(docs)
    assert model is None and langid.identify(docs, model).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_the_batch(texts):
    model = langid.fit([t for _, t, _ in texts], [lang for _, _, lang in texts])
    raw = [t.encode() for _, t, _ in texts[:20]]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    together = model.scores(np.frombuffer(b"".join(raw), np.uint8), at)
    for k, r in enumerate(raw):
        assert np.allclose(model.scores(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0], together[k])


BAD = ["worthless", "horrible", "rotten"]


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(rng, "aa", rng.randrange(8, 50)).split()
        if toxic := rng.random() < 0.3:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled(600, 2)
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(0, 0, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    return toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)


def test_toxic_texts_are_found(spark, model):
    rows = labelled(300, 7)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    right = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows]
    assert np.mean(right) >= 0.97 and got[900] == got[901] < 0.5 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("written", ["w0rthl3ss", "w o r t h l e s s", "w.o.r.t.h.l.e.s.s", "wooorthless", "h0rr1ble", "r0773n"])
def test_obfuscated_words_are_restored(spark, model, written):
    plain = {"w": "worthless", "h": "horrible", "r": "rotten"}[written[0]]
    docs = spark.createDataFrame([(1, f"kato miru {written} kami"), (2, f"kato miru {plain} kami"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.restored for r in toxicity.restore_documents(docs, model).collect()}
    assert got[1] == got[2] == f"kato miru {plain} kami" and got[3] is None


def test_clean_spans_are_left_alone():
    text = "Call 555-0199, see https://a.b/c?d=1 at 10:30!! It is fine...  a I"
    data = np.frombuffer(text.encode(), np.uint8)
    a, b = toxicity.suspicious(data, np.array([0, len(data)]))
    spans = [text[i:j] for i, j in zip(a, b)]
    assert not {"Call", "fine...", "555-0199,", "10:30!!"} & set(spans)


def test_one_class_of_labels_gives_low_scores(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, F.lit(True))
    assert toxicity.score_documents(docs, m).first().score < 0.1


@pytest.mark.parametrize("written", ["h 0 r r i b l e", "r 0 t t e n", "worthle$$", "hor.rible", "rot-ten", "rootten", "worthlesss"])
def test_lightly_hidden_words_are_restored(spark, model, written):
    plain = {"w": "worthless", "h": "horrible", "r": "rotten"}[written[0]]
    raw = f"kato miru {written} kami".encode()
    data, at = toxicity.restore(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model.reader)
    assert data.tobytes().decode() == f"kato miru {plain} kami"


def every_reading(span, costs):
    """Least cost over all paths of the lattice, by exhaustive search."""
    S = toxicity.SYMBOLS
    best = None

    def walk(i, a, b, total, text):
        nonlocal best
        if i == len(span):
            total += float(costs[(a * S + b) * S])
            best = min(best, (total, text)) if best else (total, text)
            return
        for letter, step in toxicity._steps(span, i):
            x, y, t = a, b, total + step
            for k in letter.encode():
                z = int(toxicity._SYMBOL[k])
                t += float(costs[(x * S + y) * S + z])
                x, y = y, z
            walk(i + 1, x, y, t, text + letter)

    walk(0, 0, 0, 0.0, "")
    return best


def reading_cost(span, read, costs):
    """Least cost of the paths that read a span as `read`."""
    S = toxicity.SYMBOLS
    paths = {("", 0, 0): 0.0}
    for i in range(len(span)):
        new = {}
        for (text, a, b), total in paths.items():
            for letter, step in toxicity._steps(span, i):
                if not read.startswith(text + letter):
                    continue
                x, y, t = a, b, total + step
                for k in letter.encode():
                    z = int(toxicity._SYMBOL[k])
                    t += float(costs[(x * S + y) * S + z])
                    x, y = y, z
                key = (text + letter, x, y)
                new[key] = min(new.get(key, t), t)
        paths = new
    return min(t + float(costs[(a * S + b) * S]) for (text, a, b), t in paths.items() if text == read)


def test_viterbi_against_exhaustive_search(model, monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 4)
    rng = random.Random(3)
    for _ in range(150):
        span = "".join(rng.choice("aorstiéwh01357$@! .-") for _ in range(rng.randrange(1, 9)))
        got = toxicity.read_span(span, model.reader.flat)
        want = every_reading(span, model.reader.flat)
        assert abs(reading_cost(span, got, model.reader.flat) - want[0]) < 1e-6, span


def test_models_do_not_share_readings(model):
    rng = np.random.default_rng(1)
    other = toxicity.SpanReader(rng.random((toxicity.SYMBOLS,) * 3, np.float32) * 9)
    spans = [f"w0r{k}hl3$$" for k in range(5)]
    first = [model.reader.read(x) for x in spans]
    alone = [toxicity.read_span(x, other.flat) for x in spans]
    assert [other.read(x) for x in spans] == alone != first
    assert [model.reader.read(x) for x in spans] == first


def test_long_spans_are_read_in_linear_time(spark, model):
    import pickle
    import time

    began = time.time()
    got = model.reader.read("a1b2" * 50_000)
    assert len(got) >= 100_000 and time.time() - began < 60 and model.reader.size < toxicity.MEMORY
    assert not pickle.loads(pickle.dumps(model)).reader.known
    docs = spark.createDataFrame([(1, "kato " * 100_000 + "w0rthless h0rrible"), (2, "a1" * 5000), (None, "kato"), (1, None)], "doc_id long, text string")
    assert toxicity.score_documents(docs, model).count() == 4


def test_training_sample_is_bounded_by_ids_and_bytes(spark):
    docs = spark.createDataFrame([(1, "worthless")] * 500 + [(None, "kato")] * 500 + [(2, "mi " * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, F.lit(True))
    assert sorted((r.doc_id, r.toxic, len(r.text) <= toxicity.TRAIN_BYTES // 4) for r in rows) == [(1, 1, True), (2, 0, True)]
    tagged = docs.withColumn("lang", F.lit("aa"))
    found = langid.training_rows(tagged, F.lit(True))
    assert len(found) <= 2 and all(r.doc_id in (1, 2) and len(r.text) <= langid.TRAIN_BYTES // 4 for r in found)


def plain_scores(model, text):
    """The softmax over the mean of a text's subword rows, one n-gram at a time."""
    raw = text.encode()
    rows = []
    for order in langid.ORDERS:
        for k in range(len(raw) - order + 1):
            code = order
            for byte in raw[k : k + order]:
                code = (code * 0x100000001B3 + byte) & (1 << 64) - 1
            x = code
            x ^= x >> 33
            x = x * 0xFF51AFD7ED558CCD & (1 << 64) - 1
            x ^= x >> 33
            x = x * 0xC4CEB9FE1A85EC53 & (1 << 64) - 1
            x ^= x >> 33
            rows.append(model.table[x % langid.BUCKETS])
    z = (np.mean(rows, 0) if rows else np.zeros(len(model.langs))) + model.bias
    z = z / model.heat
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_against_a_plain_model(spark, texts):
    model = langid.fit([t for _, t, _ in texts], [lang for _, _, lang in texts])
    for text in [t for _, t, _ in texts[:15]] + ["k", "éa"]:
        raw = text.encode()
        assert np.allclose(model.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], plain_scores(model, text), atol=1e-4)
    df = spark.createDataFrame([(1, "kato mi", "a", 2)], "doc_id long, text string, low string, letter int")
    row = langid.identify(df, model).first()
    assert (row.low, row.letter) == ("a", 2) and row.lang_pred == "aa"
