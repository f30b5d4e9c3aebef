"""BPE and packed token files against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from testquarry.llm import bpe, packed_tokens, wordsplit

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello, world! It's 2024; isn't it?", "naïve café — übermäßig 你好 🙂🙂", "a" * 900, "x\x1c\x1d y\x85z ​q", "<|endoftext|> end",
    "ab " * 3000, "é ́x ²³ Ⅷ", "don'T 'S 'll_x __a__",
]
DOCS = "doc_id long, text string, ids string, start int"


def documents(spark, texts=TEXTS):
    rows = [(i * 2, t, "x", 1) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DOCS)


def tik():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_pattern_is_the_published_one():
    assert wordsplit.BYTE_LEVEL == public_tokenizers.PATTERN


def test_encode_and_decode(spark):
    enc, _ = tik()
    got = {r.doc_id: r for r in bpe.encode_decode(documents(spark)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i * 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t or "")
        assert bytes(r.decoded) == (t or "").encode()
    d = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(documents(spark))).collect()}
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest() == d[0].decoded_sha256
    assert bpe.encode_decode(documents(spark, [])).count() == 0


def one_by_one(word, ranks):
    """The leftmost pair of least rank, again and again, by brute force."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def codec():
    c = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    c.open()
    yield c
    c.close()


def test_words_of_all_lengths(codec):
    enc, ranks = tik()
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeinrstü") for _ in range(n)) for n in (1, 2, 30, 63, 64, 65, 128, 200, 700, 3000)]
    words += [(c * 400)[:n] for c in ("a", "=", "é", "中", "ab", "abc", "aaab") for n in (64, 65, 190, 400)]
    for w, ids in zip(words, codec._merge(words)):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == enc.encode_ordinary(w), w[:20]
        if len(w) <= 200:
            assert got == one_by_one(w.encode(), ranks)
    # both forms of the recursion agree
    short = [w.encode() for w in words if len(w) < 300]
    assert all((a == b).all() for a, b in zip(codec._recursion(short), codec._recursion(short, bpe.RUNS_SQL)))


def test_very_long_texts_and_words(codec):
    import resource

    enc, _ = tik()
    base = "Some words, 12 numbers and naïve lines of text.\n" * 40
    text = base * (32_000_000 // len(base))
    ids = codec.encode([text])
    want = enc.encode_ordinary(base) * 2
    assert np.frombuffer(ids[0][: 4 * len(want)], "<u4").tolist() == want
    assert codec.decode(ids)[0] == text.encode()
    letters = "".join(c for c in open(__file__).read() if c.isalpha())
    word = (letters * (5_000_000 // len(letters) + 1))[:5_000_000]
    small = word[:20_000]
    assert np.frombuffer(codec.encode([small])[0], "<u4").tolist() == enc.encode_ordinary(small)
    got = codec.encode([word])
    assert codec.decode(got)[0] == word.encode()
    memory = codec.encode.__self__
    assert memory.size <= memory.half and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 8 << 20


def test_fast_split_equals_exact():
    import regex

    fast, exact = wordsplit.splitter(wordsplit.BYTE_LEVEL), regex.compile(wordsplit.BYTE_LEVEL.replace(r"\s\p", r"\p{White_Space}\p").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("ab é'st12_ \n\t-.!²x \x1c") for _ in range(40))
        assert [w for part in fast(t) for w in part] == exact.findall(t)


def test_word_memory_is_bounded_and_stays_right():
    calls = []
    m = wordsplit.WordMemory(lambda t: iter([t.split()]), lambda ws: calls.append(len(ws)) or [w.encode() for w in ws], most=4000)
    for k in range(50):
        texts = [f"a b w{k} v{k}", "a", "z" * 900]
        assert m.encode(texts) == [t.replace(" ", "").encode() for t in texts]
        assert m.size <= m.half and "z" * 900 not in m.young
    assert sum(calls) < 50 * 4 + 50


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = packed_tokens.pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and (packed_tokens.unpack(data, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [15, 16])
def test_file_has_random_access(tmp_path, bits, monkeypatch):
    from pyarrow.fs import FileSystem

    monkeypatch.setattr(packed_tokens, "BLOCK", 100)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (1, 250, 99, 1, 100, 730)]
    fs, base = FileSystem.from_uri(f"file://{tmp_path}")
    with fs.open_output_stream(f"{base}/x") as sink:
        w = packed_tokens.Writer(sink, bits)
        for i, d in enumerate(docs):
            w.add(np.array([i]), np.array([len(d)]), d)
        assert w.close() == (6, sum(map(len, docs)))
    with fs.open_input_file(f"{base}/x") as f:
        r = packed_tokens.Reader(f)
        for i in (5, 0, 3, 1, 4, 2):
            assert (r.document(i) == docs[i]).all()


def test_written_and_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + ["a <|endoftext|> b", "word " * 100_000] + [f"document number {i} " * (i % 5) for i in range(40)]
    got = {r.doc_id: r for r in packed_tokens.packed_tokens(documents(spark, texts), str(tmp_path)).collect()}
    at = 0
    for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        ids = [*e.ids, 0]
        r = got[i * 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert list(tmp_path.glob("*.pktok"))
    assert packed_tokens.packed_tokens(documents(spark, []), str(tmp_path / "none")).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "b"), (None, None), (5, "x y"), (5, "x y"), (5, "z"), (-3, "")]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, _hash string").withColumn("_place", F.lit("p"))
    got = packed_tokens.packed_tokens(df, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["-3", "5", "5", "5", "None", "None"]
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered[:3]] == [None, None, -3]
    assert [r.start for r in ordered] == np.concatenate(([0], np.cumsum([r.n_tokens for r in ordered])[:-1])).tolist()
