"""The pipeline's stages against brute force on a small corpus with planted cases."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as P
from testquarry.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "so", "ne"], "bb": ["str", "ein", "sch", "ung", "be", "ver"]}


def corpus():
    rng = random.Random(4)

    def words(lang, n):
        return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n)]

    rows = []
    for i in range(120):
        lang = "ab"[i % 2] * 2
        rows.append([i, "\n".join(" ".join(words(lang, 12)) for _ in range(6)), lang, f"src{i % 6}"])
    rows.append([200, rows[3][1], "bb", "src3"])  # an exact copy
    near = rows[5][1].split()
    near[20] = "changed"
    rows.append([201, " ".join(near), "bb", "src1"])  # near, but no line alike
    rows.append([202, rows[7][1].split("\n")[2] + "\n" + " ".join(words("bb", 30)), "bb", "src2"])  # one line of another
    rows += [[203, "12345 !!", None, None], [204, None, "aa", "src1"], [205, "", None, "src2"]]
    return [(*r, len(r[1]) if r[1] else None, "extra") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mixing", "byte_bpe"] and P.ORACLE_SQL is None


def test_language_stage_keeps_clean_documents(spark, docs):
    out = P.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    assert set(by_id(docs)) - set(by_id(out)) == {203, 204, 205}


def test_line_stage(spark, docs):
    got = by_id(P.dedup_lines(spark, docs, ""))
    assert 200 not in got and set(by_id(docs)) - set(got) == {200}
    source = by_id(docs)
    assert got[202].text == source[202].text.split("\n")[1] and got[202].n_chars == len(got[202].text)
    assert all(got[i].text == source[i].text for i in range(120))


def test_document_stage(spark, docs):
    out = P.dedup_documents(spark, docs, "")
    assert set(by_id(docs)) - set(by_id(out)) == {200, 201} and out.columns == docs.columns


def test_mixing_stage(spark, docs):
    source, got = by_id(docs), by_id(P.mix_sources(spark, docs, ""))
    tokens = lambda rows: sum((len((r.text or "").encode()) + 3) // 4 for r in rows.values())
    assert set(got) < set(source) and all(got[i] == source[i] for i in got)
    assert 0.6 * tokens(source) < tokens(got) <= 0.9 * tokens(source)


def test_run_applies_all_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(P.run(spark, str(tmp_path)))
    assert not {200, 201, 203, 204, 205} & set(got) and len(got) > 80
    want = docs
    for _, stage in P.STAGES[:-1]:
        want = spark.createDataFrame(stage(spark, want, str(tmp_path)).collect(), SCHEMA)
    texts = by_id(want)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.decoded_sha256 == hashlib.sha256(texts[i].text.encode()).hexdigest()
        assert r.n_tokens > len(re.findall(r"\S+", texts[i].text)) // 2
    assert bpe.digests(bpe.encode_decode(docs.limit(0))).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_odd_tables(spark, docs, name):
    """Empty tables, repeated rows, very long texts, nulls in every column and columns that a result also has."""
    stage = dict(P.STAGES)[name]
    schema = SCHEMA + ", lang_pred string, n_lines int, n_removed int, shard int, copies int, `a.b` int"
    long = "kato miru sone " * 30_000
    base = corpus()[:40]
    rows = [(*r, "keep", 7, 8, 9, 10, i) for i, r in enumerate([*base, base[3], (None, base[4][1] + " tosone rumi", "aa", None, None, None), (500, long, "aa", "src1", len(long), "x"), (501, None, None, None, None, None)])]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, "")
    got = out.collect()
    if name == "byte_bpe":
        assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id == 501} == {0}
    else:
        assert out.columns == df.columns
        assert {(r.lang_pred, r.n_lines, r.n_removed, r.shard, r.copies) for r in got} == {("keep", 7, 8, 9, 10)}
        want = {r[-1]: r for r in rows}
        assert all(r["a.b"] in want and r.doc_id == want[r["a.b"]][0] for r in got)
        assert 500 in {r.doc_id for r in got} or name == "mixing"
    assert stage(spark, df.limit(0), "").count() == 0
