"""Near-duplicate operators against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from testquarry.llm import embedding_dedup, line_dedup, minhash_dedup
from testquarry.llm.common import connected_components
from testquarry.llm.textkernels import chunks, shingle_sets

WORDS = [f"word{i}" for i in range(300)]


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(70)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got, one = ({r.node: r.component for r in connected_components(df, task_edges=n).collect()} for n in (0, 10_000))
    assert got == one
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_texts():
    rng = random.Random(5)
    out = [None, "", "  \n", "One two", "one TWO", "one two three", "É é", "é é"]
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.choice([6, 12, 40, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy + ["tail"] * rng.randrange(2)).title())
    chain = [rng.choice(WORDS) for _ in range(200)]
    out += [" ".join(chain[k * 20 : k * 20 + 100]) for k in range(5)]  # each like the next, not all alike
    return out


def test_sets_of_shingles():
    import pyarrow as pa

    texts = near_texts()
    sizes = []
    for _, _, data, at in chunks(pa.array(texts), 300):
        low = minhash_dedup.lower_ascii(data)
        sizes += np.diff(shingle_sets(low, at)[1]).tolist()
    assert sizes == [len(shingles(t)) for t in texts]


def test_near_duplicates(spark):
    texts = near_texts()
    df = spark.createDataFrame([(i * 3, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1)], "doc_id long, text string, kept string, bands int")
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(df).collect()}
    sets = {i * 3: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_link_beside_the_star_is_found(spark, monkeypatch):
    """a - b and b - c are links, a - c is not; with every document in one bucket the star of a alone would lose c."""
    base = [f"v{i}" for i in range(100)]
    a, b, c = base[:], base[7:] + [f"x{i}" for i in range(7)], base[14:] + [f"x{i}" for i in range(14)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((a, b, c))], "doc_id long, text string")
    sets = [shingles(" ".join(t)) for t in (a, b, c)]
    alike = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    assert {r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == {0}


def test_sketch_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        n = int(rng.integers(12, 60))
        shared = rng.integers(0, 2**63, n * 3).astype(np.uint64)
        x, y = np.sort(np.append(shared, rng.integers(0, 2**63, n // 2).astype(np.uint64))), np.sort(np.append(shared, rng.integers(0, 2**63, n - n // 2).astype(np.uint64)))
        sk = minhash_dedup.sketches(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
        met += (minhash_dedup._band_hashes(sk)[0] == minhash_dedup._band_hashes(sk)[1]).any()
    assert met >= 297


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    v = [b + rng.standard_normal(16) * s for b in base for s in (0, 0.05, 0.3)]
    v += [base[0]] * 30 + [base[1] * 2.5] * 3
    return [x.astype(np.float32).tolist() for x in v] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, None] + [1.0] * 14, []]


def test_near_vectors(spark):
    rows = [(i + 10, v, "x", 5) for i, v in enumerate(vectors())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, mark string, links int")
    good = {i: np.array(v, float) for i, v, _, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in combinations(good, 2) if good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.95]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, recall=0.99999).collect()}
    want = components([r[0] for r in rows], links)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_large_buckets_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup.block_pairs, "__defaults__", (16,))
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    df = spark.createDataFrame([(i, (base + 0.01 * rng.standard_normal(8)).tolist()) for i in range(100)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()} == {(99, 0)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_of_many_pairs_equal_the_plain_ones():
    rng = random.Random(9)
    pairs = []
    for k in range(300):
        a = "".join(rng.choice("abc 語") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 150])))
        b = "".join(rng.choice("abz") if rng.random() < 0.1 * (k % 5) else c for c in a if rng.random() > 0.1) + "é" * (k % 3)
        a, b = sorted((a, b), key=len)
        pairs.append((a, b, len(b) // 4))
    pairs.append(("", "", 0))
    plain = [distance(a, b) for a, b, _ in pairs]
    assert line_dedup.distances([(a, b, 10**6) for a, b, _ in pairs]).tolist() == plain
    assert line_dedup.distances([([*map(ord, a)], [*map(ord, b)], 10**6) for a, b, _ in pairs]).tolist() == plain
    # above `most` any number above it will do
    for (_, _, most), d, got in zip(pairs, plain, line_dedup.distances(pairs).tolist()):
        assert got == d if d <= most else got > most
    for a, b, most in pairs:
        assert (line_dedup.edit_distance(a, b, most) <= most) == (distance(a, b) <= most)
    assert line_dedup.distances([]).tolist() == [] and line_dedup.similar_pairs([], []).tolist() == []


def test_edit_distance_and_similarity():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(40))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == distance(a, b)
        b = "".join(c for c in a if rng.random() > 0.15)
        assert line_dedup.similar_lines(a, b) == (distance(a, b) <= int(0.25 * max(len(a), len(b)) + 1e-9))


def test_normalised_lines():
    raw = "A, B!!  C 12-345\n\nÉx\tY".encode()
    data, at = line_dedup.normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert data.tobytes().decode() == "a b c 0 0\n\nÉx y" and at.tolist() == [0, len(data)]


def test_duplicate_lines(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    near = base.replace("quick", "quack")
    other = "entirely different content stands here in this line of text now"
    rows = [
        (5, f"{base}\nshort one\n{other}"), (3, f"intro words only here please\n{base.upper()}\nshort one"), (9, f"{near}\nshort one\n\n{other}!"),
        (4, None), (6, ""), (7, f"{other}\n{other}"), (3, f"intro words only here please\n{base.upper()}\nshort one"),
    ]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, line string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[3].text == rows[1][1] and got[5].text == f"short one\n{other}" and got[9].text == "short one\n"
    assert got[7].text == "" and got[7].n_removed == 2 and got[4].text is None and got[4].n_lines == 0 and got[6].text == ""
    assert got[5].n_lines == 3 and line_dedup.dedup_lines(df).count() == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def prose(rng, vocabulary, n):
    return [rng.choice(vocabulary) for _ in range(n)]


def near_lines():
    """(line, copy with a share of its words replaced) for shares of 2 to 15 %."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(2000)]
    out = []
    for share in (0.02, 0.05, 0.1, 0.15):
        for _ in range(50):
            a = prose(rng, vocabulary, rng.randrange(10, 60))
            b = a[:]
            for i in rng.sample(range(len(a)), max(1, round(share * len(a)))):
                b[i] = rng.choice(vocabulary)
            out.append((share, " ".join(a), " ".join(b)))
    return out, [" ".join(prose(rng, vocabulary, rng.randrange(5, 40))) for _ in range(4000)]


def test_lines_against_all_pairs_by_edit_similarity(spark):
    """The truth enumerates all pairs of lines by edit similarity alone; unrelated documents change no link."""
    near, others = near_lines()
    lines = [x for _, a, b in near for x in (a, b)]
    truth = set()
    for i, j in combinations(range(len(lines)), 2):
        a, b = lines[i], lines[j]
        most = int(0.25 * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) <= most and line_dedup.edit_distance(a, b) <= most:
            truth.add((i, j))
    assert sum(j == i + 1 and i % 2 == 0 for i, j in truth) >= 195
    few = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.duplicate_lines(few).collect()}
    for share in (0.02, 0.05, 0.1, 0.15):
        want = [j for (i, j) in truth if i % 2 == 0 and j == i + 1 and near[i // 2][0] == share]
        assert sum(j in got for j in want) >= 0.9 * len(want), share
    # nothing but linked lines goes
    assert got <= {j for _, j in truth}
    many = spark.createDataFrame(list(enumerate(lines + others)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.duplicate_lines(many).collect() if r.doc_id < len(lines)} == got


def test_links_are_those_of_the_candidates(spark):
    """Against the operator's own candidates: each pair that shares a band and is close is linked if its lines are similar."""
    import pyarrow as pa

    rng = random.Random(10)
    lines = []
    for _ in range(60):
        base = prose(rng, WORDS, rng.randrange(6, 40))
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = base[:]
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            lines.append(" ".join(copy))
    rng.shuffle(lines)
    rows = [(i // 4, i % 4, x) for i, x in enumerate(lines)]
    docs = defaultdict(list)
    for d, _, x in rows:
        docs[d].append(x)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(df).collect()}
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _, _ in rows]), "mark": pa.array([0] * len(rows)), "text": lines})
    (out,) = line_dedup._line_batches()([batch])
    bands = np.stack([out[w].to_numpy() for w in line_dedup.BAND_WORDS], 1).view(np.uint32)
    w0, w1 = (out[w].to_numpy().astype(np.uint64) for w in line_dedup.SKETCH_WORDS)

    def agreed(i, j):
        return sum(int(w[i]) >> 3 * k & 7 == int(w[j]) >> 3 * k & 7 for w in (w0, w1) for k in range(18))

    words = [re.sub("[0-9]+", "0", x) for x in lines]
    links = [
        (i, j) for i, j in combinations(range(len(rows)), 2)
        if words[i] == words[j] or ((bands[i] == bands[j]).any() and agreed(i, j) >= line_dedup.LEAST_AGREED and line_dedup.similar_lines(words[i], words[j]))
    ]
    want = components(range(len(rows)), links)
    assert got == {rows[i][:2] for i in want if want[i] != i}


def test_long_lines_are_compared_by_characters():
    rng = random.Random(13)
    a = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(1500))
    typos = "".join("z" if rng.random() < 0.2 else c for c in a)
    assert line_dedup.similar_lines(a, typos) and not line_dedup.similar_lines(a, a[: int(len(a) * 0.74)])
    assert not line_dedup.similar_lines(a, "".join("z" if rng.random() < 0.3 else c for c in a))


def test_line_stage_handles_null_ids_repeated_rows_and_clashing_names(spark):
    same = "a line of seven or more words here"
    rows = [(None, f"{same}\nfirst of nobody", 1, "x"), (2, same, 2, "y"), (2, f"other words stand in this second row\n{same}", 3, "z"), (2, same, 2, "y"), (7, None, 4, "q"), (8, "\n" * 5 + "word " * 40_000, 5, "long"), (9, "word " * 40_000, 6, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int, lines string").withColumn("_removed", F.lit(1)).withColumn("_doc", F.lit(2))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = sorted((r.doc_id or -1, r.text, r.mark, r.lines) for r in out.collect() if r.text is not None)
    assert got == sorted([
        (-1, f"{same}\nfirst of nobody", 1, "x"), (2, "", 2, "y"), (2, "other words stand in this second row", 3, "z"), (2, "", 2, "y"),
        (8, "\n" * 5 + "word " * 40_000, 5, "long"), (9, "", 6, "long"),
    ])
    assert out.where("text is null").count() == 1


def test_typos_are_found(spark):
    a = "several people walked slowly through green gardens yesterday before sunset"
    b = a.replace("walked", "wolked").replace("gardens", "gurdens")
    df = spark.createDataFrame([(k * 2 + i, f"{t} {chr(97 + k) * 6}") for k in range(20) for i, t in enumerate((a, b))], "doc_id long, text string")
    assert {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(df).collect()} == {(i, 0) for i in range(1, 40)}


def test_short_lines_and_lines_without_spaces(spark):
    han = "".join(chr(0x4E00 + 37 * k % 2000) for k in range(40))
    rows = [(1, f"Yes\n\n---\n{han}\n你好"), (2, f"yes!\n\n---\n{han}\n你好\nno"), (3, f"Yes sir\n{han[:20]}们{han[21:]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(df, shortest=1).collect()}
    assert got == {(2, 0), (2, 3), (2, 4), (3, 1)}
