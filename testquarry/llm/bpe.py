"""Byte-level BPE by recursive DuckDB queries, one database per Python worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import on_switch, packed, task
from .wordsplit import WordMemory, splitter

#: Bytes of text, and token rows, that one DuckDB call handles.
TEXT_BYTES = 1 << 20
#: Words of one recursive query, and bytes unless it is a single word.
QUERY_WORDS, QUERY_BYTES = 20_000, 1 << 18
#: Bytes of the pieces in which longer words are merged, tokens on either side of a joint
#: between pieces that are merged again to join them, and tokens that are decoded at once.
PIECE, JOINT, DECODED = 64, 6, 1 << 18

#: Each step joins the words' neighbouring tokens with the merges and contracts, in every
#: word that still has one, the leftmost pair of least rank. A word ends with its last step.
ENCODE_SQL = """
WITH RECURSIVE t(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM start_rows
  UNION ALL (
    WITH pair AS (
      SELECT step, word, pos, id, lead(id) OVER w AS nxt, lag(pos) OVER w AS before
      FROM t WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), best AS (
      SELECT p.word, min(m.id::BIGINT * 65536 + p.pos) AS b
      FROM pair p JOIN merges m ON m.l = p.id AND m.r = p.nxt GROUP BY p.word
    )
    SELECT p.step + 1, p.word, p.pos,
           CASE WHEN p.pos = b.b % 65536 THEN (b.b // 65536)::INTEGER ELSE p.id END
    FROM pair p JOIN best b USING (word)
    WHERE p.before IS DISTINCT FROM b.b % 65536
  )
)
SELECT word, id FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step)
ORDER BY word, pos
"""

#: The same for words in which pieces don't fall into step, such as long runs of a character:
#: a step contracts, from left to right, all pairs of least rank that don't overlap. That is
#: the same where no merge of the new token comes before it (many); else it takes one pair.
RUNS_SQL = """
WITH RECURSIVE t(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM start_rows
  UNION ALL (
    WITH pair AS (
      SELECT t.*, lead(id) OVER w AS nxt, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
      SELECT p.*, m.id AS got, m.many, min(m.id) OVER (PARTITION BY p.word) AS best
      FROM pair p LEFT JOIN merges m ON m.l = p.id AND m.r = p.nxt
    ), run AS (
      SELECT *, coalesce(got = best, false) AS cand, rn - row_number() OVER (PARTITION BY word, coalesce(got = best, false) ORDER BY pos) AS run FROM ranked WHERE best IS NOT NULL
    ), chosen AS (
      SELECT *, cand AND CASE WHEN many THEN row_number() OVER (PARTITION BY word, cand, run ORDER BY pos) % 2 = 1
                              ELSE row_number() OVER (PARTITION BY word, cand ORDER BY pos) = 1 END AS take FROM run
    ), kept AS (SELECT *, lag(take) OVER (PARTITION BY word ORDER BY pos) AS gone FROM chosen)
    SELECT step + 1, word, pos, CASE WHEN take THEN best ELSE id END FROM kept WHERE gone IS DISTINCT FROM true
  )
)
SELECT word, id FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step)
ORDER BY word, pos
"""

DECODE_SQL = """
SELECT doc, string_agg(tok, '' ORDER BY pos) AS txt
FROM token_rows JOIN vocab USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """l, r, id: every pair of tokens whose joined bytes are a token; its rank is that id."""
    rows = [
        (a, b, rank) for token, rank in ranks.items() for k in range(1, len(token))
        if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None
    ]
    return pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("l", "r", "id"), zip(*rows))})


class Codec:
    """Encoder and decoder of one worker; words already merged are remembered up to a bound in bytes."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.encode = WordMemory(splitter(pattern), self._merge).encode
        self.merges, self.vocab = merge_table(ranks), pa.table({"id": pa.array(ranks.values(), pa.int32()), "tok": [x.decode("latin-1") for x in ranks]})
        self.db = None

    def open(self) -> None:
        """A database in memory, for one partition; it never writes to disk."""
        import duckdb

        self.db = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '200MB'", "temp_directory = ''"):
            self.db.execute(f"SET {setting}")
        self.db.register("m_", self.merges)
        self.db.register("v_", self.vocab)
        self.db.execute("CREATE TABLE merges AS SELECT m.*, least(coalesce(a.low, m.id + 1), coalesce(b.low, m.id + 1)) > m.id AS many FROM m_ m LEFT JOIN (SELECT l, min(id) AS low FROM m_ GROUP BY l) a ON a.l = m.id LEFT JOIN (SELECT r, min(id) AS low FROM m_ GROUP BY r) b ON b.r = m.id")
        self.db.execute("CREATE TABLE vocab AS FROM v_")

    def close(self) -> None:
        self.db.close()

    def _rows(self, query: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        out = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return out

    def _recursion(self, raw: list[bytes], query: str = ENCODE_SQL) -> list[np.ndarray]:
        """Ids of byte strings by the recursive query, some 20,000 strings or a megabyte at a time."""
        if len(places := {b: i for i, b in enumerate(dict.fromkeys(raw))}) < len(raw):
            once = self._recursion(list(places), query)
            return [once[places[b]] for b in raw]
        out, first = [], 0
        ends = np.cumsum([len(b) for b in raw])
        while first < len(raw):
            last = min(first + QUERY_WORDS, max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + QUERY_BYTES, "right"))))
            part = raw[first:last]
            sizes = np.array([len(b) for b in part])
            data = np.frombuffer(b"".join(part), np.uint8)
            word = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            pos = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            got = self._rows(query, "start_rows", pa.table({"word": word, "pos": pos, "id": self.first[data]}))
            at = np.searchsorted(got["word"].to_numpy(), np.arange(len(part) + 1))
            out += np.split(got["id"].to_numpy(), at[1:-1])
            first = last
        return out

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of the words. Longer ones are merged in pieces that are joined afterwards."""
        raw = [w.encode() for w in words]
        pieces = [[b[k : k + PIECE] for k in range(0, len(b), PIECE)] for b in raw]
        flat = iter(self._recursion([p for ps in pieces for p in ps]))
        coded = [[next(flat) for _ in ps] for ps in pieces]
        return [(c[0] if len(c) == 1 else self._joined(b, c)).astype("<u4").tobytes() for b, c in zip(raw, coded)]

    def _joined(self, raw: bytes, coded: list[np.ndarray]) -> np.ndarray:
        """The ids of a word from those of its pieces.

        A row of tokens is a string's encoding exactly if every two neighbours are the
        encoding of their joined bytes. So the JOINT tokens on either side of a joint are
        merged anew: where the outermost two come out unchanged, all neighbours are right.
        Where they don't, eight times as many are taken, up to both parts whole. Every
        second joint is closed in a round, so that a part has one open joint at a time.
        """
        parts = coded
        while len(parts) > 1:
            at = np.concatenate(([0], np.cumsum([int(self.size[p].sum()) for p in parts])))
            done, width = {}, JOINT
            while open_ := [k for k in range(0, len(parts) - 1, 2) if k not in done]:
                sides = [(parts[k][-width:], parts[k + 1][:width]) for k in open_]
                windows = [raw[at[k + 1] - int(self.size[a].sum()) : at[k + 1] + int(self.size[b].sum())] for k, (a, b) in zip(open_, sides)]
                for k, (a, b), w in zip(open_, sides, self._recursion(windows, ENCODE_SQL if width == JOINT else RUNS_SQL)):
                    x, y = parts[k], parts[k + 1]
                    if (len(a) == len(x) or w[0] == a[0]) and (len(b) == len(y) or w[-1] == b[-1]):
                        done[k] = np.concatenate((x[: len(x) - len(a)], w, y[len(b) :]))
                width *= 8
            parts = [done[k] for k in sorted(done)] + parts[2 * len(done) :]
        return parts[0]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids: vocabulary join, then ordered aggregation, DECODED
        tokens at a time; a text's parts are joined, as each token decodes by itself."""
        out, held, n = [[] for _ in ids], [], 0

        def flush() -> None:
            flat = [np.frombuffer(b, "<u4") for _, b in held]
            sizes = np.array([len(x) for x in flat])
            rows = pa.table({"doc": np.repeat(np.arange(len(held), dtype=np.int32), sizes), "pos": np.arange(sizes.sum(), dtype=np.int32), "id": np.concatenate(flat).astype(np.int32)})
            got = self._rows(DECODE_SQL, "token_rows", rows)
            for d, t in zip(got["doc"].to_pylist(), got["txt"].to_pylist()):
                out[held[d][0]].append(t.encode("latin-1"))
            held.clear()

        for i, b in enumerate(ids):
            for k in range(0, len(b), 4 * DECODED):
                held.append((i, b[k : k + 4 * DECODED]))
                n += len(held[-1][1]) // 4
                if n >= DECODED:
                    flush()
                    n = 0
        if held:
            flush()
        return [b"".join(parts) for parts in out]


_codecs: dict[tuple[str, str], Codec] = {}
on_switch(_codecs.clear)


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process; a worker keeps it from task to task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int]]:
    sizes = packed(batch[column])[1]
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + TEXT_BYTES, "right")) - 1)
        yield first, last - first
        first = last


def encode_decode(documents: DataFrame, path: str | None = None, pattern: str | None = None, decode: bool = True) -> DataFrame:
    """doc_id, ids, decoded: the BPE ids of every whole text and, unless told otherwise, the bytes that they decode to.

    ids: binary, little-endian unsigned 32-bit integers. Without a shuffle: every worker
    splits its texts by the pattern, merges the words it has not met yet in DuckDB, and
    joins the words' ids. Memory is bounded but for one text, its ids and its decoded bytes. A null or empty text has no ids and decodes to no bytes. Repeated
    rows stay as they are; other columns are dropped; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers  # where the worker has it

        c = codec(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        c.open()
        try:
            for batch in batches:
                for first, n in _pieces(batch, "text"):
                    ids = c.encode([t or "" for t in batch["text"].slice(first, n).to_pylist()])
                    columns = [batch["doc_id"].slice(first, n), pa.array(ids, pa.binary())]
                    if decode:
                        columns.append(pa.array(c.decode(ids), pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
        finally:
            c.close()

    return documents.select("doc_id", "text").mapInArrow(task("bpe", run), "doc_id long, ids binary" + ", decoded binary" * decode)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded bytes."""
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
