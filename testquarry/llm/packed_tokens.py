"""Token ids in files of fixed-width packed bits, with blocks for random access."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_root
from .textkernels import on_switch, packed, task
from .wordsplit import WordMemory, splitter

MAGIC = b"PKTOK001"
#: Ids of a block. Every block starts at a byte, at an offset that the index holds.
BLOCK = 8192
END_ID = 0
#: Bytes of the words that a worker remembers.
MEMORY = 128 << 20
TEXT_BYTES = 2 << 20


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in `bits` bits, most significant first; zero bits fill the last byte."""
    raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1)[:, 32 - bits :].ravel()).tobytes()


def unpack(data: bytes | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The n ids of packed bytes."""
    raw = np.frombuffer(data, np.uint8)
    wide = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        wide[:, 4 - bits // 8 :] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        flat = np.zeros((n, 32), np.uint8)
        flat[:, 32 - bits :] = np.unpackbits(raw)[: n * bits].reshape(n, bits)
        wide = np.packbits(flat, axis=1)
    return wide.view(">u4").ravel().astype(np.uint32)


class Writer:
    """Blocks as they fill, then doc_ids, the documents' starts, the blocks' offsets, a JSON footer and its length."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.at, self.total, self.rest = len(MAGIC), 0, np.zeros(0, np.uint32)
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.offsets: list[int] = []
        self.nulls = 0
        sink.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, nulls: int = 0) -> None:
        """Documents with their ids; the first `nulls` of them, which only others like them precede, have no doc_id."""
        self.nulls += nulls
        self.docs.append(doc_ids.astype("<i8"))
        self.starts.append((self.total + np.cumsum(sizes) - sizes).astype("<i8"))
        self.total += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(ids[i : i + BLOCK])
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        docs = sum(map(len, self.docs))
        for part in (*self.docs, *self.starts, np.array(self.offsets, "<i8")):
            self.sink.write(part.tobytes())
        footer = json.dumps({"bits": self.bits, "block": BLOCK, "docs": docs, "tokens": self.total, "index": self.at, "blocks": len(self.offsets), "nulls": self.nulls}).encode()
        self.sink.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        return docs, self.total


class Reader:
    """Random access to a file of Writer: only the blocks that hold the ids asked for are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, magic = struct.unpack("<I8s", source.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        f = json.loads(source.read_at(n, size - 12 - n))
        self.bits, self.block, self.docs, self.tokens = f["bits"], f["block"], f["docs"], f["tokens"]
        self.nulls = f["nulls"]
        index = np.frombuffer(source.read_at(8 * (2 * self.docs + f["blocks"]), f["index"]), "<i8")
        self.doc_ids, self.starts, self.offsets = index[: self.docs], index[self.docs : 2 * self.docs], index[2 * self.docs :]
        self.end = f["index"]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the file."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        stop = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
        data = self.source.read_at(stop - int(self.offsets[a]), int(self.offsets[a]))
        if self.block * self.bits % 8 == 0:  # whole blocks have no bits between them
            got = unpack(data, min(self.tokens, (b + 1) * self.block) - a * self.block, self.bits)
        else:
            cuts = [int(x - self.offsets[a]) for x in self.offsets[a : b + 1]] + [len(data)]
            got = np.concatenate([unpack(data[cuts[k - a] : cuts[k - a + 1]], min(self.tokens, (k + 1) * self.block) - k * self.block, self.bits) for k in range(a, b + 1)])
        return got[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document, its end id included."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < self.docs else self.tokens)


class WordCodec:
    """The tokenizers library applied word by word: its byte-level splitter parts a text by a
    fixed pattern and merges within the parts, so equal words have equal ids and the
    library sees each word once. Texts that hold the string of an added token, which it
    looks for first, go to the library whole."""

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a token's characters stand for its bytes one to one
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.memory = WordMemory(splitter(pattern), self._merge, MEMORY)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not whole:
            return self.memory.encode(texts)
        out = self.memory.encode(["" if i in set(whole) else t for i, t in enumerate(texts)])
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of the words, encoded in one call and parted where the words' bytes end."""
        ids = np.array(self.tokenizer.encode_batch_fast([words], add_special_tokens=False, is_pretokenized=True)[0].ids, "<u4")
        ends = np.cumsum([len(w.encode()) for w in words])
        cut = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]


_codecs: dict[tuple[str, str], WordCodec] = {}
on_switch(_codecs.clear)


def _codec(path: str, pattern: str) -> WordCodec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = WordCodec(path, pattern)
    return _codecs[path, pattern]


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_tokens(documents: DataFrame, folder: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode all texts, append END_ID to each, and write them in ascending doc_id order.

    Texts are dealt by ranges of doc_id and sorted; each task encodes and packs its range,
    block by block, into a file of its own name in `folder`, a URI that all executors share.
    Returns, from a written table, a row per file: part (in doc_id order), file, docs,
    tokens. A task that runs twice writes two files, and only the one whose row was kept is
    listed. A null or empty text has the end id alone; a null doc_id comes before all others
    and stays null; rows that share a doc_id all stay, ordered by a hash of the text, and may
    be dealt to several files; an empty table gives no file. Other columns are dropped.
    """
    root = folder if "://" in folder else "file://" + folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers  # where the worker has it
        from pyspark import TaskContext

        at, how = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
        writer = None
        for batch in batches:
            sizes = packed(batch["text"])[1]
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + TEXT_BYTES, "right")) - 1)
                codec = _codec(at, how)
                if writer is None:
                    fs, base = _filesystem(root)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pktok"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer = Writer(sink, width(codec.tokenizer.get_vocab_size()))
                end = np.array([END_ID], "<u4").tobytes()
                ids = [b + end for b in codec.encode([t or "" for t in batch["text"].slice(first, last - first).to_pylist()])]
                docs = batch["doc_id"].slice(first, last - first)
                writer.add(docs.fill_null(0).to_numpy(), np.array([len(b) // 4 for b in ids]), np.frombuffer(b"".join(ids), "<u4"), docs.null_count)
                first = last
        if writer is not None:
            docs, tokens = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [f"{root}/{name}"], "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    # equal ids and texts are told apart by their place, so that any number of them can be split
    keys = ["doc_id", "_hash", "_place"]
    ordered = documents.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.select("doc_id", "text").mapInArrow(task("packed_tokens", run), "part int, file string, docs long, tokens long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of write_tokens.
    A document without a doc_id has a null one.

    start counts the ids of all files and documents before it. One row per file goes to the
    driver for the files' starts.
    """
    starts, at = [], 0
    for r in files.select("part", "tokens").orderBy("part").collect():
        starts.append((r.part, at))
        at += r.tokens
    spark = files.sparkSession
    base = spark.createDataFrame(starts, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                fs, name = _filesystem(file)
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    ends = np.append(reader.starts[1:], reader.tokens)
                    k = 0
                    while k < reader.docs:
                        last = max(k + 1, int(np.searchsorted(ends, reader.starts[k] + (1 << 20), "right")))
                        ids, s = reader.ids(int(reader.starts[k]), int(ends[last - 1])).astype("<u4"), reader.starts[k:last]
                        cut = [int(x - s[0]) for x in s] + [len(ids)]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(reader.doc_ids[k:last], mask=np.arange(k, last) < reader.nulls), "start": pa.array(s + base), "n_tokens": pa.array(ends[k:last] - s), "ids_crc32": pa.array(crc, pa.int64())})
                        k = last

    n = max(1, len(starts))
    return files.join(F.broadcast(base), "part").select("file", "base").repartition(n).mapInArrow(task("packed_tokens", run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_tokens(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """write_tokens then read_tokens; the folder defaults to one in the shared scratch folder."""
    folder = folder or f"{scratch_root(documents.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(documents, folder))
