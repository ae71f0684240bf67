"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the documents of one range of doc_id, in order.  Layout, little-endian:

    magic (8 bytes), shard u64, documents u64, tokens u64, blocks u64, block size u64
    doc ids i64[documents], null flags u8[documents], tokens per document u64[documents]
    block starts u64[blocks + 1], offsets from the first block
    blocks: minimum u32, width u8, exceptions u16, packed bits, positions u16[], values u32[]

A block holds `BLOCK` ids across document borders.  Its minimum is subtracted; the width is
the least that holds `PERCENTILE` of the differences; those that do not fit stand in
the exception list with their positions.  The index of block starts gives any id after
one look.  Files are written by Spark's own file writer (one binary row a file, ended
by its newline) and read by the binaryFile source, so any file system of Spark's does.

Defined results: a null or empty text has only the end id; null doc_ids come first;
rows with equal doc_id follow each other in the order of their texts' hashes, each with a row
of its own; an empty table gives no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilequarry.llm.common import no_cycle_search, released
from tilequarry.llm.tokens import arrow_slices, word_encoder

MAGIC = b"TQPFOR1\0"
HEAD = "<8s5Q"
BLOCK = 256
PERCENTILE = 90
#: Bytes of text that go into one file.
FILE_BYTES = 16 << 20
_BATCH = 4096  # blocks packed at a time


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _bytes_of(x: np.ndarray, kind: str) -> np.ndarray:
    """The bytes of each number, a row each."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view(np.uint8).reshape(len(x), x.itemsize)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """Block offsets (one more than blocks) and the bytes of all blocks."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.concatenate((ids, np.repeat(ids[-1:], blocks * BLOCK - len(ids)))).astype(np.uint32)
    sizes, chunks = [], []
    for a in range(0, blocks, _BATCH):
        v = padded[a * BLOCK:(a + _BATCH) * BLOCK].reshape(-1, BLOCK)
        low = v.min(1)
        diff = v - low[:, None]
        at = max(0, -(-BLOCK * percentile // 100) - 1)
        width = _bit_length(np.partition(diff, at, axis=1)[:, at])
        over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
        n_over = over.sum(1)
        size = 7 + BLOCK * width // 8 + 6 * n_over
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        head = np.concatenate((_bytes_of(low, "<u4"), _bytes_of(width, "u1"), _bytes_of(n_over, "<u2")), axis=1)
        out[start[:, None] + np.arange(7)] = head
        for w in np.unique(width[width > 0]).tolist():
            rows = np.flatnonzero(width == w)
            bits = (diff[rows, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            out[start[rows][:, None] + 7 + np.arange(packed.shape[1])] = packed
        row, pos = np.nonzero(over)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        first = start[row] + 7 + BLOCK * width[row] // 8
        out[(first + 2 * rank)[:, None] + np.arange(2)] = _bytes_of(pos, "<u2")
        out[(first + 2 * n_over[row] + 4 * rank)[:, None] + np.arange(4)] = _bytes_of(diff[row, pos], "<u4")
        sizes.append(size)
        chunks.append(out)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), np.concatenate(chunks) if chunks else np.zeros(0, np.uint8)


def unpack(data: np.ndarray, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids of blocks first..last-1, found through the index of block starts."""
    out = np.empty(((last - first), BLOCK), np.uint32)
    for a in range(first, last, _BATCH):
        at = starts[a:min(a + _BATCH, last)]
        low = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()
        width = data[at + 4].astype(np.int64)
        n_over = np.ascontiguousarray(data[at[:, None] + np.arange(5, 7)]).view("<u2").ravel().astype(np.int64)
        v = np.zeros((len(at), BLOCK), np.uint32)
        for w in np.unique(width[width > 0]).tolist():
            rows = np.flatnonzero(width == w)
            packed = data[at[rows][:, None] + 7 + np.arange(BLOCK * w // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            value = np.zeros((len(rows), BLOCK), np.uint32)
            for k in range(w):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            v[rows] = value
        row = np.repeat(np.arange(len(at)), n_over)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = at[row] + 7 + BLOCK * width[row] // 8
        pos = np.ascontiguousarray(data[(base + 2 * rank)[:, None] + np.arange(2)]).view("<u2").ravel()
        v[row, pos] = np.ascontiguousarray(data[(base + 2 * n_over[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[a - first:a - first + len(at)] = v + low[:, None]
    return out.ravel()


class FileBuilder:
    """One file, built as ids come in; only packed blocks and one unfinished block are held."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.counts, self.sizes, self.blocks = [], [], []
        self.rest = np.zeros(0, np.uint32)
        self.tokens = 0

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.counts.append(counts.astype("<u8"))
        self.tokens += len(ids)
        ids = np.concatenate((self.rest, ids.astype(np.uint32)))
        whole = len(ids) // BLOCK * BLOCK
        self._pack(ids[:whole])
        self.rest = ids[whole:].copy()

    def _pack(self, ids: np.ndarray) -> None:
        if len(ids):
            starts, blocks = pack(ids)
            self.sizes.append(np.diff(starts))
            self.blocks.append(blocks.tobytes())

    def bytes(self, shard: int) -> bytes:
        self._pack(self.rest)
        starts = np.concatenate(([0], np.cumsum(np.concatenate(self.sizes)) if self.sizes else [])).astype("<u8")
        plain = np.array([d or 0 for d in self.doc_ids], "<i8")
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        head = struct.pack(HEAD, MAGIC, shard, len(plain), self.tokens, len(starts) - 1, BLOCK)
        return b"".join((head, plain.tobytes(), null.tobytes(), *(c.tobytes() for c in self.counts), starts.tobytes(), *self.blocks))


class TokenFile:
    """A file's index; ids are unpacked for the range asked for."""

    def __init__(self, content: bytes):
        magic, self.shard, n, self.tokens, blocks, size = struct.unpack_from(HEAD, content)
        if magic != MAGIC or size != BLOCK:
            raise ValueError("not a token file of this format")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(content, "<i8", n, at)
        self.null = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(content, "<u8", n, at + 9 * n).astype(np.int64)
        self.starts = np.frombuffer(content, "<u8", blocks + 1, at + 17 * n).astype(np.int64)
        self.data = np.frombuffer(content, np.uint8, offset=at + 17 * n + 8 * (blocks + 1))

    def ids(self, start: int, stop: int) -> np.ndarray:
        first = start // BLOCK
        return unpack(self.data, self.starts, first, -(-stop // BLOCK))[start - first * BLOCK:stop - first * BLOCK]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, text: str = "text",
          key: str = "doc_id", file_bytes_of_text: int = FILE_BYTES) -> None:
    """Encodes every text, appends `end_id`, and writes the files of all ranges of doc_id."""
    plain = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("text"))
    plain = plain.withColumn("tie", F.xxhash64("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Ties are dealt by hash too, so one doc_id on many rows fills many files, not one.
    ranged = plain.repartitionByRange(int(total // file_bytes_of_text) + 1, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    @released
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = word_encoder(tokenizer), FileBuilder()
        for b in batches:
            with no_cycle_search():
                for part, texts in arrow_slices(b, b.column("text")):
                    ids, n = encode(texts)
                    if end_id is not None:
                        ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                    out.add(part.column("doc_id").to_pylist(), n, ids)
        if out.doc_ids:
            yield pa.RecordBatch.from_pydict({"content": pa.array([out.bytes(TaskContext.get().partitionId())], pa.binary())})

    packed = ranged.mapInArrow(files, "content binary")
    packed.select(F.col("content").cast("string").alias("value")).write.text(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (binary, little-endian u32; null unless asked for) of each document."""
    stored = spark.read.format("binaryFile").load(folder).where("length > 1").select("content")

    @released
    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                f = TokenFile(content)
                ends = np.cumsum(f.counts)
                step = max(1, 2_000_000 * len(ends) // max(1, f.tokens))
                for a in range(0, len(ends), step):
                    n = f.counts[a:a + step]
                    begin = ends[a:a + step] - n
                    raw = f.ids(int(begin[0]), int(ends[a:a + step][-1])).astype("<u4").tobytes()
                    local = ((begin - begin[0]) * 4).tolist()
                    ids = [raw[s:s + 4 * k] for s, k in zip(local, n.tolist())]
                    named = pd.arrays.IntegerArray(f.doc_ids[a:a + step].copy(), f.null[a:a + step].copy())
                    yield pd.DataFrame({"shard": f.shard, "doc_id": named, "local": begin, "n_tokens": n,
                                        "ids_crc32": [zlib.crc32(x) for x in ids], "ids": ids if with_ids else None})

    rows = stored.mapInPandas(documents, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [struct.unpack_from(HEAD, c) for c in b["content"]]
            yield pd.DataFrame({"shard": [h[1] for h in found], "tokens": [h[3] for h in found]})

    # One row per file: the only thing that passes through one task.
    before = stored.mapInPandas(headers, "shard long, tokens long").select("shard", (F.coalesce(
        F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return rows.join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")
