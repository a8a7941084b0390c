"""Token files of directly addressable codes.

Each id is cut into 8-bit chunks.  Level 0 holds every id's lowest chunk, level
k + 1 the next chunk of those ids of level k that have one.  A bitmap at each level
tells which ids go on, and a rank directory counts its set bits before each block
of 512, so that token i is found with one chunk, one block of the bitmap and one
directory entry at each level; no block of tokens is decoded.

Rows: a null text is an empty document (only the end id); null, repeated and tied
doc_ids are kept, in the order doc_id (nulls first), text; extra columns are
ignored; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .store import get, opened, put
from .tokens import ids_for, vocabulary

BITS = 8
BLOCK = 512
_MAGIC = b"DAC1"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level."""
    levels, left = [], ids.astype("<u4")
    while True:
        rest = left >> BITS
        more = rest > 0
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="<u8") if len(more) else np.zeros(0, "<u8")
        ranks = np.concatenate([np.zeros(1, "<u8"), np.cumsum(ones, dtype="<u8")]).astype("<u8")
        levels.append(((left & 255).astype("u1"), np.packbits(more, bitorder="little"), ranks))
        if not more.any():
            return levels
        left = rest[more]


def decode_levels(levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids from (chunks, bitmap) of each level."""
    above = None
    for chunks, bitmap in reversed(levels):
        ids = chunks.astype("<u4")
        if above is not None:
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
            ids[more] |= above << np.uint32(BITS)
        above = ids
    return above


def pack_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file: magic, header length, header, sections."""
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    sections = [
        np.array([x is not None for x in doc_ids], "u1"),
        np.array([x or 0 for x in doc_ids], "<i8"),
        starts,
    ]
    levels = encode_levels(ids)
    for level in levels:
        sections += level
    sizes = [s.nbytes for s in sections]
    head = {"docs": len(doc_ids), "ids": len(ids), "counts": [len(x[0]) for x in levels], "sizes": sizes}
    header = json.dumps(head).encode()
    return b"".join([_MAGIC, len(header).to_bytes(4, "little"), header, *(s.tobytes() for s in sections)])


class CodeFile:
    """Random access to one file; reads only the ranges that a call needs."""

    def __init__(self, uri: str):
        filesystem, path = opened(uri)
        self.file = filesystem.open_input_file(path)
        start = self.file.read_at(8, 0)
        if start[:4] != _MAGIC:
            raise ValueError(f"{uri}: not a code file")
        n = int.from_bytes(start[4:], "little")
        self.head = json.loads(self.file.read_at(n, 8))
        self.offsets = np.cumsum([8 + n, *self.head["sizes"]]).tolist()

    def section(self, k: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.head["sizes"][k], self.offsets[k]), kind)

    def token(self, i: int) -> int:
        """Id number i of the file."""
        if not 0 <= i < self.head["ids"]:
            raise IndexError(i)
        value = 0
        for level in range(len(self.head["counts"])):
            chunks, bitmap, ranks = (self.offsets[3 + 3 * level + k] for k in range(3))
            value |= self.file.read_at(1, chunks + i)[0] << (BITS * level)
            block = i // BLOCK
            bits = int.from_bytes(self.file.read_at(BLOCK // 8, bitmap + block * (BLOCK // 8)), "little")
            at = i % BLOCK
            if not bits >> at & 1:
                return value
            i = int.from_bytes(self.file.read_at(8, ranks + 8 * block), "little") + (bits & ((1 << at) - 1)).bit_count()
        raise ValueError("a chunk goes on beyond the last level")

    def all_ids(self) -> np.ndarray:
        n = len(self.head["counts"])
        return decode_levels([(self.section(3 + 3 * k, "u1"), self.section(4 + 3 * k, "u1")) for k in range(n)])

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.section(0, "u1").view(bool), self.section(1, "<i8"), self.section(2, "<u8")


def write_codes(
    docs: DataFrame, folder: str, vocab: str, end_id: int = 0, lossy: bool = False, ids_a_file: int = 4_000_000
) -> DataFrame:
    """Write all documents in ascending doc_id order; (part, piece, file, n_ids, n_docs).

    Documents are dealt by ranges of (doc_id, a hash of the text), so copies of one
    doc_id spread over tasks.  A task holds one file's ids at most.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ids_for(vocab, lossy), np.array([end_id], "<u2").tobytes()
        part, piece = TaskContext.get().partitionId(), 0
        names, counts, held, size = [], [], [], 0

        def flush():
            nonlocal piece, names, counts, held, size
            ids = np.frombuffer(b"".join(held), "<u2")
            uri = f"{folder}/part-{part:06d}-{piece:06d}.dac"
            put(uri, pack_file(names, counts, ids))
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "piece": [piece], "file": [uri], "n_ids": [len(ids)], "n_docs": [len(names)]},
                schema=pa.schema(
                    [("part", pa.int64()), ("piece", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]
                ),
            )
            piece += 1
            names, counts, held, size = [], [], [], 0
            return row

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.encode(text.as_py()) + end
                names.append(name)
                counts.append(len(data) // 2)
                held.append(data)
                size += counts[-1]
                if size >= ids_a_file:
                    yield flush()
        if names:
            yield flush()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("spread", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text")
    schema = "part long, piece long, file string, n_ids long, n_docs long"
    return materialise(dealt.select("doc_id", "text").mapInArrow(work, schema), "code-files")


def read_codes(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    placed = placed.select("file", (F.col("base") + F.col("inside")).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = CodeFile(uri)
                known, names, starts = source.documents()
                ids = source.all_ids()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, mask=~known),
                        pa.array(starts[:-1].astype("i8") + base),
                        pa.array(np.diff(starts).astype("i8")),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, min(10_000, files.count()))
    return placed.repartition(n, "file").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_codes(write_codes(docs, fresh_path(spark, "codes"), vocabulary("byte_bpe_50k.json")))


__all__ = ["CodeFile", "get", "op7_codes", "read_codes", "write_codes"]
