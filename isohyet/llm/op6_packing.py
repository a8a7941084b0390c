"""Hierarchical packing of documents into sequences of several lengths.

Each document is routed by what is left of it after whole top windows to the
smallest tier that holds it.  Tiers are packed from the longest: the gap of a
window is filled with the longest pieces of shorter tiers that fit and, when none
fits, with the head of one that must be cut.  A window of a tier is thus exactly
full; only the last one of a pack can be partial, and it is split into tiers again.
Sequences of a tier are dealt to steps of the same number of tokens.

Rows: a null or empty text is the end id alone; null and repeated doc_ids are kept
as documents of their own; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import ids_for, vocabulary

TIERS = (512, 1024, 2048, 4096)
_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier long, step_id long"
)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length) without gaps."""
    top, made, waiting = tiers[-1], [], []
    for doc, n in enumerate(lengths):
        whole = n // top * top
        made += [[(doc, start, top)] for start in range(0, whole, top)]
        if n > whole:
            waiting.append((n - whole, doc, whole))
    waiting.sort()
    while waiting:
        length, doc, start = waiting.pop()
        room = next(t for t in tiers if t >= length)
        window = [(doc, start, length)]
        gap = room - length
        while gap and waiting:
            at = bisect_right(waiting, (gap, len(lengths)))
            if at:
                length, doc, start = waiting.pop(at - 1)
                window.append((doc, start, length))
                gap -= length
            else:  # all are longer than the gap: the shortest of them is cut
                length, doc, start = waiting.pop(0)
                window.append((doc, start, gap))
                insort(waiting, (length - gap, doc, start + gap))
                gap = 0
        made += [window] if not gap else split(window, tiers)
    return made


def split(window: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """A partial window as full windows of tiers and one rest."""
    left, made = sum(p[2] for p in window), []
    pieces = list(window)
    while left:
        room = next((t for t in reversed(tiers) if t <= left), left)
        left -= room
        part = []
        while room:
            doc, start, length = pieces.pop(0)
            take = min(length, room)
            part.append((doc, start, take))
            room -= take
            if take < length:
                pieces.insert(0, (doc, start + take, length - take))
        made.append(part)
    return made


def tokenised(docs: DataFrame, vocab: str, end_id: int, lossy: bool) -> DataFrame:
    """(doc_id, ids): each document's ids and the end id, two bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ids_for(vocab, lossy), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ids = pa.array([encoder.encode(x.as_py()) + end for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids binary")


def packed(
    docs: DataFrame,
    vocab: str,
    end_id: int = 2,
    lossy: bool = True,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 65_536,
    pack_tokens: int = 2_000_000,
) -> DataFrame:
    """One row for each piece of a document.

    Token rows are dealt evenly over tasks; a task sorts its rows, so that a second
    attempt packs alike, and packs ``pack_tokens`` at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        names, held, size, sequence = [], [], 0, 0
        filled = dict.fromkeys(tiers, (-1, step_tokens))
        steps = 0

        def flush():
            nonlocal sequence, steps
            rows = {k: [] for k in ("doc", "start", "length", "crc", "sequence", "offset", "tier", "step")}
            for window in pack([len(x) for x in held], tiers):
                tokens = sum(p[2] for p in window)
                tier = next(t for t in tiers if t >= tokens)
                step, used = filled[tier]
                if used + tier > step_tokens:
                    step, used, steps = steps, 0, steps + 1
                filled[tier] = step, used + tier
                offset = 0
                for doc, start, length in window:
                    crc = zlib.crc32(held[doc][start : start + length].astype("<u4"))
                    for k, v in zip(rows, (doc, start, length, crc, part + sequence, offset, tier, part + step), strict=True):
                        rows[k].append(v)
                    offset += length
                sequence += 1
            doc = rows.pop("doc")
            columns = {
                "doc_id": pa.array([names[d] for d in doc], pa.int64()),
                "start": rows["start"],
                "length": rows["length"],
                "ids_crc32": rows["crc"],
                "doc_tokens": [len(held[d]) for d in doc],
                "sequence_id": rows["sequence"],
                "offset": rows["offset"],
                "tier": rows["tier"],
                "step_id": rows["step"],
            }
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                held.append(np.frombuffer(ids, "<u2"))
                size += len(held[-1])
                if size >= pack_tokens:
                    yield flush()
                    names, held, size = [], [], 0
        if names:
            yield flush()

    rows = tokenised(docs, vocab, end_id, lossy).hint("rebalance").sortWithinPartitions("doc_id", "ids")
    return rows.mapInArrow(work, _SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
