"""Test items inside documents: sketches by item size, then exact containment.

An item is its set of k-word shingles (lower case, no punctuation).  The sketch is
sized by the item: one of q shingles that a document must hold to ``least``
of 100 parts can lack at most ``q - ceil(least * q / 100)`` of them, so of its
smallest hashes (a bottom-k MinHash sketch) one more than that are kept.  A document
that contains the item holds one of them for certain: the search loses nothing.
Documents are probed as they are read, whole, and each candidate is verified by
comparing the shingles' words.

Rows: a document or item without words, or with a null or empty text, matches
nothing.  An item with fewer than k words is found where these words stand in a row,
by windows of its own length.  Repeated documents and items each give their rows; null doc_ids are
kept; extra columns are ignored; an empty table on either side gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .shingles import WordHashes, letters_and_digits, windows, word_hashes

_SCHEMA = "doc_id long, item_id long, shared long, item_shingles long"
_SEEN = WordHashes()


def texts_of(words: list[str], k: int) -> set[str]:
    """The shingles of a word list, as texts."""
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def sketches(items: DataFrame, k: int, least: int) -> DataFrame:
    """(h, item_id): the sketch of each item, as many hashes as its size asks for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, names = [np.zeros(0, np.int64)], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.unique(windows(word_hashes(letters_and_digits(text), _SEEN), k))
                keep = len(h) - -(-least * len(h) // 100) + 1 if len(h) else 0
                hashes.append(h[:keep].view(np.int64))
                names += [item] * keep
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(names, pa.int64())], names=["h", "item_id"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(work, "h long, item_id long")


def contains(words: list[str], wanted: list[str], k: int, least: int) -> tuple[int, int] | None:
    """(shared, all) shingles of the item ``wanted``, if ``words`` hold enough of them."""
    grams = texts_of(wanted, k)
    both = len(grams & texts_of(words, min(k, max(1, len(wanted)))))
    return (both, len(grams)) if grams and 100 * both >= least * len(grams) else None


def _probes(h: np.ndarray, k: int, short: list[int]) -> np.ndarray:
    """Hashes of the windows of k words and of the lengths of shorter items."""
    return np.concatenate([windows(h, n) for n in {k, *short}]) if len(h) else h


class Matcher:
    """The items of one broadcast: finds those that a text contains."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, least: int):
        self.k, self.least = k, least
        self.names = [i for i, _ in items]
        self.words = [letters_and_digits(t) for _, t in items]
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < k})
        self.by_hash = defaultdict(list)
        for n, words in enumerate(self.words):
            h = np.unique(windows(word_hashes(words, _SEEN), k))
            for x in h[: len(h) - -(-least * len(h) // 100) + 1 if len(h) else 0].tolist():
                self.by_hash[x].append(n)
        self.probe = np.array(sorted(self.by_hash), np.uint64)

    def found(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, shared shingles, the item's shingles) of each item in the text."""
        if not len(self.probe):
            return []
        words = letters_and_digits(text)
        h = _probes(word_hashes(words, _SEEN), self.k, self.short)
        at = np.minimum(np.searchsorted(self.probe, h), len(self.probe) - 1)
        hits = np.unique(h[self.probe[at] == h]).tolist()
        out = []
        for n in sorted({n for x in hits for n in self.by_hash[x]}):
            if held := contains(words, self.words[n], self.k, self.least):
                out.append((self.names[n], *held))
        return out


def _shared(items: DataFrame, broadcast_bytes: int):
    """The items as a broadcast while they are below ``broadcast_bytes``, else None."""
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) + 64 * size[1] > broadcast_bytes:
        return None
    listed = [tuple(r) for r in items.select(F.col("item_id").cast("long"), "text").collect()]
    return items.sparkSession.sparkContext.broadcast(listed)


def contained(
    docs: DataFrame, items: DataFrame, k: int = 5, least: int = 80, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) for containment of ``least`` percent or more.

    The items' texts go to the tasks while they are below ``broadcast_bytes``; larger
    sets of items are joined by sketch hash with the documents' shingles instead.
    """
    shared = _shared(items, broadcast_bytes)
    if shared is None:
        return _by_join(docs, items, k, least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, k, least)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc, *x) for x in matcher.found(text.as_py())]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "shared", "item_shingles"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _SCHEMA)


def clean_rows(docs: DataFrame, items: DataFrame, k: int = 5, least: int = 80, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    shared = _shared(items, broadcast_bytes)
    if shared is None:
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart from the names used here
        marked = docs.select(own, F.col("text").alias("text"), F.xxhash64("text").alias("t"))
        bad = _by_join(marked.select(F.col("t").alias("doc_id"), "text"), items, k, least).select(F.col("doc_id").alias("t"))
        return marked.join(bad.distinct(), "t", "left_anti").select("row.*")
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, k, least)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.found(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def _bitmap(marks: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter with one hash: whose bit of ``2 ** bits`` is set for each mark.

    Built by SQL in pieces of 4 kB; its size is a parameter, not the marks'.
    """
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    pieces = marks.groupBy(F.shiftright(place, 15).alias("piece")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("map")
    )
    out = np.zeros((1 << bits) // 8, "u1")
    for row in pieces.toLocalIterator():
        out[row["piece"] * 4096 : (row["piece"] + 1) * 4096] = np.frombuffer(row["map"], "u1")
    return out


def _by_join(docs: DataFrame, items: DataFrame, k: int, least: int, bits: int = 26) -> DataFrame:
    """The same result for items that no task can hold: sketches meet shingles in a join.

    A filter of 8 MB of the sketches' hashes goes to the tasks, so that only shingles
    that may meet a sketch are shuffled.
    """

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = filter_.value
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.unique(_probes(word_hashes(letters_and_digits(text.as_py()), _SEEN), k, short))
                low = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
                h = h[(seen[low >> 3] >> (low & 7).astype("u1")) & 1 == 1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([row] * len(h), pa.int64())], names=["h", "row"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {len(letters_and_digits(t.as_py())) for t in batch.column(0)}
            yield pa.RecordBatch.from_arrays([pa.array([n for n in made if 0 < n < k], pa.int64())], names=["n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "item_id": [], "shared": [], "item_shingles": []}
            for doc, text, item, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = contains(letters_and_digits(text), letters_and_digits(item_text), k, least)
                if held:
                    for name, v in zip(out, (doc, item, *held), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    numbered = materialise(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"),
        "contamination-docs",
    )
    listed = materialise(
        items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"),
        "contamination-items",
    )
    short = [r["n"] for r in listed.select("text").mapInArrow(lengths, "n long").distinct().collect()]  # at most k - 1
    marks = sketches(listed.select(F.col("item").alias("item_id"), "text"), k, least).select("h", F.col("item_id").alias("item"))
    filter_ = docs.sparkSession.sparkContext.broadcast(_bitmap(marks, bits))
    found = numbered.select("row", "text").mapInArrow(probes, "h long, row long").join(marks, "h").select("row", "item").distinct()
    pairs = found.join(numbered, "row").join(listed.withColumnRenamed("text", "item_text"), "item")
    return pairs.select("doc_id", "text", "item_id", "item_text").mapInArrow(verify, _SCHEMA)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return contained(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))
