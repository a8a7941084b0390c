"""Stupid-backoff scores of documents under the n-grams of all other documents.

Documents are dealt into blocks by hash.  A block's distinct n-grams go, with their
counts, to the count table's part that their hash names; the part adds up the counts
of all blocks and answers each block with the totals of the n-grams that it sent, in
the same order.  A block joins the answers to its exploded n-grams and sums each
document's log scores.  A document's own counts are taken off first, so that it is
scored by the rest of the corpus and does back off.

Score of a word: the count of the longest n-gram that ends there and occurs in other
documents, over the count of its context, times ``alpha`` for each shorter step; a
word that no other document has counts as if it occurred once.

Rows: a null or empty text has no words and the score 0; repeated rows are documents
of their own and so support each other; null doc_ids are kept; extra columns are
ignored; an empty table gives no row.  N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .shingles import WordHashes, plain_words, windows, word_hashes

_SEEN = WordHashes()


def squeeze(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences of the least width in bytes."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = (int(steps.max()).bit_length() + 7) // 8 or 1
    return bytes([width]) + steps.astype("<u8").view("u1").reshape(-1, 8)[:, :width].tobytes()


def stretch(data: bytes) -> np.ndarray:
    width = data[0]
    flat = np.frombuffer(data, "u1", offset=1).reshape(-1, width)
    out = np.zeros((len(flat), 8), "u1")
    out[:, :width] = flat
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def squeeze_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes, and those of 255 or more apart."""
    large = np.flatnonzero(counts >= 255)
    rest = np.stack([large, counts[large]]).astype("<i8").tobytes()
    return np.minimum(counts, 255).astype("u1").tobytes(), rest


def stretch_counts(small: bytes, large: bytes) -> np.ndarray:
    counts = np.frombuffer(small, "u1").astype(np.int64)
    at, value = np.frombuffer(large, "<i8").reshape(2, -1)
    counts[at] = value
    return counts


def _grams(texts: pa.ChunkedArray, orders: range) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's number of words; for each n of ``orders``, n-gram hashes and their texts' numbers."""
    parts = [word_hashes(plain_words(t.as_py()), _SEEN) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(parts)), lengths)
    made = []
    for n in orders:
        if len(words) < n:
            made.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        inside = owner[: len(words) - n + 1] == owner[n - 1 :]
        made.append((windows(words, n)[inside], owner[n - 1 :][inside]))
    return lengths, made


def scored(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_words and score (natural logarithm) of every document.

    A task holds one block's n-grams or one part's; ``block_bytes`` of text set both,
    and should grow with the executors' memory, as blocks times parts are the rows sent.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = max(1, blocks // 2)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition("block")
    wide = np.uint64(-(-(1 << 64) // parts) if parts > 1 else (1 << 64) - 1)

    def send(orders: range):
        def work(table: pa.Table) -> pa.Table:
            rows = {k: [] for k in ("part", "n", "block", "grams", "small", "large")}
            block = table["block"][0].as_py()
            for n, (hashes, _) in zip(orders, _grams(table["text"], orders)[1], strict=True):
                kinds, counts = np.unique(hashes, return_counts=True)
                part = (kinds // wide).astype(np.int64)
                for p, a, b in _runs(part):
                    small, large = squeeze_counts(counts[a:b])
                    for k, v in zip(rows, (p, n, block, squeeze(kinds[a:b]), small, large), strict=True):
                        rows[k].append(v)
            return pa.table(rows, schema=sent)

        return work

    def add_up(table: pa.Table) -> Iterator[pa.RecordBatch]:
        grams = [stretch(x.as_py()) for x in table["grams"]]
        counts = [stretch_counts(a.as_py(), b.as_py()) for a, b in zip(table["small"], table["large"], strict=True)]
        kinds, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        at = np.cumsum([0, *map(len, grams)])
        replies = [squeeze_counts(total[which[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table(
            {
                "part": table["part"],
                "n": table["n"],
                "block": table["block"],
                "small": pa.array([r[0] for r in replies], pa.binary()),
                "large": pa.array([r[1] for r in replies], pa.binary()),
                "words": pa.array([int(c.sum()) for c in counts], pa.int64()),
            }
        )

    def score(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        lengths, grams = _grams(table["text"], range(1, order + 1))
        answer = {}
        for n, part, small, large in zip(*(replies[c].to_pylist() for c in ("n", "part", "small", "large")), strict=True):
            answer.setdefault(n, []).append((part, small, large))
        words = int(lengths.sum())
        own_words = np.repeat(lengths, lengths)
        logs = np.full(words, np.nan)
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(words) - np.repeat(firsts, lengths)  # of each word in its text
        above = None  # counts in other documents of the n-grams one shorter, by the word they end at
        held = []
        for n, (hashes, owner) in enumerate(grams, 1):
            if not len(hashes):
                break
            total = np.concatenate([stretch_counts(a, b) for _, a, b in sorted(answer[n])])
            kinds, which = np.unique(hashes, return_inverse=True)
            pair = owner * len(kinds) + which
            _, back, mine = np.unique(pair, return_inverse=True, return_counts=True)
            others = np.zeros(words, np.int64)
            others[place >= n - 1] = total[which] - mine[back]
            held.append(others)
            del total, kinds, which, pair, back, mine
        for n in range(min(order, len(held)), 0, -1):
            others = held[n - 1]
            use = np.isnan(logs) & (others > 0)
            if n > 1:
                above = np.concatenate([[0], held[n - 2][:-1]])
                logs[use] = np.log(others[use] / above[use])
            else:
                use = np.isnan(logs)
                logs[use] = np.log(np.maximum(others[use], 1) / np.maximum(all_words - own_words[use], 1))
            logs[use] += (order - n) * np.log(alpha)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = np.bincount(owner, logs, len(lengths))
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": lengths, "score": sums})

    sent = pa.schema(
        [("part", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("grams", pa.binary()), ("small", pa.binary()), ("large", pa.binary())]
    )
    replies = None
    for orders in [range(1, min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))]:
        # one order after the other, so that no more than one order's n-grams are on their way
        table = dealt.groupBy("block").applyInArrow(
            send(orders), "part long, n long, block int, grams binary, small binary, large binary"
        )
        answers = table.groupBy("part", "n").applyInArrow(
            add_up, "part long, n long, block int, small binary, large binary, words long"
        )
        answers = materialise(answers, "gram-counts")
        replies = answers if replies is None else replies.unionByName(answers)
    all_words = replies.where("n = 1").agg(F.sum("words")).first()[0] or 0
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, score double"
    )


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            yield int(values[a]), a, b


def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents)
), g AS (
  SELECT doc_id, i, w AS g1,
    CASE WHEN i > 1 THEN lag(w) OVER o || ' ' || w END AS g2,
    CASE WHEN i > 2 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o || ' ' || w END AS g3,
    CASE WHEN i > 1 THEN lag(w) OVER o END AS p1,
    CASE WHEN i > 2 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o END AS p2
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT g1, count(*) AS n FROM g GROUP BY 1), d1 AS (SELECT doc_id, g1, count(*) AS n FROM g GROUP BY 1, 2),
c2 AS (SELECT g2, count(*) AS n FROM g WHERE g2 IS NOT NULL GROUP BY 1), d2 AS (SELECT doc_id, g2, count(*) AS n FROM g WHERE g2 IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT g3, count(*) AS n FROM g WHERE g3 IS NOT NULL GROUP BY 1), d3 AS (SELECT doc_id, g3, count(*) AS n FROM g WHERE g3 IS NOT NULL GROUP BY 1, 2),
l AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), t AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc_id,
    CASE WHEN c3.n - d3.n > 0 THEN ln((c3.n - d3.n) / (q2.n - e2.n))
         WHEN c2.n - d2.n > 0 THEN ln((c2.n - d2.n) / (q1.n - e1.n)) + ln(0.4)
         ELSE ln(greatest(c1.n - d1.n, 1) / greatest(t.n - l.n, 1)) + 2 * ln(0.4) END AS s
  FROM g JOIN l USING (doc_id) CROSS JOIN t
  JOIN c1 ON c1.g1 = g.g1 JOIN d1 ON d1.g1 = g.g1 AND d1.doc_id = g.doc_id
  LEFT JOIN c2 ON c2.g2 = g.g2 LEFT JOIN d2 ON d2.g2 = g.g2 AND d2.doc_id = g.doc_id
  LEFT JOIN c3 ON c3.g3 = g.g3 LEFT JOIN d3 ON d3.g3 = g.g3 AND d3.doc_id = g.doc_id
  LEFT JOIN c1 q1 ON q1.g1 = g.p1 LEFT JOIN d1 e1 ON e1.g1 = g.p1 AND e1.doc_id = g.doc_id
  LEFT JOIN c2 q2 ON q2.g2 = g.p2 LEFT JOIN d2 e2 ON e2.g2 = g.p2 AND e2.doc_id = g.doc_id
)
SELECT d.doc_id, coalesce(x.n, 0) AS n_words, round(coalesce(x.s, 0.0), 4) AS score
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(s) AS s FROM s GROUP BY 1) x USING (doc_id)
"""
