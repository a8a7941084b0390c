"""Collocations: frequent phrases of two and three words that hold together, by stripes.

Each prefix, of no word, one or two, keys a counter of the words that follow it.  A
task counts its texts into such stripes and sends each to the shard that its language
and prefix name; the stripe of no word, which counts all words, is cut by the word
itself.  A shard adds the stripes of a prefix up elementwise and reads all it needs off
them: the extensions of (w, x) with their counts, the count of (w, x) as the total of
its stripe (the end of a piece counts as an extension), and the most frequent longer
phrase that starts with it.  Shards are as many as the texts' size asks for, so one
holds some megabytes of text; a prefix that occurs in a third of all texts reaches its
shard as one stripe from each part of a task's texts, as wide as its distinct followers.

Of a phrase's counts only those of ``least`` and more leave the shards: a candidate's
parts are as frequent as itself.  What is left is joined: the counts of a candidate's
first words and rest, and the most frequent longer candidate that ends with it.

Words are compared by their bytes; nothing is hashed but the choice of shards.

Rows: a null or empty text has no word; a null language is ``und``, together with a
language of that name; repeated rows count as often as they occur; a null doc_id does
not matter; extra columns are ignored; an empty table gives no row.  Scores are computed
in decimals of 38 digits, enough for counts of 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, passing
from .shingles import WordHashes, mix, word_hashes

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 255
_TABLE = bytes(_TABLE)
_SEEN = WordHashes()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words that a task counts before it sends their stripes.
CHUNK = 500_000


class _Ids(dict):
    """word -> a number from 1 on; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def added(w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct (w, x, y) with their sums of n."""
    if not len(w):
        return w, x, y, n
    bits = int(max(w.max(), x.max(), y.max())).bit_length()
    if 3 * bits <= 63:
        key = (w.astype(np.int64) << (2 * bits)) | (x.astype(np.int64) << bits) | y
        order = np.argsort(key).astype(np.int32 if len(w) < 1 << 31 else np.int64)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort((y, x, w))
        a, b, c = w[order], x[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
    at = order[first]
    return w[at], x[at], y[at], np.add.reduceat(n[order], first)


def packed(w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, words: list[bytes]) -> bytes:
    """Stripes in one value: prefixes, lengths, followers, counts, and the words they use."""
    used, at = np.unique(np.concatenate([w, x, y]), return_inverse=True)
    w, x, y = at.reshape(3, -1)
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])]))
    small = "<u2" if len(used) < 1 << 16 else "<u4"
    head = np.array([len(first), len(y), len(used), int(small[-1])], "<u4")
    lengths = np.diff(np.append(first, len(y)))
    parts = [head.tobytes(), w[first].astype(small).tobytes(), x[first].astype(small).tobytes(), lengths.astype("<u4").tobytes()]
    text = b" ".join([words[i] for i in used.tolist()])
    return b"".join([*parts, y.astype(small).tobytes(), n.astype("<u4").tobytes(), text])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    stripes, entries, _, size = np.frombuffer(data, "<u4", 4).tolist()
    at, made = 16, []
    for number, kind in ((stripes, f"<u{size}"), (stripes, f"<u{size}"), (stripes, "<u4"), (entries, f"<u{size}"), (entries, "<u4")):
        made.append(np.frombuffer(data, kind, number, at))
        at += made[-1].nbytes
    w, x, lengths, y, n = made
    return np.repeat(w, lengths), np.repeat(x, lengths), y, n.astype(np.int64), data[at:].split(b" ")


def _sent(streams: dict, ids: _Ids, shards: int) -> pa.RecordBatch:
    """A row for each shard and language with the stripes of one part of a task's texts."""
    words = list(ids)
    hashes = word_hashes(words, _SEEN)
    hashes[0] = 0
    rows = ([], [], [])
    for lang, parts in streams.items():
        own = word_hashes([lang.encode("utf-8", "surrogatepass")], _SEEN)[0]
        a = np.concatenate([*parts, np.zeros(2, np.int32)])
        w, x, y = a[:-2], a[1:-1], a[2:]
        real = w > 0
        w, x, y = w[real], x[real], np.where(x[real] > 0, y[real], 0)
        if not len(w):  # separators alone
            continue
        w, x, y, n = added(w, x, y, np.ones(len(w), np.int64))
        every = np.bincount(w, n).astype(np.int64)
        seen = np.flatnonzero(every)
        place = mix(mix(hashes[w] * _A + own) + hashes[x] * _B) % np.uint64(shards)
        alone = mix(hashes[seen] * _B + own) % np.uint64(shards)
        none, seen = np.zeros(len(seen), np.int32), seen.astype(np.int32)
        w, x, y, n = (np.concatenate(p) for p in ((none, w), (none, x), (seen, y), (every[seen], n)))
        place = np.concatenate([alone, place]).astype(np.int64)
        order = np.argsort(place, kind="stable")  # within a shard they stay in order
        w, x, y, n, place = w[order], x[order], y[order], n[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        for i, j in zip(cut, [*cut[1:], len(place)], strict=True):
            rows[0].append(int(place[i]))
            rows[1].append(lang)
            rows[2].append(packed(w[i:j], x[i:j], y[i:j], n[i:j], words))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary())], names=["shard", "lang", "stripes"])


def stripes(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, lang, stripes) as tasks count them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, streams, held = _Ids(), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = text.as_py().translate(_TABLE).replace(_BREAK, b" \xff ").split()
                if not found:
                    continue
                part = np.fromiter(map(ids.__getitem__, found), np.int32, len(found))
                streams.setdefault(lang, []).extend((part, np.zeros(1, np.int32)))
                held += len(found)
                if held >= CHUNK:
                    yield _sent(streams, ids, shards)
                    ids, streams, held = _Ids(), {}, 0
        if held:
            yield _sent(streams, ids, shards)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.where("text is not null").mapInArrow(work, "shard long, lang string, stripes binary")


_COUNTS = "lang string, k int, w binary, x binary, y binary, f long, head long, longest long"


def merged(lang: str, blobs: list[bytes], least: int) -> pa.RecordBatch:
    """What the added stripes of one shard and language tell: k = 0 all words, 1 to 3 frequent phrases."""
    ids, parts = _Ids(), []
    for blob in blobs:
        w, x, y, n, words = unpacked(blob)
        to = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        parts.append((to[w], to[x], to[y], n))
    whole = [np.concatenate(p) for p in zip(*parts, strict=True)]
    parts.clear()
    w, x, y, n = added(*whole)
    del whole
    words = pa.array(list(ids), pa.binary())
    single = w == 0
    total = int(n[single].sum())
    often = single & (n >= least)
    ones, ones_n = y[often], n[often]

    w, x, y, n = w[~single], x[~single], y[~single], n[~single]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])])) if len(w) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n, first) if len(w) else n
    longer = np.where((y > 0) & (n >= least), n, 0)
    most = np.maximum.reduceat(longer, first) if len(w) else n
    pair = (x[first] > 0) & (sums >= least)
    heads = np.repeat(sums, np.diff(np.append(first, len(w))))
    three = np.flatnonzero(longer)
    two = first[pair]

    none = np.zeros(0, np.int64)
    k = np.repeat([0, 1, 2, 3], [1, len(ones), len(two), len(three)]).astype(np.int32)

    def named(*at: np.ndarray | None) -> pa.Array:
        pieces = [pa.nulls(size, pa.binary()) if a is None else words.take(pa.array(a)) for a, size in zip(at, sizes, strict=True)]
        return pa.concat_arrays(pieces)

    sizes = (1, len(ones), len(two), len(three))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(k), pa.string()),
            pa.array(k),
            named(None, ones, w[two], w[three]),
            named(None, None, x[two], x[three]),
            named(None, None, None, y[three]),
            pa.array(np.concatenate([[total], ones_n, sums[pair], n[three]]).astype(np.int64)),
            pa.array(np.concatenate([none, np.zeros(1 + len(ones) + len(two), np.int64), heads[three]])),
            pa.array(np.concatenate([none, np.zeros(1 + len(ones), np.int64), most[pair], np.zeros(len(three), np.int64)])),
        ],
        names=["lang", "k", "w", "x", "y", "f", "head", "longest"],
    )


def frequent(docs: DataFrame, least: int, shard_bytes: int = 1_500_000) -> DataFrame:
    """(lang, k, w, x, y, f, head, longest) of all phrases of k words that occur ``least`` times.

    k = 0 has parts of the number of all words of a language; head is the count of a
    phrase of three without its last word, longest the count of the most frequent
    phrase of three that starts with a phrase of two.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(96, -(-size // shard_bytes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for shard, lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (shard, lang) != key:
                    if held:
                        yield merged(key[1], held, least)
                    key, held = (shard, lang), []
                held.append(blob.as_py())
        if held:
            yield merged(key[1], held, least)

    # as many tasks as shards ask for, whatever the session's number
    dealt = stripes(docs, shards).repartition(-(-shards // 8), "shard").sortWithinPartitions("shard", "lang")
    return materialise(dealt.mapInArrow(work, _COUNTS), "phrase-counts")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a^2 / (left right)), exact."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases.

    A phrase goes if a longer candidate that holds it occurs at least ``share`` percent
    as often.
    """
    with passing() as keep:
        rows = frequent(docs, least)
        words = rows.where("k = 1").select("lang", F.col("w").alias("word"), F.col("f").alias("fw"))
        two = rows.where("k = 2").select("lang", "w", "x", F.col("f").alias("a"), "longest")
        three = rows.where("k = 3").select("lang", "w", "x", "y", F.col("f").alias("a"), "head")

        def count(df: DataFrame, column: str, name: str) -> DataFrame:
            return df.join(words.select("lang", F.col("word").alias(column), F.col("fw").alias(name)), ["lang", column])

        ends = three.groupBy("lang", F.col("x").alias("w"), F.col("y").alias("x")).agg(F.max("a").alias("ending"))
        pairs = two.join(ends, ["lang", "w", "x"], "left")
        pairs = pairs.where(100 * F.greatest("longest", F.coalesce("ending", F.lit(0))) < share * F.col("a"))
        pairs = count(count(pairs, "w", "l"), "x", "r").withColumn("score", _score("a", "l", "r"))
        pairs = pairs.select("lang", F.concat("w", F.lit(b" "), "x").alias("phrase"), "a", "l", "r", "score")

        rest = two.select("lang", F.col("w").alias("x"), F.col("x").alias("y"), F.col("a").alias("tail"))
        both = count(count(three.join(rest, ["lang", "x", "y"]), "w", "first"), "y", "last")
        both = both.withColumns({"s1": _score("a", "first", "tail"), "s2": _score("a", "head", "last")})
        early = F.col("s1") <= F.col("s2")
        side = lambda a, b: F.when(early, F.col(a)).otherwise(F.col(b))
        triples = both.select(
            "lang", F.concat("w", F.lit(b" "), "x", F.lit(b" "), "y").alias("phrase"), "a",
            side("first", "head").alias("l"), side("tail", "last").alias("r"), side("s1", "s2").alias("score"),
        )

        best = [F.desc("score"), F.desc("a"), F.col("phrase")]
        out = pairs.unionByName(triples).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
        n = rows.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
        out = out.join(n, "lang").withColumn("phrase", F.col("phrase").cast("string"))
        return keep(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _phrases(name: str, k: int) -> str:
    columns = ", ".join(f"ws[i + {j}] AS {'wxy'[j]}" for j in range(k))
    inner = f"SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces WHERE len(ws) >= {k}"
    return f"{name} AS (SELECT lang, {', '.join('wxy'[:k])}, count(*) AS f FROM (SELECT lang, {columns} FROM ({inner})) GROUP BY ALL)"


_S = "CAST(1000000 AS HUGEINT) * a * a // (CAST({0} AS HUGEINT) * {1})"
ORACLE = rf"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
pieces AS (SELECT lang, regexp_split_to_array(trim(p, chr(32) || chr(9)), '[\x20\x09]+') AS ws FROM cut WHERE trim(p, chr(32) || chr(9)) <> ''),
{_phrases("one", 1)}, {_phrases("two", 2)}, {_phrases("three", 3)},
total AS (SELECT lang, sum(f) AS n FROM one GROUP BY 1),
c2 AS (SELECT lang, w, x, f AS a FROM two WHERE f >= 10),
c3 AS (SELECT lang, w, x, y, f AS a FROM three WHERE f >= 10),
held AS (SELECT lang, w, x, max(a) AS most FROM (SELECT lang, w, x, a FROM c3 UNION ALL SELECT lang, x AS w, y AS x, a FROM c3) GROUP BY 1, 2, 3),
s2 AS (SELECT c2.lang, c2.w || ' ' || c2.x AS phrase, a, p.f AS l, q.f AS r, {_S.format("p.f", "q.f")} AS score
  FROM c2 JOIN one p ON p.lang = c2.lang AND p.w = c2.w JOIN one q ON q.lang = c2.lang AND q.w = c2.x
  LEFT JOIN held h ON h.lang = c2.lang AND h.w = c2.w AND h.x = c2.x WHERE 100 * coalesce(most, 0) < 50 * a),
b3 AS (SELECT c3.lang, c3.w || ' ' || c3.x || ' ' || c3.y AS phrase, a, p.f AS l1, t.f AS r1, h.f AS l2, q.f AS r2,
  {_S.format("p.f", "t.f")} AS s1, {_S.format("h.f", "q.f")} AS s2
  FROM c3 JOIN one p ON p.lang = c3.lang AND p.w = c3.w JOIN one q ON q.lang = c3.lang AND q.w = c3.y
  JOIN two h ON h.lang = c3.lang AND h.w = c3.w AND h.x = c3.x JOIN two t ON t.lang = c3.lang AND t.w = c3.x AND t.x = c3.y),
every AS (SELECT * FROM s2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM b3)
SELECT every.lang, row_number() OVER (PARTITION BY every.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM every JOIN total ON total.lang = every.lang
QUALIFY rank <= 2000"""
