"""Exact Jaccard join of documents' word shingles, and its components.

Index.  Sets of like size share an instance of the index.  In it, each set is cut by
the hash of its shingles into m segments; two sets that link differ in at most H
shingles, so they agree in at least m - H segments.  An index list holds the sets that
agree in the segment at one position; lists are kept by (size class, position), so a
probe skips every block of another position or size.  A set with more than m - H - 1
empty segments lists those too, any other only its filled ones, which loses nothing.
A set that must share r lists with any partner leaves its r - 1 longest ones, by one
order of all lists: the shortest list that two partners share is left by neither.
(Lists of single shingles were not used: the passages that many documents share make
a few of them as long as the table.)

Answers.  Sets of the same shingles are one set.  Each set is first compared only with
the list head that it meets most often; sets linked through heads need no further
comparison with each other, as the component is known.  In lists whose sets are still
in different components, each set is compared with the nearest of the members that
stand for its lists' largest components, round by round while that links many.  In
what is left, the other pairs of a list are tried, in blocks, and only pairs that
sizes and parity maps of the shingles do not rule out.  A parity map has at least one bit for each shingle of the set, so the maps
of two sets tell how much they differ at the least.  Every link is verified on the
shingles of the whole texts.

Rows: a text without words, or null, has an empty set, its own doc_id as component
and no link.  A text with fewer than k words has one shingle, all its words.
Repeated and tied rows each keep their row; a null doc_id is passed over when the
smallest of a component is taken; extra columns are ignored; an empty table gives no
row.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialise, passing
from .shingles import WordHashes, mix, plain_words, shingle_set

_SEEN = WordHashes()
_LOW = np.uint64(0xFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The low bits of a list's key name its size class.
_CLASS = 127
BLOCK = 256
#: Candidates that a set is compared with in one round.
NEAREST = 4
#: Segments beyond the least number, in percent: sets with a few empty ones can still leave lists.
SPARE = 12


class Index:
    """Size classes and the number of segments in each, for similarity num / den."""

    def __init__(self, num: int, den: int):
        grow = max(1.25, den / num)
        self.num, self.den, self.bounds = num, den, [1]
        while self.bounds[-1] < 1 << 31:
            self.bounds.append(max(self.bounds[-1] + 1, -int(-self.bounds[-1] * grow // 1)))
        self.differ, self.m = [], []
        for nxt in self.bounds[1:]:
            small = nxt - 1
            large = small * den // num
            differ = (den - num) * (large + small) // (den + num)
            self.differ.append(differ)
            self.m.append(differ + 1 + -(-SPARE * (differ + 1) // 100) + 1)

    def class_of(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def classes(self, n: int) -> list[int]:
        """The size classes that list a set of n shingles, its own first; none where only equal sets link."""
        own = self.class_of(n)
        return [c for c in (own, own - 1) if c >= 0 and (c == own or n * self.num <= (self.bounds[c + 1] - 1) * self.den) and self.differ[c]]

    def segments(self, h: np.ndarray) -> np.ndarray:
        """A 32-bit value for each segment of each class of the set; 0 where it is empty."""
        made, mixed = [np.zeros(0, "<u4")], mix(h)
        for c in self.classes(len(h)):
            m = self.m[c]
            at = (h % np.uint64(m)).astype(np.int64)
            low = np.bincount(at, (mixed & _LOW).astype(float), m).astype(np.uint64)
            high = np.bincount(at, (mixed >> np.uint64(32)).astype(float), m).astype(np.uint64)
            value = np.maximum(mix(low + high * _STEP) & _LOW, np.uint64(1))
            made.append(np.where(np.bincount(at, minlength=m) > 0, value, 0).astype("<u4"))
        return np.concatenate(made)

    def keys(self, n: int, segments: np.ndarray) -> np.ndarray:
        """The lists that a set belongs to."""
        made, at = [np.zeros(0, np.uint64)], 0
        for c in self.classes(n):
            m = self.m[c]
            value, at = segments[at : at + m].astype(np.uint64), at + m
            place = mix(np.arange(m, dtype=np.uint64) + np.uint64(c << 32))
            keys = (mix(value * _STEP + place) & ~np.uint64(_CLASS)) | np.uint64(c)
            made.append(keys if self._all(c, value) else keys[value > 0])
        return np.concatenate(made)

    def _all(self, c: int, value: np.ndarray) -> bool:
        return self.m[c] - np.count_nonzero(value) > self.m[c] - self.differ[c] - 1

    def least(self, n: int, segments: np.ndarray) -> list[int]:
        """For each class, the least number of lists that the set shares with any partner."""
        made, at = [], 0
        for c in self.classes(n):
            value, at = segments[at : at + self.m[c]], at + self.m[c]
            empty = self.m[c] - np.count_nonzero(value)
            made.append(1 if self._all(c, value) else int(self.m[c] - self.differ[c] - empty))
        return made


def set_id(h: np.ndarray) -> int:
    """A 64-bit id of a set of hashes."""
    total = mix(h).sum(dtype=np.uint64, keepdims=True) + mix(np.array([len(h)], np.uint64))
    return int(mix(total).view(np.int64)[0])


def parity_map(h: np.ndarray, bits: int = 0) -> np.ndarray:
    """Of each of so many places, 512 or more for each set, a bit that tells if an odd number of shingles falls there."""
    bits = bits or max(512, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype("u1")).view(np.int64)


def _sets(docs: DataFrame, k: int, words: Callable, index: Index) -> DataFrame:
    """doc_id, text hash, set size and set id of every row; the rest with a set's first row in a task alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            out = {name: [] for name in ("n", "sid", "map", "low", "segments", "least", "class")}
            for text in batch.column(2):
                h = shingle_set(words(text.as_py()), k, _SEEN)
                sid = set_id(h) if len(h) else None
                new = sid is not None and sid not in done
                if new and len(done) < 2_000_000:
                    done.add(sid)
                cut = index.segments(h) if new else None
                row = (len(h), sid)
                if new:
                    row += (parity_map(h), parity_map(h, 512), cut.tobytes(), index.least(len(h), cut), index.class_of(len(h)))
                for name, value in zip(out, row + (None,) * (7 - len(row)), strict=True):
                    out[name].append(value)
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "th", *out])

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int32()]
    schema = "doc_id long, th long, n long, sid long, map array<long>, low array<long>, segments binary, least array<long>, class int"
    return docs.select("doc_id", "th", "text").mapInArrow(work, schema)


def _lists(rows: DataFrame, index: Index) -> DataFrame:
    """(key, sid, head): the sets of each index list after its first, the head."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                keys = [
                    index.keys(n, np.frombuffer(cut.as_py(), "<u4"))
                    for n, cut in zip(part.column(0).to_pylist(), part.column(2), strict=True)
                ]
                sids = np.repeat(part.column(1).to_numpy(zero_copy_only=False), [len(x) for x in keys])
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(sids, pa.int64())], names=["key", "sid"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sid, head = None, None, None  # the last row and its list's head
        for batch in batches:
            keys, sids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(keys):
                continue
            if key is not None:
                keys, sids = np.concatenate([[key], keys]), np.concatenate([[sid], sids])
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = first[1:] | (sids[1:] != sids[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            heads = sids[start]
            if key is not None:
                heads[start == 0] = head
                fresh[0] = False
            out = ~first & fresh
            if key is not None:
                out[0] = False
            key, sid, head = keys[-1], sids[-1], heads[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[out]), pa.array(sids[out]), pa.array(heads[out])], names=["key", "sid", "head"]
            )

    posted = rows.where(F.col("segments").isNotNull()).select("n", "sid", "segments").mapInArrow(post, "key long, sid long")
    dealt = posted.repartition("key").sortWithinPartitions("key", "sid")
    return dealt.mapInArrow(walk, "key long, sid long, head long")


def _apart(a: str, b: str) -> Column:
    """At least so many shingles differ; for sets whose sizes are within a factor of two."""
    x, y = F.col(f"{a}.map"), F.col(f"{b}.map")

    def folded(m: Column) -> Column:
        half = (F.size(m) / 2).cast("int")
        return F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    small = F.least(F.size(x), F.size(y))
    fit = lambda m: F.when(F.size(m) > small, folded(m)).otherwise(m)
    return F.aggregate(F.zip_with(fit(x), fit(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _low_apart(a: str, b: str) -> Column:
    """The same from the first maps of 512 bits, which are quicker to compare and weaker for large sets."""
    pairs = ((F.get(f"{a}.low", F.lit(i)), F.get(f"{b}.low", F.lit(i))) for i in range(8))
    return sum((F.bit_count(p.bitwiseXOR(q)) for p, q in pairs), F.lit(0))


def _may_link(a: str, b: str, num: int, den: int, apart: Callable = _apart) -> Column:
    """False only for sets that cannot link."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    shared = F.ceil(both * num / F.lit(num + den) - 1e-9)
    sizes = (F.col(f"{a}.n") * den >= F.col(f"{b}.n") * num) & (F.col(f"{b}.n") * den >= F.col(f"{a}.n") * num)
    return F.when(sizes, apart(a, b) <= both - 2 * shared).otherwise(F.lit(False))


def _known(docs: DataFrame, doc: Column, text_hash: Column) -> DataFrame:
    """Adds __th, __doc and __none, which name a document's id and text in equi joins."""
    none = doc.isNull()
    return docs.withColumns({"__th": text_hash, "__doc": F.coalesce(doc, F.lit(0)), "__none": none})


_KEY = ["__th", "__doc", "__none"]


def _texts(needed: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(sid, text) of the sets in ``needed(sid)``: one text for each."""
    first = rows.groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("row")).join(needed.distinct(), "sid")
    first = _known(first, F.col("row.doc_id"), F.col("row.th")).select("sid", *_KEY)
    texts = _known(docs, F.col("doc_id"), F.col("th")).select("text", *_KEY).join(first, _KEY)
    return materialise(texts.dropDuplicates(_KEY).select("sid", "text"), "jaccard-texts")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, words: Callable, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingles are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            found = ([], [])
            for a, b, x, y in zip(*batch.columns[:2], *batch.columns[2:], strict=True):
                b = b.as_py()
                if b != last:
                    last, held = b, shingle_set(words(y.as_py()), k, _SEEN)
                own = shingle_set(words(x.as_py()), k, _SEEN)
                both = len(np.intersect1d(own, held, assume_unique=True))
                if den * both >= num * (len(own) + len(held) - both):
                    found[0].append(a.as_py())
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    with_a = pairs.join(texts.withColumnRenamed("text", "x"), pairs["a"] == texts["sid"]).select("a", "b", "x")
    other = texts.select("sid", F.coalesce("text", F.lit("")).alias("y"))  # another exchange than the first side's
    ready = with_a.join(other, with_a["b"] == other["sid"]).select("a", "b", "x", "y")
    return ready.mapInArrow(work, "a long, b long")


def _rooted(df: DataFrame, roots: DataFrame, column: str = "sid", name: str = "root") -> DataFrame:
    side = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return df.join(side, column, "left").withColumn(name, F.coalesce(name, column))


def _open_rows(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, sid) of the lists whose sets are in several components."""
    two = _rooted(_rooted(lists, roots, "sid", "r1"), roots, "head", "r2").where("r1 <> r2")
    kept = lists.join(two.select("key").distinct(), "key")
    # exploded, as Spark 4.1 miscounts the partitions of a union of two sides dealt alike
    return kept.select("key", F.explode(F.array("sid", "head")).alias("sid")).distinct()


def _still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with their root, of lists that still hold more than one."""
    rows = _rooted(rows.drop("root"), roots)
    open_keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rows.join(open_keys, "key")


def _shorter(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, sid) of each set's lists but its longest ones, one less than it must share with a partner."""
    kind = F.col("key").bitwiseAND(F.lit(_CLASS)).cast("int")
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("members")), "key").withColumn("class", kind)
    needs = sets.select("sid", "class", F.posexplode("least").alias("place", "need"))
    needs = needs.select("sid", (F.col("class") - F.col("place")).alias("class"), "need")
    longest = Window.partitionBy("sid", "class").orderBy(F.desc("members"), "key")
    ranked = rows.join(needs, ["sid", "class"]).withColumn("rank", F.row_number().over(longest))
    return ranked.where("rank >= need").select("key", "sid")


def _next_heads(rows: DataFrame, sets: DataFrame, tried: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """For each set the ``NEAREST`` members, by parity maps, of its lists' largest components.

    One member stands for the largest component of a list, another one in each turn
    and list, so a set has as many candidates as it has lists.
    """
    member = F.struct(F.xxhash64("key", "sid", F.lit(turn)).alias("h"), "sid")
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("size"), F.min(member).alias("m"))
    large = parts.groupBy("key").agg(F.max(F.struct("size", F.col("root").alias("top"), "m")).alias("l"))
    large = large.select("key", "l.top", F.col("l.m.sid").alias("b"))
    pairs = rows.join(large, "key").where("root <> top").select(F.col("sid").alias("a"), "b").distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti").select(F.col("a").alias("sid"), F.col("b").alias("head"))
    pairs = _with_maps(pairs, sets).where(_may_link("x", "y", num, den))
    gap = (_apart("x", "y") / (F.col("x.n") + F.col("y.n"))).alias("gap")
    best = pairs.select(F.col("sid").alias("a"), F.col("head").alias("b"), gap).groupBy("a")
    best = best.agg(F.slice(F.array_sort(F.collect_list(F.struct("gap", "b"))), 1, NEAREST).alias("m"))
    return best.select("a", F.explode(F.transform("m", lambda x: x["b"])).alias("b"))


def _with_maps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(sid, head) with sizes and parity maps of both sides as x and y."""
    own = sets.select("sid", "n", "map")
    other = sets.select(F.col("sid").alias("head"), "n", "map")
    return pairs.join(own.alias("x"), "sid").join(other.alias("y"), "head")


def _open_pairs(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one list in different components that sizes and parity maps let stand."""
    rows = rows.join(sets.select("sid", "n", "low"), "sid")
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key").withColumn("own", F.pmod("sid", "blocks").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.withColumn("other", each).alias("x")
    right = rows.withColumn("other", each).alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    try_it = (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", num, den, _low_apart)
    pairs = left.join(right, meet & try_it).select(F.col("x.sid").alias("sid"), F.col("y.sid").alias("head")).distinct()
    near = _with_maps(pairs, sets).where(_may_link("x", "y", num, den))
    return near.select(F.col("sid").alias("a"), F.col("head").alias("b"))


def linked(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, words: Callable = plain_words) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and root of every row.

    root is the smallest set id of the component and null without words.  It tells
    components apart, which component_id does not where doc_ids are null or repeated.
    """
    with passing() as keep:
        return keep(_linked(docs, k, num, den, words), "jaccard-groups")


def _linked(docs: DataFrame, k: int, num: int, den: int, words: Callable) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    index = Index(num, den)
    with passing() as keep:  # the segments are on disk only until the lists are
        wide = materialise(_sets(docs, k, words, index), "jaccard-segments")
        rows = keep(wide.select("doc_id", "th", "n", "sid"), "jaccard-rows")
        first = [F.first(c).alias(c) for c in ("n", "map", "low", "least", "class")]
        sets = keep(wide.where("map is not null").groupBy("sid").agg(*first), "jaccard-sets")
        lists = keep(_lists(wide, index), "jaccard-lists")
    full = rows.where("n > 0")

    def linking(pairs: DataFrame) -> DataFrame:
        with passing() as keep:
            texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("sid")), docs, full)
            return keep(_verified(pairs, texts, k, words, num, den), "jaccard-links")

    pairs = lists.groupBy("sid", "head").agg(F.count("*").alias("met"))
    pairs = _with_maps(pairs, sets).where(_may_link("x", "y", num, den))
    best = pairs.groupBy("sid").agg(F.max(F.struct("met", "head")).alias("m"))
    heads = materialise(best.select(F.col("sid").alias("a"), F.col("m.head").alias("b")), "jaccard-heads")
    links = linking(heads)
    roots, tried, turn = components(links), heads, 0
    rows_open = materialise(_still_open(_shorter(_open_rows(lists, roots), sets), roots), "jaccard-open")
    while True:
        heads = materialise(_next_heads(rows_open, sets, tried, turn, num, den), "jaccard-heads")
        asked = heads.count()
        if not asked:
            break
        more = linking(heads)
        tried, turn, found = tried.unionByName(heads), turn + 1, more.count()
        if found:
            links = links.unionByName(more)
            roots = components(links)
            rows_open = materialise(_still_open(rows_open, roots), "jaccard-open")
        if 2 * found < asked:  # the last step, which tries all pairs, is now the shorter way
            break
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(_open_pairs(rows_open, sets, num, den).join(both, ["a", "b"], "left_anti"), "jaccard-rest")
    if rest.head(1):
        more = linking(rest)
        if more.head(1):
            roots = components(links.unionByName(more))
    nodes = full.groupBy("sid").agg(F.min("doc_id").alias("low"))
    nodes = nodes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(lowest, "root").select("sid", "component_id", "root")
    out = rows.select("doc_id", "th", "n", "sid").join(named, "sid", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def first_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, words: Callable = plain_words) -> DataFrame:
    """The rows of ``docs`` that stay when each group of linked documents keeps one.

    That is the row of the smallest (doc_id, text hash); rows without words all stay.
    """
    groups = linked(docs, k, num, den, words).where("n_shingles > 0")
    lowest = groups.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("row"))
    keep = _known(lowest, F.col("row.doc_id"), F.col("row.th")).select(*_KEY)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart from the names used here
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(own, F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), text.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    marked = _known(rows, F.col("d"), F.col("t"))
    stay = marked.where("worded")
    if groups.groupBy("doc_id", "th").count().where("count > 1").head(1):  # rows alike: one of them stays
        stay = stay.dropDuplicates(_KEY)
    stay = stay.join(keep, _KEY, "left_semi").select("row")
    return stay.unionByName(marked.where("not worded").select("row")).select("row.*")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return linked(docs).select("doc_id", "n_shingles", "component_id")
