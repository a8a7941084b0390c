"""Quality rules and the divergence of a document from its language.

Built from SQL functions only.  A document's histogram counts eight classes of
characters and the common words of the languages that have a word list.  Each value
of ``lang`` has a reference: the mean histogram of its documents, shrunk towards that
of all documents the fewer they are.  A document whose Jensen-Shannon distance to its
reference is above the limit is rejected; below a least number of words no distance
is taken.  A language without a word list has no word distance and no rule on it.

Rows: a null or empty text has no words and fails the base rules; a null language is
one of its own; region marks and case of ``lang`` matter for the reference, not for
the word list; repeated rows count as often as they occur; extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

_SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of the languages that documents name.
COMMON = {
    "en": "the of and to a in is that for it as with on be by this are at or an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
#: From so many documents on, a language's reference is its own mean alone.
LEAST_DOCS = 50
WORDS = sorted({w for line in COMMON.values() for w in line.split()})
#: Character classes, as characters that a regular expression removes.
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{N}",
    "stop": r"[.,;:!?'\"()\-]",
    "sign": r"[#*$%&|<>@^~=+_{}\[\]\\/]",
    "space": r"[\x20\x09-\x0D]",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, k: int = 8) -> Column:
    """Words that lie in a k-word window found twice or more.

    Words are hashed once and windows by their words' hashes.  Only where a hash occurs
    twice are they sorted, and those that share one compared by their words.
    """

    def covered(at: Column) -> Column:
        """Words under windows that start at the sorted places ``at``."""
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-k).alias("last")),
            lambda s, p: F.struct((s["sum"] + F.least(F.lit(k), p - s["last"])).alias("sum"), p.alias("last")),
            lambda s: s["sum"],
        )

    def twins(pairs: Column) -> Column:
        """Places of the structs (key, at) whose key occurs twice, of a sorted array."""
        both = F.filter(
            pairs,
            lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["key"] == x["key"])) | (F.get(pairs, i + 1)["key"] == x["key"]),
        )
        return F.transform(both, lambda x: x["at"])

    def compared(w: Column, keys: Column) -> Column:
        suspects = let(F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at")))), twins)
        exact = F.sort_array(
            F.transform(suspects, lambda i: F.struct(F.array_join(F.slice(w, i + 1, k), " ").alias("key"), i.alias("at")))
        )
        return covered(F.sort_array(let(exact, twins)))

    def windows(w: Column) -> Column:
        def keys(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

        hashed = let(F.transform(w, lambda x: F.xxhash64(x)), keys)
        none = lambda c: F.size(F.array_distinct(c)) == F.size(c)
        return let(hashed, lambda c: F.when(none(c), F.lit(0).cast("long")).otherwise(compared(w, c)))

    return let(words, lambda w: F.when(F.size(w) < k, F.lit(0).cast("long")).otherwise(windows(w)))


def measured(docs: DataFrame) -> DataFrame:
    """The contract's counts and the two histograms of each document; ``row``: its own columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("lang").cast("string").alias("lang"),
        text.alias("text"),
        words_of(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # each class is removed from what the classes before it have left
    rest, left = base, F.col("text")
    for name, pattern in CLASSES.items():
        rest = rest.withColumn(f"no_{name}", F.regexp_replace(left, f"{pattern}+", ""))
        left = F.col(f"no_{name}")
    sizes = [F.length("text"), *[F.length(f"no_{name}") for name in CLASSES]]
    counts = [(a - b).cast("double") for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1].cast("double")]
    commons = F.transform(F.filter("words", lambda w: F.lower(w).isin(*WORDS)), F.lower)
    tallied = let(
        commons,
        lambda c: F.transform(
            F.array_distinct(c),
            lambda w: F.struct(w.alias("word"), (F.size(c) - F.size(F.array_remove(c, w))).cast("double").alias("n")),
        ),
    )
    return rest.select(
        "row",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - (F.length("no_sign") - F.length("no_space"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*counts).alias("chars"),
        tallied.alias("commons"),
    )


def listed(lang: Column) -> Column:
    """The language has a list of common words: 'en' has, and so have 'EN' and 'en-US'."""
    return F.coalesce(F.lower(F.substring_index(F.translate(lang, "_", "-"), "-", 1)).isin(*COMMON), F.lit(False))


def references(rows: DataFrame, least_docs: int) -> DataFrame:
    """(ref_lang, char_ref, word_ref): the reference of each value of lang, null included.

    Mean shares of the documents of 20 words and more.  With d of these a language
    has d / ``least_docs`` of its own mean, at most all, and the rest from the mean of
    all documents (of all in listed languages, for words).  word_ref is null for a
    language that is not listed.
    """
    n = len(CLASSES) + 1
    good = F.col("n_words") >= 20
    total = F.greatest(F.aggregate("chars", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    by_lang = rows.groupBy("lang").agg(
        F.count(F.when(good, 1)).alias("docs"),
        *[F.coalesce(F.sum(F.when(good, F.get("chars", F.lit(i)) / total)), F.lit(0.0)).alias(f"s{i}") for i in range(n)],
    )
    words = rows.where(good & listed(F.col("lang"))).select("lang", "n_words", F.explode("commons").alias("c"))
    words = words.groupBy("lang", "c.word").agg(F.sum(F.col("c.n") / F.col("n_words")).alias("s"))
    tallies = lambda: F.map_from_entries(F.collect_list(F.struct("word", "s")))
    own = words.groupBy(F.col("lang").alias("word_lang")).agg(tallies().alias("own"))
    every = words.groupBy("word").agg(F.sum("s").alias("s")).agg(tallies().alias("w0"))
    wide = by_lang.agg(
        F.nullif(F.sum("docs"), F.lit(0)).alias("all_docs"),
        F.greatest(F.sum(F.when(listed(F.col("lang")), F.col("docs"))), F.lit(1)).alias("word_docs"),
        F.array(*[F.sum(f"s{i}") for i in range(n)]).alias("s0"),
    )
    even = F.array(*[F.lit(1.0 / n)] * n)
    wide = wide.join(F.broadcast(every), F.lit(True)).select(
        F.coalesce(F.transform("s0", lambda x: x / F.col("all_docs")), even).alias("c0"),
        F.transform_values("w0", lambda k, v: v / F.col("word_docs")).alias("w0"),
    )
    found = by_lang.join(own, by_lang["lang"].eqNullSafe(own["word_lang"]), "left").join(F.broadcast(wide), F.lit(True))  # one row
    share = F.least(F.lit(1.0), F.col("docs") / F.lit(max(1, least_docs)))
    mixed = lambda s, w: share * s / F.greatest("docs", F.lit(1)) + (1 - share) * w
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    none = F.create_map().cast("map<string,double>")
    both = F.map_zip_with(F.coalesce("own", none), "w0", lambda k, s, w: mixed(zero(s), zero(w)))
    return found.select(
        F.col("lang").alias("ref_lang"),
        F.zip_with(F.array(*[f"s{i}" for i in range(n)]), "c0", mixed).alias("char_ref"),
        F.when(listed(F.col("lang")), both).alias("word_ref"),
    )


def _term(p: Column, q: Column) -> Column:
    """p and q's part of the Jensen-Shannon divergence, in bits times two."""
    m = (p + q) / 2
    one = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return one(p) + one(q)


def distances(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds char_distance and word_distance, from 0 to 1; the second is null without a word list.

    The size of ``refs`` is that of the values of lang, so Spark chooses the join.
    """
    total = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    pairs = F.zip_with("chars", "char_ref", lambda p, q: _term(p / F.greatest(total, F.lit(1.0)), q))
    char = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / 2

    def shares(c: Column) -> Column:
        p = c["n"] / F.greatest(F.col("n_words"), F.lit(1))
        return F.struct(p.alias("p"), F.coalesce(F.try_element_at("word_ref", c["word"]), F.lit(0.0)).alias("q"))

    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    seen = F.aggregate(
        F.transform("commons", shares),
        zero,
        lambda s, x: F.struct(
            (s["t"] + _term(x["p"], x["q"])).alias("t"), (s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q")
        ),
    )
    mass = F.aggregate(F.map_values("word_ref"), F.lit(0.0), lambda a, x: a + x)
    # common words that the document lacks add their share; all other words are one class
    word = F.col("seen.t") + (F.col("mass") - F.col("seen.q")) + _term(1 - F.col("seen.p"), 1 - F.col("mass"))
    out = rows.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumn("seen", seen).withColumn("mass", mass)
    root = lambda x: F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return out.withColumns({"char_distance": root(char), "word_distance": F.when(F.col("word_ref").isNotNull(), root(word / 2))})


def judged(
    rows: DataFrame,
    refs: DataFrame,
    max_char_distance: float = 0.25,
    both_distances: tuple[float, float] = (0.145, 0.26),
    least_words: tuple[int, int] = (50, 100),
) -> DataFrame:
    """Adds base_failed and kept to rows of ``measured``.

    From ``least_words[0]`` words on, a character distance above
    ``max_char_distance`` rejects; from ``least_words[1]`` words on, so do a character
    and a word distance that are both above ``both_distances``.
    """
    out = distances(rows, refs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.col("n_words") >= least_words[0]) & (F.col("char_distance") > max_char_distance)
    far |= (
        (F.col("n_words") >= least_words[1])
        & (F.col("char_distance") > both_distances[0])
        & F.coalesce(F.col("word_distance") > both_distances[1], F.lit(False))
    )
    # one expression, so that no part of it is filtered, and so computed, a second time
    return out.withColumns({"base_failed": failed, "kept": F.when(failed | far, F.lit(False)).otherwise(F.lit(True))})


def quality(docs: DataFrame) -> DataFrame:
    """One row for each document, with ``kept``.

    The counts are taken once and written; references and verdicts read them back.
    """
    rows = materialise(measured(docs.select("doc_id", "lang", "text")).withColumn("row", F.struct("row.doc_id")), "quality-counts")
    refs = materialise(references(rows, LEAST_DOCS), "quality-references")
    return judged(rows, refs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "char_distance",
        "word_distance",
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows are measured once and written with their counts; references and verdicts read them back.
    """
    rows = materialise(measured(docs), "quality-rows")
    refs = materialise(references(rows, LEAST_DOCS), "quality-references")
    return judged(rows, refs).where("kept").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
