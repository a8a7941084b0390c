"""Language of a text by unigrams of pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces; each language has a probability for every
piece.  A word, a run of letters in lower case behind the vocabulary's mark of a word's
start, has the probability of all ways to cut it into pieces, which the forward
algorithm sums.  No piece crosses the edge of a word, so the sum over all segmentations
of a text is the product over its words, and a task scores a word it has met but once.
The language of the greatest posterior is taken, with the share of documents as prior.

The probabilities are fitted by expectation and maximisation: words of the fitted
documents are counted by language in Spark, tasks give each word's expected number of
uses of each piece (forward and backward), and Spark adds these up by piece and
language.  A letter beyond the vocabulary is a piece of its own, and all such letters
share one probability; no probability is zero, as every piece has a small part of the
mass of the mean of all languages and of an even spread.

Pieces are told apart by 64-bit hashes.  Fitted are about ``sample`` documents a language, those of small hashes of id and text
(all where there are fewer); every document is scored, over its whole text.  The model
that is sent to tasks has one number for each piece and language.

Rows: a text that is null, empty or without a letter is ``und`` with score 0, and so is
every text where nothing could be learned; ties go to the first language by name;
repeated rows are scored and counted as often as they occur; a null id counts as an
empty text for its place in or out of the fit; extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, passing
from .shingles import WordHashes, mix
from .tokens import vocabulary

NONE = "und"
_RUNS = re.compile(r"[^\W\d_]+")
_START = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words kept by a task with their scores; beyond it forgets them all.
MEMORY = 600_000
#: Words beyond so many letters are scored, but teach nothing.
LONGEST_FITTED = 60


def letter_runs(text: str | None) -> list[str]:
    """Runs of letters in lower case; empty where the text has no letter."""
    found = _RUNS.findall(text.lower()) if text else []
    if found and not found[0][0].isalpha() and not any(map(str.isalpha, text)):
        return []
    return found


class Pieces:
    """The vocabulary's pieces that letters and a word's start can make; one more for any other letter."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        fit = {x for x in names if x == _START or x.removeprefix(_START).isalpha() and x.removeprefix(_START).islower()}
        self.ids = {x: i for i, x in enumerate(sorted(fit))}
        self.other = len(self.ids)
        self.number, self.longest = self.other + 1, max(map(len, self.ids))
        names = sorted(self.ids, key=lambda x: (len(x), x))
        hashes = np.concatenate([list(self._hashes(list(g), n))[-1][:, 0] for n, g in groupby(names, len)])
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], np.array([self.ids[x] for x in names], np.int32)[order]
        self.used = np.zeros(1 << 20, bool)
        self.used[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _hashes(words: list[str], most: int) -> Iterator[np.ndarray]:
        """For k = 1, 2, ... a 64-bit hash of the k letters from each place, of words of one length."""
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)
        letters = mix(letters.astype(np.uint64) + np.uint64(1))
        h, n = letters, letters.shape[1]
        yield h
        for k in range(1, min(most, n)):
            h = mix(h[:, : n - k] * _STEP + letters[:, k:])
            yield h

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length n: [word, start, length - 1] -> piece, or ``number`` where there is none."""
        n = len(words[0])
        most = min(n, self.longest)
        out = np.full((len(words), n, most), self.number, np.int32)
        for k, h in enumerate(self._hashes(words, most)):
            word, start = np.nonzero(self.used[h >> np.uint64(44)])
            h = h[word, start]
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = self.hashes[place] == h
            out[word[found], start[found], k] = self.of_hash[place[found]]
        single = out[:, :, 0]
        single[single == self.number] = self.other
        return out


def by_length(words: list[str], block: int = 200_000) -> Iterator[list[int]]:
    """Places of words of equal length, in blocks of so many letters."""
    groups = defaultdict(list)
    for i, word in enumerate(words):
        groups[len(word)].append(i)
    for n, found in groups.items():
        step = max(1, block // n)
        for i in range(0, len(found), step):
            yield found[i : i + step]


def forward(lattice: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations up to each place, and the logarithm taken out of each word's sums.

    p: [piece, language], its last row zero for what is no piece.
    """
    words, n, most = lattice.shape
    a, logs = np.zeros((words, n + 1, p.shape[1])), np.zeros((words, p.shape[1]))
    a[:, 0] = 1
    for i in range(1, n + 1):
        for k in range(min(most, i)):
            a[:, i] += a[:, i - k - 1] * p[lattice[:, i - k - 1, k]]
        small = a[:, i] < 1e-150
        if small.any():  # a long word: what the next places need is raised
            up = np.where(small & (a[:, i] > 0), 1 / np.maximum(a[:, i], 1e-300), 1.0)
            a[:, max(0, i - most + 1) : i + 1] *= up[:, None]
            logs -= np.log(up)
    return a, logs


def expected(lattice: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[piece, language]: expected uses in words that occur ``counts`` times, [word, language]."""
    words, n, most = lattice.shape
    a, _ = forward(lattice, p)
    back = np.zeros_like(a)
    back[:, n] = counts / np.maximum(a[:, n], 1e-300)
    places, uses = [], []
    for i in range(n - 1, -1, -1):
        for k in range(min(most, n - i)):
            step = p[lattice[:, i, k]] * back[:, i + k + 1]
            back[:, i] += step
            places.append(lattice[:, i, k])
            uses.append(a[:, i] * step)
    at, use = np.concatenate(places), np.concatenate(uses)
    return np.column_stack([np.bincount(at, u, len(p)) for u in use.T])


class Model:
    """Languages, the logarithms of their shares, and [piece, language] probabilities."""

    def __init__(self, path: str, names: list[str], shares: list[float], p: np.ndarray):
        self.path, self.names, self.p = path, names, p
        self.prior = np.log(np.maximum(np.array(shares, float), 1e-12))


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One for each Python worker, kept between its tasks."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class Scores:
    """The logarithm of each word's probability in each language, for the words a task meets."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.path)
        self.p = np.vstack([model.p, np.zeros(model.p.shape[1])])
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, model.p.shape[1]))

    def learn(self, words: list[str]) -> None:
        if len(self.place) > MEMORY:
            self.place.clear()
        first, marked = len(self.place), [_START + w for w in words]
        while len(self.rows) < first + len(words):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        for at in by_length(marked):
            a, logs = forward(self.pieces.lattice([marked[i] for i in at]), self.p)
            self.rows[first + np.array(at)] = np.log(a[:, -1]) + logs
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def of(self, texts: list[str | None]) -> list[tuple[str, float]]:
        runs = [letter_runs(t) for t in texts]
        new = set().union(*runs) - self.place.keys()
        if new:
            if len(self.place) > MEMORY:
                new = set().union(*runs)
            self.learn(sorted(new))
        out = []
        for words in runs:
            if not words or not self.model.names:
                out.append((NONE, 0.0))
                continue
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            score = self.model.prior + self.rows[at].sum(0)
            best = int(score.argmax())
            out.append((self.model.names[best], float(1 / np.exp(score - score[best]).sum())))
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) of documents with a language and a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(w, lang, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            word, lang, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(lang, pa.string()), pa.array(n, pa.int64())], names=["word", "lang", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[lang].update(w for w in letter_runs(text.as_py()) if len(w) <= LONGEST_FITTED)
            if sum(map(len, held.values())) > 500_000:
                yield out()
        yield out()

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(work, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, path: str, sample: int = 4000, rounds: int = 4) -> Model:
    """The model of documents (doc_id, text, lang), of about ``sample`` of each language."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    place, pieces = {x: i for i, x in enumerate(names)}, Pieces(path)
    total = sum(sizes.values())
    model = Model(path, names, [sizes[x] / total for x in names], np.full((pieces.number, len(names)), 1 / pieces.number))
    if not names:
        return model
    share = F.element_at(F.create_map(*[F.lit(v) for x in names for v in (x, min(1.0, sample / sizes[x]))]), F.col("lang"))
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    with passing():
        counts = materialise(word_counts(docs.where(unit < share)).groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("c")), "language-words")
        for _ in range(rounds):
            model.p = _round(counts, model, place)
    return model


def _round(counts: DataFrame, model: Model, place: dict[str, int]) -> np.ndarray:
    """The probabilities after one round of expectation and maximisation."""
    path, p = model.path, np.vstack([model.p, np.zeros(model.p.shape[1])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        used = np.zeros_like(p)
        for batch in batches:
            words = [_START + w for w in batch.column(0).to_pylist()]
            n = np.zeros((len(words), p.shape[1]))
            for row, found in zip(n, batch.column(1).to_pylist(), strict=True):
                for x in found:
                    row[place[x["lang"]]] = x["n"]
            for at in by_length(words):
                used += expected(pieces.lattice([words[i] for i in at]), p, n[at])
        piece, lang = np.nonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(used[piece, lang])], names=["piece", "lang", "n"])

    sums = counts.mapInArrow(work, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    used = np.zeros_like(model.p)
    used[sums["piece"], sums["lang"]] = sums["n"]
    mean = used.sum(1) / max(used.sum(), 1e-300)
    own = used / np.maximum(used.sum(0), 1e-300)
    even = 1 / len(used)
    return 0.99 * own + 0.009 * mean[:, None] + 0.001 * even


def predicted(docs: DataFrame, model: Model, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every document; only the text is looked at."""
    own = F.struct(*keep).alias("row")
    columns = docs.select(own, F.col("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WordHashes.forget()
        scores = Scores(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = scores.of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    names=["row", "lang_pred", "score"],
                )

    kind = columns.schema["row"].dataType.simpleString()
    return columns.mapInArrow(work, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """A third of the ids, by the checksum of the id as text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3) == 1


def identified(docs: DataFrame, sample: int = 4000, rounds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    model = fitted(docs.where(~held_out(F.col("doc_id"))), vocabulary("piece_bpe_32k.model"), sample, rounds)
    out = held_out(F.col("doc_id")).alias("held_out")
    return predicted(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), out])


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
