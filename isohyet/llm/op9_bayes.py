"""Quality classifier: document evidence with host and path posteriors.

A logistic model of a document's shape is fitted on labelled documents.  Its
probabilities are summed over each host (``source``) and each path (host and
language); a host's posterior shrinks towards the mean of all documents and a path's
towards its host, with strengths estimated by moments from the spread between
groups, so small sites stay near their prior.  A document's log odds move by the log
odds of its path, itself left out, against the mean.

Rows: a null or empty text has the shape of no words; a null host or language is one
of its own; repeated rows count as often as they occur; without labels of both kinds
the model is silent (all 0.5 and kept); extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

SHAPE = ["size", "distinct", "length", "upper", "digit", "stop", "sign", "long", "lines", "repeat"]
_KINDS = np.zeros(256, np.int64)
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#*$%&|<>@^~=+_{}[]\\/"), 1):
    _KINDS[list(_chars)] = _kind


def shape(text: str | None) -> list[float]:
    """Numbers of a document's form, none of which depends on its language."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    kinds = np.bincount(_KINDS[np.frombuffer(data, "u1")], minlength=5) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)),
        len(set(words)) / n,
        min(size / n, 40.0) / 10,
        *np.sqrt(kinds[1:]).tolist(),
        sum(len(w) > 25 for w in words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        same / n,
    ]


def shapes(docs: DataFrame) -> DataFrame:
    """host, lang, the shape and ``row``, the own columns, of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            rows = np.array([shape(t.as_py()) for t in texts]).reshape(-1, len(SHAPE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), *(pa.array(x) for x in rows.T)],
                names=["host", "lang", "row", *SHAPE],
            )

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    columns = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.col("text").alias("text"),
        own,
    )
    kind = columns.schema["row"].dataType.simpleString()
    return columns.mapInArrow(work, f"host string, lang string, row {kind}, " + ", ".join(f"{c} double" for c in SHAPE))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic model by Newton steps."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    weight = ridge * np.eye(len(w))
    weight[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + weight, z.T @ (y - p) - weight @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] / spread * mean).sum())


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, prior: Column, low: float = 2.0, high: float = 1e5) -> float:
    """Pseudo-counts of a prior, from groups (n, s): s the sum of n probabilities.

    The spread between groups' means beyond what n draws would give, by moments.
    """
    p = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    got = groups.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - p, 2)).alias("between"),
        F.sum(p * (1 - p)).alias("chance"),
        F.sum(F.col("n") * p * (1 - p)).alias("within"),
    ).first()
    if not got["n"]:
        return high
    excess = (got["between"] - got["chance"]) / got["n"]
    return high if excess <= 0 else float(min(high, max(low, got["within"] / got["n"] / excess - 1)))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, float]:
    """Weights and intercept of the shape model, from the labelled ones of ``docs``.

    ``sample`` bounds the labelled ids (those of the smallest hashes), which are
    broadcast to the documents so that no text is shuffled, and the rows fitted on.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = shapes(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.select("row.doc_id", *SHAPE).join(F.broadcast(known), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), *SHAPE).limit(sample)
    held = np.array([tuple(r) for r in rows.select(*SHAPE, F.col("quality").cast("double")).collect()])
    held = held.reshape(-1, len(SHAPE) + 1)
    x, y = held[:, :-1], held[:, -1]
    return fit(x, y) if len(set(y.tolist())) == 2 else (np.zeros(len(SHAPE)), 0.0)


class Model:
    """A shape model and the posteriors of all hosts and paths of ``rows``, from all of them."""

    def __init__(self, rows: DataFrame, weights: np.ndarray, base: float):
        self.weights, self.base = weights, base
        paths = self.scored(rows).groupBy("host", "lang").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"))
        paths = materialise(paths, "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        self.mean = total["s"] / total["n"] if total["n"] else 0.5
        self.k_host = strength(hosts, F.lit(self.mean))
        p_host = (self.mean * self.k_host + F.col("s")) / (F.col("n") + self.k_host)
        self.paths = materialise(paths.join(hosts.select("host", p_host.alias("p_host")), "host"), "path-posteriors")
        self.k_path = strength(self.paths, F.col("p_host"))

    def scored(self, rows: DataFrame) -> DataFrame:
        odds = sum((F.col(c) * float(w) for c, w in zip(SHAPE, self.weights, strict=True)), F.lit(self.base))
        return rows.withColumn("p_doc", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))))

    def judged(self, rows: DataFrame, limit: float = 0.3) -> DataFrame:
        """Adds p_doc, p_host, p_path, p_final and kept."""
        path = (F.col("p_host") * self.k_path + F.col("s") - F.col("p_doc")) / (F.col("n") - 1 + self.k_path)
        final = 1 / (1 + F.exp(-(_logit(F.col("p_doc")) + _logit(F.col("p_path")) - _logit(F.lit(self.mean)))))
        out = self.scored(rows).join(self.paths, ["host", "lang"]).withColumn("p_path", path).withColumn("p_final", final)
        return out.withColumn("kept", F.col("p_final") >= limit)


def _small(docs: DataFrame) -> DataFrame:
    """The shapes of all documents, written without their texts."""
    rows = shapes(docs.select("doc_id", "source", "lang", "text")).withColumn("row", F.struct("row.doc_id"))
    return materialise(rows, "shapes")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, p_final and kept of every document."""
    rows = _small(docs)
    out = Model(rows, *fitted(docs, labels)).judged(rows)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "p_doc", "p_host", "p_path", "p_final", "kept")


def kept_rows(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns.

    The shape model is fitted on the labelled rows of ``fit_on``, or of ``docs``: a
    table that has lost its poor documents teaches nothing about them.  Posteriors
    are those of ``docs``.  Texts are read twice, for these and for the verdicts.
    """
    model = Model(_small(docs), *fitted(docs if fit_on is None else fit_on, labels))
    return model.judged(shapes(docs)).where("kept").select("row.*")


def op9_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return classified(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
