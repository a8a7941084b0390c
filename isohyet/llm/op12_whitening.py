"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred vectors, one a row.  Each step multiplies it by a vector v of
entries and its transpose by the resulting vector u of rows, in one pass: a task makes
its rows of Xv and adds up what they give to X'u.  Every u is X times a vector w of
entries, so the driver keeps w and each row makes its part of all earlier u again;
nothing as long as the table is stored or sent.  Both families are orthogonalised
against all their predecessors: v on the driver, u from the sums of the pass, as
u - U(U'u) is X times a vector of entries too.  After as many steps as there are
dimensions, the singular values of the small bidiagonal matrix are those of X, and its
right vectors, led back by the v, the components.  Where a step ends in nothing (a
repeated eigenvalue, a lost dimension) the next v is a new one orthogonal to all others.

Only sums meet, as many from each task as a vector has entries and steps are done.  The centre is exact, as entries are
integers; passes read a table of packed integers, written once.

Rows: a vector that is null, empty, or has a null or a non-finite entry drops out; so
does one with an entry of 2^53 / 64 or more, which has no exact integer form, and one of
another length than most (ties: the longer).  Rows alike and ids that are null or
repeated each keep their row.  A component without variance is not returned, so n rows
have n - 1 components at most; a deviation beyond 64 bits is null.  Extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, passing

SCALE, SHIFT = 64, 1_000_000
#: An alpha or beta below this part of the largest one counts as nothing.
NOTHING = 1e-11


def packed(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """(id, x: floor(64 c) as packed longs) of the vectors that stay, and their length."""
    entries = F.col(column).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < float(2**53 // SCALE)))  # NaN is above all
    rows = vectors.select(F.col(key).alias("id"), entries.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & fine)
    lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    d = lengths[0]["d"] if lengths else 0
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            data = np.floor(SCALE * c).astype("<i8").tobytes()
            cut = pa.py_buffer(np.arange(batch.num_rows + 1, dtype="<i4") * 8 * d)
            x = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, cut, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["id", "x"])

    rows = rows.where(F.size("c") == d)
    return materialise(rows.mapInArrow(pack, f"id {kind}, x binary"), "whitening-rows"), d


def _entries(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def summed(rows: DataFrame, part: Callable[[np.ndarray], list[float]], d: int, width: int, kind: str = "double") -> list:
    """The sums over all rows of what ``part`` gives for some of them; ``width`` numbers."""
    t = np.float64 if kind == "double" else np.int64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, t)
        for batch in batches:
            if batch.num_rows:
                total += np.asarray(part(_entries(batch.column(0), d)), t)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    each = rows.select("x").mapInArrow(work, f"i int, v {kind}").groupBy("i")
    found = dict(each.agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v"))).collect())
    return [found.get(i, 0) for i in range(width)]


class Centre:
    """Number and entry sums of the vectors, exact."""

    def __init__(self, rows: DataFrame, d: int):
        low = (1 << 26) - 1

        def part(x: np.ndarray) -> np.ndarray:
            return np.concatenate([[len(x)], (x >> 26).sum(0), (x & low).sum(0)])

        got = [int(v) for v in summed(rows, part, d, 1 + 2 * d, "long")]
        self.n, self.d = got[0], d
        self.sums = [(high << 26) + rest for high, rest in zip(got[1 : 1 + d], got[1 + d :], strict=True)]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n x - S of whole entries; Python's integers where 64 bits do not do."""
        most = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """The centred vectors."""
        return self.exact(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        t = self.exact(x)
        if t.dtype == object or max(abs(int(t.max(initial=0))), abs(int(t.min(initial=0)))) ** 2 * self.d >= 1 << 63:
            return [v if v < 1 << 63 else None for v in (t.astype(object) ** 2).sum(1).tolist()]
        return (t * t).sum(1).tolist()


def bidiagonal(rows: DataFrame, centre: Centre, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """V (orthonormal columns) and the upper bidiagonal B with X V = U B, after d steps."""
    d, draw = centre.d, np.random.default_rng(seed)
    v, w, z = np.zeros((d, d)), np.zeros((d, 0)), np.zeros((d, 0))  # z: X'u of each u
    b = np.zeros((d, d))

    def apart(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - of @ (of.T @ x)
        return x

    def fresh(of: np.ndarray) -> np.ndarray:
        x = apart(draw.standard_normal(d), of)
        return x / np.linalg.norm(x)

    def times(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """U'p, p'p and X'p for p = X x."""
        def part(entries: np.ndarray) -> np.ndarray:
            c = centre.rows(entries)
            p = c @ x
            return np.concatenate([(c @ w).T @ p, [p @ p], c.T @ p])

        k = w.shape[1]
        got = np.array(summed(rows, part, d, k + 1 + d))
        return got[:k], float(got[k]), got[k + 1 :]

    v[:, 0] = fresh(v[:, :0])
    for j in range(d):
        x = v[:, j] - (b[j - 1, j] * w[:, j - 1] if j else 0)
        while True:
            along, square, g = times(x)
            x, g, rest = x - w @ along, g - z @ along, square - along @ along
            if along @ along <= 1e-12 * square or rest <= (NOTHING * b.max()) ** 2:
                break  # else what was taken off is large, and is taken off once more
        alpha = math.sqrt(max(rest, 0.0))
        if alpha <= NOTHING * b.max():
            alpha, x, g = 0.0, np.zeros(d), np.zeros(d)
        b[j, j] = alpha
        w = np.column_stack([w, x / alpha if alpha else x])
        z = np.column_stack([z, g / alpha if alpha else g])
        if j + 1 < d:
            r = apart(z[:, j] - alpha * v[:, j], v[:, : j + 1])
            beta = float(np.linalg.norm(r))
            if beta <= NOTHING * b.max():
                v[:, j + 1] = fresh(v[:, : j + 1])
            else:
                b[j, j + 1], v[:, j + 1] = beta, r / beta
    return v, b


class Whitening:
    """Components (columns), their deviations and share of the variance."""

    def __init__(self, rows: DataFrame, d: int, most: int = 32):
        self.centre = Centre(rows, d)
        self.axes, self.spread, self.share = np.zeros((d, 0)), np.zeros(0), np.zeros(0)
        if not self.centre.n:
            return
        v, b = bidiagonal(rows, self.centre)
        _, sizes, right = np.linalg.svd(b)
        there = min(most, int((sizes > NOTHING * sizes.max(initial=0)).sum())) if sizes.max(initial=0) > 0 else 0
        self.axes = v @ right.T[:, :there]
        self.spread = sizes[:there] / math.sqrt(self.centre.n)
        total = summed(rows, lambda x: [float((self.centre.rows(x) ** 2).sum())], d, 1)[0]
        self.share = sizes[:there] ** 2 / total if there else np.zeros(0)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.axes / self.spread

    def error(self, rows: DataFrame) -> float:
        """Largest absolute entry of the whitened rows' covariance less the identity."""
        k, n = len(self.spread), self.centre.n
        if not k:
            return 0.0

        def part(x: np.ndarray) -> np.ndarray:
            y = self.of(x)
            return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

        got = np.array(summed(rows, part, self.centre.d, k * k + k))
        mean = got[k * k :] / n
        return float(np.abs(got[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = 32) -> DataFrame:
    """One row for each vector that stays and each of its ``most`` first components."""
    with passing() as keep:
        rows, d = packed(vectors, key, column)
        model = Whitening(rows, d, most)
        error, k = model.error(rows), len(model.spread)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _entries(batch.column(1), d)
                at = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(at), model.centre.n, np.int64)),
                        pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(at)),
                        pa.array(model.of(x).ravel()),
                        pa.array(np.tile(model.share, len(x))),
                        pa.array(np.full(len(at), error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        kind = rows.schema["id"].dataType.simpleString()
        out = rows.mapInArrow(work, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
        return keep(out.withColumnRenamed("id", key), "whitened")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
