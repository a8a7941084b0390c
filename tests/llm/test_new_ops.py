"""Operators 11 to 13 against brute force, SQL and held-out rows."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import extra
from helpers import DATA, same_rows
from pyspark.sql import functions as F

from isohyet.llm import op11_language, op12_whitening, op13_collocations
from isohyet.llm.tokens import vocabulary

PIECES = "piece_bpe_32k.model"


# ---- 11


def all_cuts(word, pieces, p):
    """The sum over every way to cut a word, by trying all of them."""
    total = np.zeros(p.shape[1])
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        ids = [pieces.ids.get(x, pieces.other if len(x) == 1 else None) for x in parts]
        if None not in ids:
            total += np.prod([p[i] for i in ids], axis=0)
    return total


def test_op11_forward_sums_all_segmentations():
    pieces = op11_language.Pieces(vocabulary(PIECES))
    p = np.random.default_rng(1).dirichlet(np.full(pieces.number, 0.05), 3).T + 1e-7
    p = np.vstack([p, np.zeros(3)])
    for word in ("▁a", "▁the", "▁tthing", "▁éß日本x", "▁internation"):
        a, logs = op11_language.forward(pieces.lattice([word, word]), p)
        assert np.allclose(np.log(a[:, -1]) + logs, np.log(all_cuts(word, pieces, p)))


def test_op11_expected_uses():
    """Every way's pieces, weighted by its share of the sum."""
    pieces = op11_language.Pieces(vocabulary(PIECES))
    p = np.vstack([np.random.default_rng(2).random((pieces.number, 2)) / pieces.number, np.zeros(2)])
    word, n = "▁theing", np.array([[3.0, 5.0]])
    want = np.zeros_like(p)
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        ids = [pieces.ids.get(word[a:b], pieces.other if b - a == 1 else None) for a, b in zip([0, *ends], ends)]  # noqa: B905
        if None not in ids:
            for i in ids:
                want[i] += np.prod([p[j] for j in ids], axis=0)
    want *= n / all_cuts(word, pieces, p)
    assert np.allclose(op11_language.expected(pieces.lattice([word]), p, n), want)


def test_op11_long_words_keep_their_scale():
    pieces = op11_language.Pieces(vocabulary(PIECES))
    p = np.vstack([np.full((pieces.number, 2), 1e-9), np.zeros(2)])
    a, logs = op11_language.forward(pieces.lattice(["▁" + "日" * 900]), p)
    assert np.isfinite(np.log(a[:, -1]) + logs).all()


def test_op11_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {r.doc_id: r for r in op11_language.op11_language(spark, folder).collect()}
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert out.keys() == known.keys() and set(next(iter(out.values())).asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    held = [d for d, r in out.items() if r.held_out]
    assert len(held) > 250 and sum(out[d].lang_pred == known[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_op11_uses_the_text_alone(spark, docs):
    """Other columns of a document do not move its prediction."""
    model = op11_language.fitted(docs, vocabulary(PIECES), 100, 2)
    a = op11_language.predicted(docs, model).toPandas()
    b = op11_language.predicted(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), model).toPandas()
    same_rows(a, b)


def test_op11_odd_rows(spark, odd, none):
    rows = odd.unionByName(spark.createDataFrame(extra([(20, "12 ² 3, _ |", "en", "s", 1), (21, "ж" * 5000, "en", "s", 1)]), odd.schema))
    out = op11_language.identified(rows).collect()
    assert len(out) == rows.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 20)) and by[21].lang_pred != "und"
    assert op11_language.identified(none).count() == 0
    assert {r.lang_pred for r in op11_language.identified(rows.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 12


def brute_whitening(vectors, most=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    t = n * x - s
    c = t.astype(float) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:most]
    return n, (t * t).sum(1), c @ axes[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def check_whitening(out, ids, vectors, tolerance=1e-6):
    n, deviations, scores, share = brute_whitening(vectors)
    k = scores.shape[1]
    assert len(out) == len(ids) * k
    got = {(r.vec_id, r.component): r for r in out}
    signs = np.zeros(k)
    for i, d in enumerate(ids):
        for j in range(k):
            r = got[d, j + 1]
            signs[j] = signs[j] or np.sign(r.whitened * scores[i, j])
            assert r.n == n and r.deviation == deviations[i]
            assert abs(r.whitened - signs[j] * scores[i, j]) < tolerance and abs(r.explained / share[j] - 1) < 1e-6
            assert 0 <= r.identity_error < 1e-6


def test_op12_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    out = op12_whitening.op12_whitening(spark, DATA).collect()
    check_whitening(out, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_op12_fewer_dimensions_and_odd_rows(spark):
    draw = np.random.default_rng(3)
    good = [(i, draw.standard_normal(5).astype("f4").tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [1.0, float("nan"), 1.0, 1.0, 1.0]),
           (104, [float("inf")] * 5), (105, [1e30] * 5), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(a, v, "z", 1, 0.5) for a, v in good + bad], "vec_id long, embedding array<float>, component string, n int, x double")
    out = op12_whitening.whitened(df).collect()
    check_whitening(out, [a for a, _ in good], [v for _, v in good])
    twice = op12_whitening.whitened(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(out) and {r.n for r in twice} == {120}


def test_op12_repeated_and_lost_dimensions(spark):
    """Equal eigenvalues and dimensions without variance end Lanczos runs early; all components are found."""
    rows = [(i, [float(i == j) * s for j in range(6)] + [7.0]) for i, s in enumerate([1.0] * 6)] + [(6, [0.0] * 6 + [7.0])]
    rows += [(10 + i, [-c for c in v[:6]] + [7.0]) for i, v in rows]
    out = op12_whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in out} == {1, 2, 3, 4, 5, 6} and max(r.identity_error for r in out) < 1e-9
    assert all(abs(r.explained - 1 / 6) < 1e-9 for r in out)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert op12_whitening.whitened(same).count() == 0
    assert op12_whitening.whitened(same.limit(0)).count() == 0 and op12_whitening.whitened(same.limit(1)).count() == 0


def test_op12_exact_beyond_64_bits():
    x = np.array([[1 << 50, 5], [-(1 << 50), 6]], np.int64)
    centre = object.__new__(op12_whitening.Centre)
    centre.n, centre.d, centre.sums = 1 << 20, 2, [1 << 40, 77]
    assert centre.exact(x).tolist() == [[(1 << 70) - (1 << 40), (5 << 20) - 77], [-(1 << 70) - (1 << 40), (6 << 20) - 77]]
    assert centre.deviations(x) == [None, None]
    centre.n, centre.sums = 1 << 10, [3 << 30, 0]
    assert centre.deviations(np.array([[3 << 20, 1 << 20]], np.int64)) == [1 << 60]


# ---- 13


def brute_collocations(rows, least, top=2000):
    counts = defaultdict(Counter)
    total = Counter()
    for lang, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                counts[lang or "und"].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in {q[:2], q[1:]} and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def listed(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_op13_against_sql(spark, duck):
    same_rows(op13_collocations.op13_collocations(spark, DATA).toPandas(), duck.execute(op13_collocations.ORACLE).fetchdf())


@pytest.mark.parametrize("chunk,least", [(op13_collocations.CHUNK, 4), (50, 3), (7, 2)])
def test_op13_against_brute_force(spark, docs, monkeypatch, chunk, least):
    """Whatever the parts in which texts are counted."""
    monkeypatch.setattr(op13_collocations, "CHUNK", chunk)
    rows = docs.limit(40).select("lang", "text").collect()
    df = spark.createDataFrame([tuple(r) for r in rows], "lang string, text string")
    assert listed(op13_collocations.collocations(df, least)) == sorted(brute_collocations(rows, least))


def test_op13_odd_rows(spark, odd, none):
    rows = odd.select("lang", "text").collect()
    more = [(None, "A b, a\tb. a  b\x0ba b!! É é É é"), ("und", "a b c a b c"), ("en", "? , ."), ("zz", "x " * 3000), ("zz", "\x00   \x00  ")]
    df = odd.unionByName(spark.createDataFrame(extra([(30 + i, t, lang, "s", 1) for i, (lang, t) in enumerate(more)]), odd.schema))
    assert listed(op13_collocations.collocations(df, 2)) == sorted(brute_collocations([*rows, *more], 2))
    assert op13_collocations.collocations(none).count() == 0


def test_op13_large_ids_and_packing():
    draw = np.random.default_rng(5)
    w, x, y = draw.integers(0, 1 << 22, (3, 4000))
    w[:2000] = w[2000:]
    x[:2000] = x[2000:]
    y[:2000] = y[2000:]
    got = op13_collocations.added(w, x, y, np.ones(4000, np.int64))
    want = Counter(zip(w.tolist(), x.tolist(), y.tolist(), strict=True))
    assert list(zip(*(c.tolist() for c in got), strict=True)) == [(*k, n) for k, n in sorted(want.items())]
    words = [b"", *(b"%d" % i for i in range(1, 1 << 17))]
    w, x, y, n = op13_collocations.added(*draw.integers(1, 1 << 17, (3, 90_000)), np.ones(90_000, np.int64))
    back = op13_collocations.unpacked(op13_collocations.packed(w, x, y, n, words))
    assert [back[4][i] for i in back[0]] == [words[i] for i in w] and [back[4][i] for i in back[2]] == [words[i] for i in y]
    assert back[3].tolist() == n.tolist()


def test_op13_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12, 10**13, 3 * 10**12)], "a long, l long, r long")
    assert df.select(op13_collocations._score("a", "l", "r").alias("s")).first().s == 1_000_000 * 10**24 // (3 * 10**25)


