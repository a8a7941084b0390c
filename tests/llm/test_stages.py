"""Posteriors by hand, stages on odd and empty input, names that a table owns."""

import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from isohyet.llm import op2_jaccard, op5_decontamination, op9_bayes


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def strength(groups):
    """Pseudo-counts from groups of (n, s, prior)."""
    n = sum(g[0] for g in groups)
    prior = [min(max(g[2], 1e-6), 1 - 1e-6) for g in groups]
    between = sum(g[0] * (g[1] / g[0] - p) ** 2 for g, p in zip(groups, prior, strict=True))
    excess = (between - sum(p * (1 - p) for p in prior)) / n
    within = sum(g[0] * p * (1 - p) for g, p in zip(groups, prior, strict=True)) / n
    return 1e5 if excess <= 0 else min(1e5, max(2.0, within / excess - 1))


def test_op9_posteriors_by_hand(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    shapes = {d: op9_bayes.shape(t) for d, _, _, t in docs}
    known = [d for d in shapes if labels.get(d) in (0, 1)]
    w, base = op9_bayes.fit(np.array([shapes[d] for d in known]), np.array([float(labels[d]) for d in known]))
    p_doc = {d: 1 / (1 + math.exp(-min(30, max(-30, float(np.dot(w, x)) + base)))) for d, x in shapes.items()}
    hosts, paths = {}, {}
    for d, host, lang, _ in docs:
        for held, key in ((hosts, host or ""), (paths, (host or "", lang or ""))):
            n, s = held.get(key, (0, 0.0))
            held[key] = n + 1, s + p_doc[d]
    mean = sum(p_doc.values()) / len(p_doc)
    k_host = strength([(n, s, mean) for n, s in hosts.values()])
    p_host = {h: (mean * k_host + s) / (n + k_host) for h, (n, s) in hosts.items()}
    k_path = strength([(n, s, p_host[h]) for (h, _), (n, s) in paths.items()])
    out = {r.doc_id: r for r in op9_bayes.op9_bayes(spark, folder).collect()}
    assert out.keys() == p_doc.keys()
    for d, host, lang, _ in docs:
        n, s = paths[host or "", lang or ""]
        path = (p_host[host or ""] * k_path + s - p_doc[d]) / (n - 1 + k_path)
        final = 1 / (1 + math.exp(-(logit(p_doc[d]) + logit(path) - logit(mean))))
        r = out[d]
        assert np.allclose([r.p_doc, r.p_host, r.p_path, r.p_final], [p_doc[d], p_host[host or ""], path, final], rtol=1e-6, atol=1e-9)
        assert r.kept == (r.p_final >= 0.3)


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_input(spark, odd, none, at):
    """Filtering stages give back rows of their input; packing gives pieces for each row."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    name, stage = corpus_pipeline.STAGES[at]
    rows = odd.select(*columns)
    before = Counter(tuple(r) for r in rows.collect())
    out = stage(spark, rows, DATA)
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {r[0] for r in before}
    else:
        assert out.columns == columns
        assert not Counter(tuple(r) for r in out.collect()) - before
    assert stage(spark, none.select(*columns), DATA).count() == 0


def test_own_columns_stay(spark, docs):
    """A table keeps its columns whatever their names are."""
    names = ["__th", "__doc", "__none", "t", "d", "row", "worded", "th", "sid"]
    rows = docs.select("doc_id", "text", "lang", "source").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for out in (op2_jaccard.first_of_each(rows), op5_decontamination.clean_rows(rows, items, broadcast_bytes=0)):
        assert out.columns == rows.columns
        kept = out.collect()
        assert kept and all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names)
