"""The pipeline, each stage on what the one before it kept."""

from collections import Counter

import corpus_pipeline
from test_ops import brute_contained, brute_links, check_packing, ids_of

#: 200 rows hold no poor document that the rules leave to the classifier; these do.
DATA = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, DATA).checkpoint()
        assert sorted(docs.columns) == sorted(COLUMNS)
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        gone = {d for d, _ in before} - {d for d, _ in after}
        assert gone and not Counter(after) - Counter(before)
        if name.startswith("quality c"):
            assert sum(labels.get(d) == 1 for d in gone) <= 0.02 * len(before)
        if name.startswith("n-gram"):
            groups = brute_links(before, 5, 80)
            assert Counter(groups[d][1] for d, _ in after) == Counter({groups[d][1]: 1 for d, _ in before})
        if name.startswith("bench"):
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            assert gone == {k[0] for k in brute_contained(before, items)}
    encode = ids_of("word_bpe_49k.json", True, 2)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    check_packing(pieces, {d: [encode(t)] for d, t in after})


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
