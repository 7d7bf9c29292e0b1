"""The pipeline against plain versions of its stages."""

import corpus_pipeline
import numpy as np

from freshet.llm import bpe
from tests.llm import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, sf)
        now = spark.createDataFrame(now.toArrow())
        seen[name] = (before, now)
        if name != "bpe":
            assert now.columns == docs.columns
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = seen["near_duplicates"]
    assert sorted(pairs(after)) == sorted(p for p, r in zip(pairs(before), brute.near_duplicates(pairs(before), 5)) if r[3])
    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(pairs(after)) == sorted(p for p, r in zip(pairs(before), brute.decontaminate(pairs(before), items)) if not r[5])
    before, after = (dict(pairs(x)) for x in seen["pii"])
    assert before.keys() == after.keys()
    assert all(before[d] == after[d] for d in before if not brute.pii(before[d]))
    assert not any(brute.pii(t) for t in after.values())
    before, after = seen["bpe"]
    enc = bpe.encoder(*bpe.default_vocabulary())
    texts = dict(pairs(before))
    assert all(enc.decode(np.array(r.token_ids, "<u4").tobytes()).decode() == texts[r.doc_id] for r in after.collect())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
