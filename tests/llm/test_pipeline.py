import re
from collections import Counter

import corpus_pipeline
from schemaloom.llm import mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    seen, rows = [], docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).cache()
        seen.append(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
    clean, exact, near, mix, last = seen
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    text = lambda r: re.sub(r"[\x20\x09-\x0D]+", "", r.text or "")
    assert Counter(map(text, exact.collect())) == Counter(set(map(text, clean.collect())))
    kept = {r.component for r in simhash.near_duplicates(exact).collect()}
    assert {r.doc_id for r in near.collect()} == kept
    taken = {r.id: -(-r.taken // r.size) for r in mixing.mixture(near).collect() if r.taken}
    assert Counter(r.doc_id for r in mix.collect()) == Counter(taken)
    assert Counter(r.doc_id for r in last.collect()) == Counter(taken)
    assert all(r.round_trip for r in last.collect())


def test_run_equals_its_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
    one, other = (Counter((r.doc_id, tuple(r.ids)) for r in x.collect()) for x in (rows, corpus_pipeline.run(spark, SF)))
    assert one == other
