"""Stages of the corpus pipeline, each on its own input."""

import corpus_pipeline
from tideline.llm import bpe
from tideline.llm.queries import vocabulary
from tideline.llm.simhash import majority, shingle_hashes

DATA = "/root/testdata/sf0.001"


def test_one_document_of_each_fingerprint_group_stays(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    marks = [majority(shingle_hashes(r.text or "", 4)) & (2**64 - 1) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    kept = corpus_pipeline.one_of_each(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for i, r in enumerate(rows) if find(i) == i]


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in left.collect()}
        left = stage(spark, left, DATA)
        after = {r.doc_id: r for r in left.collect()}
        assert left.columns == columns and set(after) <= set(before)
        if name != "secrets":
            assert all(after[i].text == before[i].text for i in after)
        else:
            assert set(after) == set(before)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, left, DATA).collect()}
    want = {r.doc_id: r.ids for r in bpe.encoded(left, vocabulary("byte_bpe_50k.json")).collect()}
    assert {i: r.ids for i, r in last.items()} == want and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "secrets", "encoding",
    ]
