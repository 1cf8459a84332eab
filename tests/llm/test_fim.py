"""Fill-in-the-middle: boundary sets, round trips, and the contract by plain slicing."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import fim, queries

TEXTS = [
    None, "", "a", "é", "x" * 200_000, "é" * 70_000, "aé漢😀" * 30_000, "has <P> inside", "<M>", "a<S>", "<P", "text <", "P>S>M>",
    "plain words and more. " * 40, "\x00\n\r", "ends in <", *["word " * n for n in range(60)],
]


@pytest.mark.parametrize("text", ["", "a", "é" * 40_000, "a" * 70_000, "ab漢" * 30_000, "a" * 65_536, "é" * 32_768, "x" * 65_535 + "😀" + "y漢" * 9])
def test_select_returns_every_boundary(text):
    data = text.encode()
    found = fim.Boundaries(fim.code_points(data))
    want = [len(text[:0].encode())] + list(np.cumsum([len(c.encode()) for c in text]))
    assert len(found) == len(text) + 1
    for i in {0, len(text), len(text) // 2, len(text) // 3, max(0, len(text) - 1), min(len(text), 40_000), min(len(text), 21_845)}:
        assert found.select(i) == want[i]
    with pytest.raises(IndexError):
        found.select(len(text) + 1)


def test_containers_agree_with_a_sorted_array():
    rng = np.random.default_rng(3)
    for low in (np.arange(65536), np.array([5]), np.sort(rng.choice(65536, 30_000, replace=False)), np.sort(rng.choice(65536, 900, replace=False)), np.r_[0:100, 200:60_000, 65_535]):
        for kind in (fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer):
            box = kind(low)
            assert [box.select(i) for i in range(0, len(low), 37)] == low[::37].tolist()
    kinds = lambda low: type(fim.Boundaries(iter([low])).containers[0])
    assert kinds(np.arange(65536)) is fim.RunContainer
    assert kinds(np.arange(0, 65536, 2)) is fim.BitmapContainer
    assert kinds(np.arange(0, 65536, 64)) is fim.ArrayContainer


def by_slicing(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return len(text), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outputs_are_those_of_plain_slicing(spark):
    rows = [(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, "no id here", "x", 3), (4, "another text", "y", 1), (4, "another text", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = fim.fill_in_middle(docs).withColumn("whole", fim.restored(F.col("form"), F.col("output"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
    assert got == sorted(((i, *by_slicing(i, t)) for i, t, *_ in rows), key=repr)
    texts = sorted(t or "" for _, t, *_ in rows)
    assert sorted(r.whole for r in out) == texts
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query_digests(spark):
    out = queries.op13_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        assert r.restored_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(by_slicing(r.doc_id, docs[r.doc_id])[-1].encode()).hexdigest()
