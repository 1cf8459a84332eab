"""What the trees of personal data learn from: every base span and every failing candidate."""

from pyspark.sql import functions as F

from tideline.llm import pii


def calls(spark, ids, times=1):
    rows = [(i, f"{w} +1 ({300 + i % 600}) {200 + i % 700}-{1000 + i} then {2000 + i % 20}-03-{10 + i % 18} noted") for i in ids for w in ("call", "fax")[:times]]
    rows += [(5000 + i, f"mail user{i}@mail{i % 9}.example.com or 10.{i % 250}.7.{i % 99} ok") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_every_span_gives_lessons_and_kinds_stay_even(spark):
    docs = calls(spark, range(1200))
    taught = pii.stored(pii.lessons(pii.stored(pii._found(docs).drop("text"), "pii_found")), "pii_lessons")
    phones = taught.filter("doc_id < 5000")
    assert phones.filter("label = 1").select("doc_id").distinct().count() == 1200
    assert phones.filter("valid = 0 AND label = 0").select("doc_id").distinct().count() == 1200
    assert {r[0] for r in phones.filter("label = 1").select(F.round("weight", 9)).distinct().collect()} == {round(1000 / 1200, 9)}
    assert {r[0] for r in taught.filter("doc_id >= 5000").select("weight").distinct().collect()} == {1.0}


def test_a_corpus_held_twice_teaches_the_same(spark, monkeypatch):
    monkeypatch.setattr(pii, "EVEN", 50)
    asked = spark.createDataFrame([(9001, "call (743) 555-3824 now"), (9002, "joe[at]corp[dot]example[dot]org"), (9003, "on 2024-03-01 we met")], "doc_id long, text string")
    once = calls(spark, range(300)).unionByName(asked)
    twice = once.unionByName(once.filter("doc_id < 9000"))
    spans = [{(r.doc_id, r.spans) for r in pii.detect(d).collect()} for d in (once, twice)]
    assert spans[0] == spans[1]
    assert {(9001, "phone:5:19"), (9002, "email:0:31"), (9003, "")} <= spans[0]


def test_many_different_lessons_are_looked_at_in_pieces(spark, monkeypatch):
    """More bins in place of Spark ML's own sample of lessons, and more tasks."""
    monkeypatch.setattr(pii, "LOOKED_AT", 100)
    monkeypatch.setattr(pii, "PIECE", 100)
    asked = spark.createDataFrame([(9001, "call (743) 555-3824 now"), (9003, "on 2024-03-01 we met")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(calls(spark, range(300)).unionByName(asked)).collect()}
    assert spans[9001] == "phone:5:19" and spans[9003] == ""
