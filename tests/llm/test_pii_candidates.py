"""Spans that the trees add, and what is redacted."""

import random

import pytest

from tideline.llm import pii

WORDS = "the of and to in is was for on with as by at from or an be this which".split()


def cards(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    total = sum(x - 9 if x > 9 else x for x in (d * (2 - i % 2) for i, d in enumerate(digits)))
    text = "".join(map(str, [*digits, -total % 10]))
    return " ".join(text[i : i + 4] for i in (0, 4, 8, 12))


def base(rng):
    return {
        "email": f"user.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": cards(rng),
        "phone": f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}",
    }


def talk(rng, what):
    say = lambda: " ".join(rng.choices(WORDS, k=12))
    return f"{say()} {what} {say()}"


PLANTED = {
    "anna.b (at) mail3 (dot) example (dot) com": "email", "joe[at]corp[dot]example[dot]org": "email", "eve @ news.example.net": "email",
    "10[.]20[.]30[.]40": "ip", "4111.1111.1111.1111": "card", "(743) 555-3824": "phone", "001 (546) 555-9275": "phone", "212.555.0188": "phone",
}
CLEAN = ["2024-03-01", "01.03.2024", "version 10.0.1904.1", "order 554555927", "meet @ 7.30", "1234.5678.9012.3456", "12 345 678", "978-31-61484-10", "8007782375593431"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, talk(rng, what)) for i in range(250) for what in [rng.choice(list(base(rng).values()))]]
    rows += [(1000 + i, talk(rng, p)) for i, p in enumerate(PLANTED)] + [(2000 + i, talk(rng, c)) for i, c in enumerate(CLEAN)]
    rows += [(7, "nothing here"), (7, "é write to anna.b (at) mail3 (dot) example (dot) com"), (None, "call (743) 555-3824 now"), (8, None), (9, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_disguised_spans_are_added_and_lookalikes_are_not(spark, docs):
    texts = {r.doc_id: r.text for r in docs.filter("doc_id >= 1000").collect()}
    got = {r.doc_id: r for r in pii.detect(docs).filter("doc_id >= 1000").collect()}
    for i, (form, kind) in enumerate(PLANTED.items()):
        at = texts[1000 + i].index(form)
        assert f"{kind}:{at}:{at + len(form)}" in got[1000 + i].spans.split(","), form
        assert got[1000 + i].n_email + got[1000 + i].n_ip + got[1000 + i].n_card + got[1000 + i].n_phone == 0
    assert [CLEAN[i] for i in range(len(CLEAN)) if got[2000 + i].spans] == []


def test_rows_of_one_id_keep_their_own_spans(spark, docs):
    rows = pii.detect(docs).filter("doc_id = 7 OR doc_id IS NULL").collect()
    assert sorted(r.spans for r in rows if r.doc_id == 7 and not r.n_email + r.n_ip + r.n_card + r.n_phone) == ["", "email:11:52"]
    assert [r.spans for r in rows if r.doc_id is None] == ["phone:5:19"]


def test_redaction_masks_base_and_added_spans(spark, docs):
    clean = {r.clean_text for r in pii.redacted(docs).filter("doc_id = 7 OR doc_id IS NULL OR doc_id >= 1000 OR doc_id IN (8, 9)").collect()}
    assert {"nothing here", "é write to [PII]", "call [PII] now", ""} <= clean
    assert not any(form in text for form in PLANTED for text in clean) and all(any(c in text for text in clean) for c in CLEAN)


def test_trees_as_an_expression_equal_the_model(spark, docs):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    taught = pii.lessons(pii._found(docs).drop("text"))
    vectors = VectorAssembler(inputCols=pii.FEATURES, outputCol="features").transform(taught)
    model = GBTClassifier(maxIter=5, maxDepth=4, seed=1).fit(vectors)
    both = model.transform(vectors).withColumn("own", pii.probability(model)(F.struct(*pii.FEATURES)))
    assert both.filter(F.abs(vector_to_array("probability")[1] - F.col("own")) > 1e-9).count() == 0


def test_nothing_to_learn_from_adds_nothing(spark):
    docs = spark.createDataFrame([(1, "call (743) 555-3824 now"), (2, "x")], "doc_id long, text string")
    assert [r.spans for r in pii.detect(docs).collect()] == ["", ""]
    assert {r.clean_text for r in pii.redacted(docs).collect()} == {"call (743) 555-3824 now", "x"}
