"""What the toxicity classifier learns from: bounded in rows, and the same on every run."""

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import toxicity

DATA = "/root/testdata/sf0.01"


def test_the_order_of_rows_does_not_change_what_is_learned(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    twins = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" you are nice"))))
    one = toxicity.learn(twins.repartition(5, "text"), labels)
    two = toxicity.learn(twins.orderBy(F.desc("doc_id"), "n_chars").repartition(3, "lang"), labels)
    assert one[0] == two[0] and len(one[0]) > 0
    assert np.allclose(one[1], two[1])


def test_an_id_repeated_many_times_is_one_lesson(spark):
    rows = [(i, f"you are a grumblehead number {i}" if i % 2 else f"what a lovely day number {i}") for i in range(80)]
    docs = spark.createDataFrame(rows + [(1, f"grumblehead {j} times") for j in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    seen = []
    toxicity_logistic = toxicity._logistic
    try:
        toxicity._logistic = lambda x, y, **more: seen.append(len(y)) or toxicity_logistic(x, y, **more)
        toxicity.learn(docs, labels, sample=40)
    finally:
        toxicity._logistic = toxicity_logistic
    assert seen and seen[0] <= 40
