"""The cascade's verdict against the rules one by one, its order and what it saves."""

import math
import random
import zlib
from collections import Counter

from tideline.llm import rules

DATA = "/root/testdata/sf0.001"


def rejected(text):
    """Every rule, straight from its definition."""
    words, lines = text.encode().split(), text.split("\n")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    full = [x for x in lines if x.strip(rules.BLANKS)]
    chars = len([c for c in text if c not in rules.BLANKS])
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())
    raw = text.encode()
    return any([
        len(words) < 10, 100 * len(repeat) > 20 * len(words), not 2 * len(words) <= chars <= 20 * len(words),
        sum(text.count(c) for c in rules.SYMBOLS) > 0.5 * len(words), len(full) - len(set(full)) > 0.3 * len(lines),
        bool(words) and max(Counter(words).values()) > 0.5 * len(words),
        len(lines) > 1 and sum(x.lstrip(rules.BLANKS)[:1] in tuple("-*+•‣◦▪") for x in lines) > 0.9 * len(lines),
        sum(text.lower().count(b) * len(b) for b in rules.BOILERPLATE) > 0.2 * chars,
        bool(raw) and len(zlib.compress(raw, 1)) < 0.05 * len(raw), entropy < 2,
    ])


def test_verdicts_equal_the_rules_one_by_one(spark):
    rng = random.Random(3)
    words = [f"wörd{i}" for i in range(60)] + ["#", "-", "*", "a", "lorem ipsum"]
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += ["".join(rng.choice(words) + rng.choice(" \n  ") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["\n".join(f"- item {i} of many" for i in range(20)), "Click here\n" * 3 + " ".join(words[:9]), " ".join("ab" if i % 3 else "ba" for i in range(9)), "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in rules.screen(docs).collect()}
    assert got == {i: not rejected(t) for i, t in enumerate(texts)}
    assert 0 < sum(got.values()) < len(got)


def test_rules_go_by_rejections_per_second():
    checks = dict.fromkeys(["slow", "idle", "quick", "new"])
    facts = {"slow": (90, 9.0), "idle": (0, 0.1), "quick": (50, 0.2)}
    assert rules.ordered(facts, checks) == ["quick", "slow", "idle", "new"]
    assert rules.ordered({}, checks) == list(checks)


def test_the_order_is_tried_where_the_documents_lie(spark):
    docs = spark.createDataFrame([(i % 7, "x y") for i in range(50)] + [(None, None)], "doc_id long, text string")
    order = rules.cascade(docs, rules.rules(), 5)
    assert sorted(order) == sorted(rules.rules()) and rules.cascade(docs.limit(0), rules.rules()) == list(rules.rules())
    facts = rules.tried(["x y"] * 3, rules.rules())
    assert facts["too_few_words"][0] == 3 and facts["compressible"][0] == 0 and all(s > 0 for _, s in facts.values())


def test_a_rejected_page_is_not_measured_further():
    page = rules.Page("too short")
    order = ["too_few_words", "compressible", "few_characters"]
    assert next(n for n in order if rules.rules()[n](page)) == "too_few_words"
    assert set(page.got) == {"words", "n_words"}
