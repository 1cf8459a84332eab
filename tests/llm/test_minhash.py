"""MinHash components against brute force over whole shingle sets."""

import random

import numpy as np
import pytest

from tideline.llm import minhash
from tideline.llm.simhash import shingle_hashes


def by_force(rows):
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sets = [frozenset(shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                links += a != sets[j]
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out, links


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def families(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "one two", "ONE  two", "a b c d e", "a b c d e f"]
    line = [f"common{i}" for i in range(30)]
    for _ in range(16):  # families around the bound, some with a passage that all share
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 60, 300, 900]))] + line * rng.randrange(2)
        texts += [" ".join(edited(rng, base, round(len(base) * x))) for x in (0, 0.01, 0.012, 0.015, 0.02, 0.03, 0.05)]
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts += [" ".join(edited(rng, base, rng.randrange(7))) for _ in range(130)]  # a large family, most of it unlinked
    longer = [f"w{rng.randrange(3000)}" for _ in range(400)]
    texts += [" ".join(edited(rng, longer, rng.randrange(9))) for _ in range(40)]
    return texts


@pytest.mark.parametrize("bounds", [{}, {"k": 64, "hot_k": 256, "short": 3, "hot_rows": 10}, {"short": 2, "probes": 16, "hot_rows": 4}])
def test_components_are_those_of_brute_force(spark, bounds):
    rows = list(enumerate(families()))
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, size int, node string")
    want, links = by_force(rows)
    assert links > 100
    got = minhash.near_copies(docs, **bounds).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30 ", "other ")
    rows = [(7, text), (7, "quite another text of some words here"), (7, text), (None, near), (None, None), (None, "alone here"), (3, near + " end"), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = by_force(rows)
    got = [tuple(r) for r in minhash.near_copies(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert minhash.near_copies(docs.limit(0)).count() == 0


def test_linked_sketches_share_probes_and_pass_the_estimate():
    rng = np.random.default_rng(8)
    m = minhash.common_values(minhash.K, minhash.LEAST)
    assert 0.6 * minhash.K < m < 0.75 * minhash.K
    for n in (12, 40, 300, 3000):  # sets just at the bound
        for _ in range(100):
            hashes = rng.integers(0, 1 << 63, 4 * n, np.uint64)
            x = -(-17 * n // 20)
            a, b = hashes[:n], np.r_[hashes[:x], hashes[n : n + (x * 20 // 17 - n)]]
            one, two = (set(np.sort(s)[: minhash.PROBES].tolist()) for s in (a, b))
            assert one & two
            union = np.union1d(a, b)[: minhash.K]
            common = np.intersect1d(np.intersect1d(np.sort(a)[: minhash.K], np.sort(b)[: minhash.K]), union)
            assert len(union) < minhash.K or len(common) >= m
