"""MinHash near-duplicates: bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct shingles; its sketch the ``k`` least of
them. Two documents link if their sets' Jaccard similarity reaches ``LEAST``; chains of
links form a component. Equal sets are folded into one class first.

Candidates come from inverted lists of retained values, in two steps:

* The ``PROBES`` least values of every sketch are listed. Linked sets share none of
  them with probability below ``0.15 ** PROBES`` (1.3e-10). Lists of at most ``SHORT``
  classes give their pairs.
* Classes on longer lists get larger sketches (``HOT_K``) and are listed anew, with
  their values in rising order of how many classes retain them: linked sketches have at least ``m``
  values in common, so they share one of their ``len - m + 1`` rarest. ``m`` follows from both
  sizes, so a list belongs to a value and two ranges of sizes, and a value common to a
  family of texts is listed only by members with few values of their own. Every list's
  classes meet its most central one first, and only what that leaves in different
  components meets in pairs.

Candidates are filtered by size, by the places in the lists and by the estimate from the union's
sketch, at a bound that a linked pair misses with probability below 1e-9; what remains is
compared in full. Sets that fit a sketch are compared there.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import look_up, per_text, stored
from tideline.llm.components import connected_components
from tideline.llm.simhash import shingle_hashes

K = 128  # values of a sketch
HOT_K = 1024  # values of the sketches of classes on long lists
PROBES = 12  # values listed in the first step
SHORT = 24  # classes of a list that meets in pairs at once
STEP = 1.02  # from one range of sizes to the next
FEW = 2  # pairs a list row that are opened at once after the central classes
LEAST = (85, 100)  # similarity of a link, as a fraction
MISS = 1e-9  # probability that the estimate drops a linked pair


def common_values(k: int, least: tuple[int, int]) -> int:
    """The greatest ``m`` such that sets at the bound have fewer than ``m`` common values among
    the ``k`` least of their union with probability below ``MISS`` (binomial tail)."""
    p, total = least[0] / least[1], 0.0
    for m in range(k + 1):
        total += comb(k, m) * p**m * (1 - p) ** (k - m)
        if total >= MISS:
            return m
    return k


def similar(common: Column, size_a: Column, size_b: Column, least: tuple[int, int]) -> Column:
    return least[1] * common >= least[0] * (size_a + size_b - common)


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def ordered(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed numbers of the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """``doc_id, digest, size, sketch``: digest and size of the shingle set, its ``k`` least hashes in rising order."""

    def make():
        def of(text: str) -> tuple:
            hashes = np.unique(shingle_hashes(text, words))
            return digest(hashes), len(hashes), ordered(hashes[:k]).tolist()

        return of

    return per_text(docs, make, "digest binary, size long, sketch array<long>")


def close_pairs(pairs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Distinct ``a, b`` (a < b) of ``pairs(a, size_a, b, size_b)`` whose sizes allow a link."""
    fits = least[1] * F.least("size_a", "size_b") >= least[0] * F.greatest("size_a", "size_b")
    return pairs.filter(fits).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, least: tuple[int, int], k: int) -> DataFrame:
    """The ``pairs(a, b)`` (distinct, stored) of classes that link."""
    of = lambda end, x: classes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(x))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    both = both.withColumn("common", F.array_intersect("x", "y"))
    whole = F.greatest("size_a", "size_b") <= k  # both sketches are the sets themselves
    least_k = F.slice(F.sort_array(F.array_union("x", "y")), 1, k)
    passes = F.when(whole, similar(F.size("common"), F.col("size_a"), F.col("size_b"), least)).otherwise(
        F.size(F.array_intersect("common", least_k)) >= common_values(k, least)
    )
    likely = stored(both.filter(passes).select("a", "b", whole.alias("whole")), "likely_pairs")
    open_ = likely.filter("not whole")

    ids = open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct()
    chosen = stored(classes.join(ids, "node").select("node", "digest", "class_id"), "chosen")
    sets = stored(resketched(docs, chosen, words, None).select("node", "sketch"), "full_sets")
    full = open_.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    full = full.filter(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), least))
    return likely.filter("whole").select("a", "b").union(full.select("a", "b"))


def resketched(docs: DataFrame, classes: DataFrame, words: int, k: int | None) -> DataFrame:
    """``node, size, sketch`` of ``classes(node, digest, class_id)`` with ``k`` values (None: the whole set)."""

    def make():
        def of(text: str) -> tuple:
            hashes = np.unique(shingle_hashes(text, words))
            return digest(hashes), len(hashes), ordered(hashes[:k]).tolist()

        return of

    ids = classes.select(F.col("class_id").alias("id")).distinct()
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # rows of one id may have different texts, so the digest says which is meant
    sets = per_text(rows, make, "digest binary, size long, sketch array<long>")
    return sets.join(classes.select("node", "digest"), "digest").dropDuplicates(["node"]).select("node", "size", "sketch")


def listed(members: DataFrame, hot_rows: int) -> DataFrame:
    """``members(value, ...)`` on lists of two and more, with the list's length ``n``."""
    heat = members.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return look_up(members, heat.withColumn("heat", F.col("n")), ["value"], "heat", hot_rows)


def short_pairs(members: DataFrame) -> DataFrame:
    """The pairs of each list's members."""
    end = lambda e: members.select("value", F.col("node").alias(e), F.col("size").alias(f"size_{e}"))
    return end("a").join(end("b"), "value").filter("a < b")


def rarest(sets: DataFrame, least: tuple[int, int], k: int, hot_rows: int) -> DataFrame:
    """``value, low, high, node, size, range, rest, weight``: the lists of a value and two ranges of
    sizes on which ``sets(node, size, sketch)`` stand. A class stands there if it may share
    the value with a linked partner of the other range as the first one in rising order of commonness;
    ``rest`` values from there on are left, ``weight`` is the mean commonness of its values.
    """
    p, q = least
    own = stored(sets.select("node", "size", F.explode("sketch").alias("value")), "retained")
    heat = own.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    known = look_up(own, heat.withColumn("heat", F.col("rows")), ["value"], "heat", hot_rows)
    rows = known.groupBy("node", "size").agg(
        F.sort_array(F.collect_list(F.struct("rows", "value"))).alias("values"),  # k values at most
        F.avg(F.log("rows")).alias("weight"),
    )
    range_of = lambda n: F.floor(F.log(n) / F.log(F.lit(STEP)) + 1e-9)
    least_in = lambda r: F.ceil(F.pow(F.lit(STEP), r) - 1e-6)

    def common(r: Column) -> Column:
        """Values that a link with a partner in range ``r`` has in common at least."""
        other = F.greatest(least_in(r), F.ceil(F.col("size") * p / q))
        exact = F.ceil((F.col("size") + other) * p / (p + q) - 1e-9)
        bound = F.lit(common_values(k, least))
        return F.when((F.col("size") <= k) & (least_in(r + 1) <= k), exact).otherwise(F.least(exact, bound))

    placed = rows.select("node", "size", "weight", F.size("values").alias("len"), F.posexplode("values").alias("at", "v")).filter("v.rows > 1")
    placed = placed.withColumn("rest", F.col("len") - F.col("at"))
    ranges = F.sequence(range_of(F.greatest(F.ceil(F.col("size") * p / q), F.lit(1))), range_of(F.floor(F.col("size") * q / p)))
    placed = placed.withColumn("range", range_of(F.col("size"))).withColumn("other", F.explode(F.filter(ranges, lambda r: F.col("rest") >= common(r))))
    return placed.select(
        F.col("v.value").alias("value"), F.least("range", "other").alias("low"), F.greatest("range", "other").alias("high"),
        "node", "size", "range", "rest", "weight",
    )


def component_of(members: DataFrame, edges: DataFrame, hot_rows: int) -> DataFrame:
    """``members`` with their ``component`` by the ``edges`` so far."""
    parts = connected_components(edges, hot_rows)
    heat = members.groupBy("node").agg(F.count(F.lit(1)).alias("heat")).join(parts, "node", "left")
    heat = heat.withColumn("component", F.coalesce("component", "node"))
    return look_up(members.drop("component"), heat, ["node"], "heat", hot_rows)


def links(docs: DataFrame, classes: DataFrame, words: int, least: tuple[int, int], k: int, hot_k: int, probes: int, short: int, hot_rows: int) -> DataFrame:
    """``a, b``: links between classes that connect what all links connect."""
    probe = classes.select("node", "size", F.explode(F.slice("sketch", 1, probes)).alias("value"))
    probe = stored(listed(probe, hot_rows), "probes")
    pairs = short_pairs(probe.filter(F.col("n") <= short))
    pairs = stored(close_pairs(pairs, least), "candidates")
    edges = stored(linked(docs, classes, pairs, words, least, k), "links")
    long_nodes = stored(probe.filter(F.col("n") > short).select("node").distinct(), "long_nodes")
    if long_nodes.isEmpty():
        return edges
    hot = stored(classes.join(long_nodes, "node").select("node", "digest", "class_id"), "hot_classes")
    hot = stored(resketched(docs, hot, words, hot_k).join(hot, "node"), "hot_sketches")
    place = ["value", "low", "high"]
    members = stored(rarest(hot.select("node", "size", "sketch"), least, hot_k, hot_rows), "list_members")
    before = None
    while True:
        members = component_of(members, edges, hot_rows)
        central = F.struct("weight", "node")
        facts = members.groupBy(*place, "component").agg(
            F.count_if(F.col("range") == F.col("low")).alias("m"), F.count_if(F.col("range") == F.col("high")).alias("w"),
            F.max_by(F.struct("node", "size", "component"), central).alias("hub"), F.max(central).alias("rank"),
        )
        facts = facts.groupBy(*place).agg(
            F.sum("m").alias("m"), F.sum("w").alias("w"), F.sum(F.expr("m * w")).alias("inner"), F.max_by("hub", "rank").alias("hub")
        )
        opened = F.expr("if(low = high, (m * m - inner) div 2, m * w - inner)")
        facts = stored(facts.select(*place, "hub", F.greatest("m", "w").alias("heat"), opened.alias("pairs")).filter("pairs > 0"), "open_lists")
        rows, left = facts.agg(F.sum("heat"), F.sum("pairs")).first()
        if not rows:
            return edges
        last = left <= FEW * rows or (before is not None and 2 * left > before)
        members = stored(look_up(members, facts.drop("pairs"), place, "heat", hot_rows), "open_members")
        if last:
            end = lambda e: members.select(*place, *[F.col(c).alias(f"{c}_{e}") for c in ("size", "rest", "component", "range")], F.col("node").alias(e))
            least_common = F.expr(f"ceil((size_a + size_b) * {least[0]}D / {sum(least)} - 1e-9)")
            fits = (F.least("rest_a", "rest_b") >= least_common) | (F.greatest("size_a", "size_b") > hot_k)
            pairs = end("a").join(end("b"), place).filter("range_a = low and range_b = high and (low < high or a < b)")
            pairs = pairs.filter("component_a != component_b").filter(fits)
        else:
            pairs = members.filter("component != hub.component").select(
                F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("hub.node").alias("b"), F.col("hub.size").alias("size_b")
            )
        pairs = stored(close_pairs(pairs, least), "candidates")
        edges = stored(edges.union(linked(docs, hot, pairs, words, least, hot_k)), "links")
        if last:
            return edges
        members = members.filter("node != hub.node").drop("hub")  # a hub has met its whole list
        before = left


def near_copies(
    docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, k: int = K, hot_k: int = HOT_K, probes: int = PROBES, short: int = SHORT, hot_rows: int = 1_000_000
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable over links, ``kept`` whether it is the
    row's own. Null and empty texts and such without words have no shingles, link with
    nothing and are kept. Rows with a null id link like others, and are kept only in
    components without any id; rows that share an id come out once each, by their own texts.
    Other columns play no part; no rows give no rows.
    """
    marks = stored(sketches(docs, words, k), "sketches")
    full = marks.filter("size > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = links(docs, classes, words, least, k, hot_k, probes, short, hot_rows)
    parts = connected_components(edges, hot_rows)
    owned = classes.select("digest", "node", "class_id", "copies").join(parts, "node", "left")
    owned = stored(owned.withColumn("component", F.coalesce("component", "node")).drop("node"), "owned")
    heads = owned.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("heat"))
    owned = look_up(owned, heads, ["component"], "heat", hot_rows).select("digest", "copies", "component_id")
    alone = marks.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    out = look_up(full.select("doc_id", "digest", "size"), owned, ["digest"], "copies", hot_rows)
    out = out.select("doc_id", "size", "component_id").union(alone)
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
