"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most ``budget`` bits link; documents linked through any
chain form one component. To spread the trie over tasks the 64 bits are cut into
blocks: if two fingerprints differ in at most ``budget`` bits, then among ``k`` blocks
some ``k - budget`` agree, so for each choice of such blocks the trie that starts with
their bits holds the pair below one node. Those nodes are the tasks' tries; inside, node
pairs are walked together (trie.py). Nodes with too many keys are opened level by level
as a table of node pairs, so that no task holds more than two nodes of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import look_up, per_text, stored
from tideline.llm.components import connected_components
from tideline.llm.trie import link_keys

BITS = 64
NODE_KEYS = 100_000  # keys of a trie node that one task takes whole
STEP = 4  # levels opened at once in a node with more keys


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles; fewer words give the whole sequence, none nothing."""
    parts = text.encode("utf-8").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size).tolist(), ends.tolist()
    if len(parts) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        part = np.ascontiguousarray(hashes[i : i + 255]).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another hash of the same shingles; turn 0 keeps them."""
    if not turn:
        return hashes
    x = (hashes + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, words: int = 4, turns: int = 1) -> DataFrame:
    """``doc_id, fps``: ``turns`` fingerprints per document. Null and empty texts give 0."""

    def make():
        def of(text: str) -> tuple:
            hashes = shingle_hashes(text, words)
            return ([majority(mixed(hashes, turn)) for turn in range(turns)],)

        return of

    return per_text(docs, make, "fps array<long>")


def blocks_for(keys: int, budget: int) -> int:
    """Blocks to cut the bits into: the fewest that leave about 64 random keys a node."""
    for k in range(budget + 1, 2 * budget + 2):
        if keys >> (BITS // k * (k - budget)) <= 64:
            return k
    return 2 * budget + 1


def layouts(k: int, budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of agreeing blocks: all blocks (lowest bit, width), chosen first, and the chosen width."""
    edges = [BITS * i // k for i in range(k + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(range(k), k - budget):
        order = [blocks[i] for i in chosen] + [blocks[i] for i in range(k) if i not in chosen]
        out.append((order, sum(blocks[i][1] for i in chosen)))
    return out


def arranged(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` with the blocks in the given order, the first on top."""
    at, out = BITS, F.lit(0).cast("long")
    for low, width in order:
        at -= width
        mask = (1 << width) - 1 if width < BITS else -1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(mask).cast("long")), at))
    return out


def trie_links(keys: DataFrame, budget: int, n_keys: int, node_keys: int = NODE_KEYS) -> DataFrame:
    """``turn, fp, rep`` linking distinct ``keys(turn, fp)``: chains of these links reach
    exactly the fingerprints that chains of at most ``budget`` differing bits reach.
    A task returns one link per key at most, not the pairs."""
    if budget >= BITS:
        raise ValueError("budget must be below 64 bits")
    plans = layouts(blocks_for(n_keys, budget), budget)
    rows = keys.select(
        "turn",
        "fp",
        F.posexplode(F.array(*[arranged(F.col("fp"), order) for order, _ in plans])).alias("layout", "key"),
    )
    depth = F.element_at(F.array(*[F.lit(width) for _, width in plans]), F.col("layout") + 1)
    rows = rows.withColumn("depth", depth).withColumn("node", F.expr("shiftrightunsigned(key, 64 - depth)"))
    where = ["turn", "layout", "node"]
    heat = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_keys)
    heat = stored(heat.drop("n"), "hot_nodes")
    if heat.isEmpty():
        cold, hot = rows, None
    else:
        cold, hot = rows.join(heat, where, "left_anti"), stored(rows.join(heat, where), "hot_keys")
    cold = cold.select(*where, "depth", F.lit(0).alias("side"), F.lit(0).alias("diff"), "key", "fp")
    links = _walk(cold.repartition(*where), where, budget)
    if hot is not None:
        links = links.union(_walk_hot(hot, budget, node_keys))
    return links


def _walk_hot(hot: DataFrame, budget: int, node_keys: int) -> DataFrame:
    """Opens hot nodes as a table of node pairs, down to nodes of bounded size."""
    where = ["turn", "layout", "node"]
    steps = F.expr(f"transform(sequence(0, (64 - depth) div {STEP}), i -> depth + {STEP} * i)")
    sized = hot.select(*where, "key", F.explode(F.array_union(steps, F.array(F.lit(BITS)))).alias("at"))
    sized = sized.groupBy(*where, "at", F.expr("shiftrightunsigned(key, 64 - at)").alias("sub")).count()
    chosen = sized.groupBy(*where, "at").agg(F.max("count").alias("most")).filter(F.col("most") <= node_keys)
    chosen = stored(chosen.groupBy(*where).agg(F.min("at").alias("at")), "opened")
    keys = hot.join(chosen, where).withColumn("sub", F.expr("shiftrightunsigned(key, 64 - at)"))
    nodes = stored(keys.select(*where, "depth", "at", "sub").distinct(), "trie_nodes")
    pairs = nodes.select(*where, "depth", "at").distinct()
    pairs = pairs.select("*", F.col("depth").alias("level"), F.col("node").alias("x"), F.col("node").alias("y"), F.lit(0).alias("diff"))
    most = nodes.agg(F.max(F.expr(f"ceil((at - depth) / {STEP})"))).first()[0] or 0
    for _ in range(most):  # both nodes of a pair step down together
        below = F.expr(f"least(at, level + {STEP})")
        done = pairs.filter("level >= at")
        pairs = pairs.filter("level < at").withColumn("next", below)
        levels = pairs.select(*where, "level", "next").distinct()
        child = nodes.join(levels, where).select(
            *where,
            F.expr("shiftrightunsigned(sub, at - level)").alias("p"),
            F.expr("shiftrightunsigned(sub, at - next)").alias("c"),
        )
        child = child.distinct()
        left = child.select(*where, F.col("p").alias("x"), F.col("c").alias("cx"))
        right = child.select(*where, F.col("p").alias("y"), F.col("c").alias("cy"))
        opened = pairs.join(left, [*where, "x"]).join(right, [*where, "y"])
        more = F.expr("bit_count((cx ^ cy) & (shiftleft(1L, next - level) - 1))")
        opened = opened.filter("x < y or cx <= cy").withColumn("diff", F.col("diff") + more)
        opened = opened.filter(F.col("diff") <= budget).select(
            *where, "depth", "at", F.col("next").alias("level"), F.col("cx").alias("x"), F.col("cy").alias("y"), "diff"
        )
        pairs = stored(done.unionByName(opened), "node_pairs")
    pairs = pairs.select(*where, "x", "y", "diff")
    sides = [
        keys.join(pairs.withColumn("sub", F.col(c)), [*where, "sub"]).select(
            *where, "x", "y", F.col("at").alias("depth"), F.lit(side).alias("side"), "diff", "key", "fp"
        )
        for side, c in ((0, "x"), (1, "y"))
    ]
    both = sides[0].union(sides[1].filter("x != y"))
    place = [*where, "x", "y"]
    return _walk(both.repartition(*place), place, budget)


def _walk(rows: DataFrame, place: list[str], budget: int) -> DataFrame:
    """Walks the node pairs (``place``: side 0, and side 1 unless it is the same node) of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        column = {c: whole.column(c).to_numpy() for c in whole.column_names}
        for depth in np.unique(column["depth"]):
            of = np.flatnonzero(column["depth"] == depth)
            key = column["key"][of].view(np.uint64)
            order = of[np.lexsort((key, column["side"][of], *[column[c][of] for c in reversed(place)]))]
            got = {c: v[order] for c, v in column.items()}
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([got[c][1:] != got[c][:-1] for c in place])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(order))
            split = first + np.add.reduceat((got["side"] == 0).astype(np.int64), first)
            alone = split == last
            start = (
                first,
                np.where(alone, last, split),
                np.where(alone, first, split),
                last,
                got["diff"][first].astype(np.int64),
            )
            root = link_keys(got["key"].view(np.uint64), start, int(depth), budget)
            links = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(got["turn"][links], pa.int32()), pa.array(got["fp"][links]), pa.array(got["fp"][root[links]])],
                ["turn", "fp", "rep"],
            )

    return rows.mapInArrow(run, "turn int, fp long, rep long")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, turns: int = 1, node_keys: int = NODE_KEYS, hot_rows: int = 1_000_000) -> DataFrame:
    """``doc_id, fps, component_id`` for every document.

    Documents link where a fingerprint of the same turn differs in at most ``budget``
    bits; ``component_id`` is the least ``doc_id`` reachable. ``turns`` > 1 takes further
    independent fingerprints, each of which may link.
    Nulls and empty texts have fingerprint zero, linked like any other; equal texts share
    all fingerprints; repeated ``doc_id`` rows come out once each; no rows give no rows.
    """
    spark = docs.sparkSession
    marks = stored(fingerprints(docs, words, turns), "fingerprints")
    classes = stored(marks.groupBy("fps").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
    owned = classes.select("class_id", F.posexplode("fps").alias("turn", "fp"))
    owners = stored(owned.groupBy("turn", "fp").agg(F.min("class_id").alias("owner"), F.count(F.lit(1)).alias("copies")), "owners")
    links = stored(trie_links(owners.select("turn", "fp"), budget, owners.count(), node_keys).distinct(), "links")
    edges = links.join(owners.select("turn", "fp", F.col("owner").alias("a")), ["turn", "fp"]).join(
        owners.select("turn", F.col("fp").alias("rep"), F.col("owner").alias("b")), ["turn", "rep"]
    ).select("a", "b")
    if turns > 1:
        own = look_up(owned, owners, ["turn", "fp"], "copies", hot_rows)
        edges = edges.union(own.select(F.col("class_id").alias("a"), F.col("owner").alias("b")))
    parts = connected_components(edges.filter("a != b"), hot_rows).select(F.col("node").alias("class_id"), "component")
    classes = classes.join(parts, "class_id", "left").select(
        "fps", "copies", F.coalesce("component", "class_id").alias("component_id")
    )
    return look_up(marks, classes, ["fps"], "copies", hot_rows).select("doc_id", "fps", "component_id")
