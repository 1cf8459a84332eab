"""Benchmark passages in documents, by the q-gram lemma.

If an item of ``m`` characters stands in a text with at most ``k`` edits, at least
``m + 1 - q (k + 1)`` of its q-grams stand there unchanged, on diagonals (place in the
text minus place in the item) at most ``k`` apart from each other's middle. Shared q-grams
are counted in overlapping bands of diagonals; bands that reach the bound are aligned."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import keep_texts, texts

Q = 12
EDITS = 0.05  # edits allowed per character of an item
BLOCK_CHARS = 4_000_000  # characters of items that travel to the tasks at once
SIEVE_BITS = 22
BASE = 0x9E3779B97F4A7C15
ASCII_WORDS = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))


def canonical(text: str) -> np.ndarray:
    """Code points of the text in lower case, ASCII punctuation and blanks as single spaces."""
    plain = b" ".join(text.lower().encode("utf-8").translate(ASCII_WORDS).split())
    return np.frombuffer(plain.decode("utf-8").encode("utf-32-le"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram, from hashes of grams half as long."""
    n = len(codes) - q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    powers = {1: codes.astype(np.uint64) + np.uint64(1)}
    width = 1
    while 2 * width <= q:
        h = powers[width]
        powers[2 * width] = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
        width *= 2
    out, at = None, 0
    for width in sorted(powers, reverse=True):
        if q & width:
            part = powers[width][at : at + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, width, 1 << 64)) + part
            at += width
    return out ^ (out >> np.uint64(31))


class Items:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float) -> None:
        self.q = q
        self.ids, self.codes, self.budget, self.bound = [], [], [], []
        hashes, owner, place = [], [], []
        for item_id, text in items:
            codes = canonical(text or "")
            m = len(codes)
            if m < q:
                continue
            k = min(int(m * edits), m // q - 1)  # beyond, the bound would allow no shared gram
            at = len(self.ids)
            self.ids.append(item_id)
            self.codes.append(codes)
            self.budget.append(k)
            self.bound.append(m + 1 - q * (k + 1))
            h = gram_hashes(codes, q)
            hashes.append(h)
            owner.append(np.full(len(h), at))
            place.append(np.arange(len(h)))
        self.budget, self.bound = np.array(self.budget, np.int64), np.array(self.bound, np.int64)
        self.least = int(self.bound.min()) if self.ids else 0
        hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int64))[order]
        self.grams, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._slot(self.grams)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(BASE)) >> np.uint64(64 - SIEVE_BITS)

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every shared q-gram."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.sieve[self._slot(hashes)])
        if len(at) < self.least:
            return (np.empty(0, np.int64),) * 3
        i = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[i] == hashes[at]
        at, i = at[same], i[same]
        n = self.count[i]
        pick = np.repeat(self.first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[pick], self.place[pick]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, from, to, edits) in the canonical text: the best place of each item found."""
        codes = canonical(text)
        if not self.ids or len(codes) < self.q:
            return []
        at, item, place = self.shared(codes)
        if len(at) < self.least:
            return []
        width = 2 * self.budget[item] + 1
        band = (at - place) // width
        keys = np.concatenate([np.stack([item, band], 1), np.stack([item, band - 1], 1)])
        keys, n = np.unique(keys, axis=0, return_counts=True)
        best: dict[int, tuple[int, int, int]] = {}
        for i, b in keys[n >= self.bound[keys[:, 0]]].tolist():
            k = int(self.budget[i])
            w = 2 * k + 1
            low = max(0, b * w - k)
            region = codes[low : (b + 2) * w + len(self.codes[i]) + k]
            found = align(self.codes[i], region, max(0, b * w - k) - low, k)
            if found and (i not in best or (found[2], found[0] + low) < (best[i][2], best[i][0])):
                best[i] = (found[0] + low, found[1] + low, found[2])
        return [(self.ids[i], *best[i]) for i in sorted(best)]


def align(item: np.ndarray, region: np.ndarray, shift: int, k: int) -> tuple[int, int, int] | None:
    """(from, to, edits) of the item's best place in the region, None beyond ``k`` edits.

    Rows are item characters, columns the diagonals that the region leaves open."""
    m, n = len(item), len(region)
    end = _banded(item, region, k, free=True)
    if end is None:
        return None
    start = _banded(item[::-1], region[: end[0]][::-1], k, free=False)
    return end[0] - start[0], end[0], end[1]


def _banded(item: np.ndarray, region: np.ndarray, k: int, free: bool) -> tuple[int, int] | None:
    """(characters of the region used, edits) for the whole item; ``free``: it may begin anywhere."""
    m, n = len(item), len(region)
    low, high = -k, (n - m + k if free else k)
    if high < low:
        return None
    steps = np.arange(high - low + 1)
    far = m + n + 1
    padded = np.concatenate([np.full(k + 1, 0xFFFFFFFF, np.uint32), region, np.full(m + k + len(steps) + 1, 0xFFFFFFFF, np.uint32)])
    row = np.where((steps + low >= 0) & (steps + low <= n), 0 if free else steps + low, far)
    for i in range(1, m + 1):
        columns = steps + low + i  # characters of the region used
        here = padded[i + low + k : i + low + k + len(steps)]
        new = row + (here != item[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((columns < 0) | (columns > n), far, new)
        new = np.where(columns == 0, np.minimum(new, i), new)
        row = np.minimum.accumulate(new - steps) + steps
    row = np.where((steps + low + m < 0) | (steps + low + m > n), far, row)
    best = int(row.argmin())
    return (best + low + m, int(row[best])) if row[best] <= k else None


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: documents that hold a whole benchmark item
    with at most ``edits`` edits per character, and where (code points of the canonical
    text; the place with fewest edits, then the first).

    Items go to the documents in blocks of bounded size. Null and empty texts, and items
    shorter than ``q`` canonical characters, match nothing; repeated items and documents
    each give their own rows; empty tables give no rows."""
    parts = [_leaks_of(docs, Items(block, q, edits)) for block in _blocks(benchmark, block_chars)]
    if not parts:
        parts = [_leaks_of(docs, Items([], q, edits))]
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item (see ``leaks``)."""
    for block in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, q, edits))
        docs = keep_texts(docs, lambda shared=shared: lambda text: not shared.value.matches(text))
    return docs


def _blocks(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), "text").filter("text is not null").orderBy("i", "text").toLocalIterator():
        block.append((r.i, r.text))
        size += len(r.text)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _leaks_of(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            rows = [
                (doc_id, *found)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                for found in block.matches(text.as_py())
            ]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "edits"])

    return texts(docs).mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
