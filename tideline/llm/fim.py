"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order.

The places where units may be cut are kept as a compressed set of byte offsets: the offset
space is cut into chunks of 2**16, and each chunk's boundaries stand in the container that
takes least room, a sorted array, a bitmap or a list of runs. Cumulative cardinalities tell which
container holds the i-th boundary, a local select finds it there; so a text is cut by two
lookups into its bytes, without a list of its units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SLICE, texts

CHUNK = 1 << 16  # offsets of a container
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


class ArrayContainer:
    """Offsets as a sorted array of 16-bit numbers."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])

    def size(self) -> int:
        return 2 * len(self.low)


class BitmapContainer:
    """Offsets as 2**16 bits, with the number of bits before each 512-bit block."""

    def __init__(self, low: np.ndarray) -> None:
        mask = np.zeros(CHUNK, bool)
        mask[low] = True
        self.words = np.packbits(mask, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).reshape(-1, 8).sum(axis=1, dtype=np.int64))])

    def select(self, i: int) -> int:
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.words[8 * block : 8 * block + 8].view(np.uint8), bitorder="little")
        return 512 * block + int(np.flatnonzero(bits)[i - self.before[block]])

    def size(self) -> int:
        return CHUNK // 8


class RunContainer:
    """Offsets as runs: starts, and the number of offsets before each run."""

    def __init__(self, low: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.starts, self.before = low[first].astype(np.uint16), first.astype(np.int32)

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])

    def size(self) -> int:
        return 4 * len(self.starts)


class Boundaries:
    """A set of offsets below 2**48 with ``select``; offsets are added in rising blocks."""

    def __init__(self, blocks: Iterator[np.ndarray]) -> None:
        self.keys: list[int] = []
        self.containers: list = []
        counts = [0]
        for key, low in _by_chunk(blocks):
            runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
            room = {RunContainer: 4 * runs, ArrayContainer: 2 * len(low), BitmapContainer: CHUNK // 8}
            self.keys.append(key)
            self.containers.append(min(room, key=room.get)(low))
            counts.append(counts[-1] + len(low))
        self.before = np.array(counts)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, i: int) -> int:
        """The ``i``-th offset in rising order, from 0."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = int(np.searchsorted(self.before, i, side="right")) - 1
        return self.keys[at] * CHUNK + self.containers[at].select(i - int(self.before[at]))


def _by_chunk(blocks: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Offsets (rising, in blocks that end at chunk borders) by chunk, as places within it."""
    for block in blocks:
        keys = block >> 16
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part in np.split(block, cuts):
            if len(part):
                yield int(part[0] >> 16), (part & (CHUNK - 1)).astype(np.int64)


def code_points(data: bytes) -> Iterator[np.ndarray]:
    """Offsets at which a code point of UTF-8 ``data`` starts, and the end."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) + 1, CHUNK):
        found = at + np.flatnonzero((raw[at : at + CHUNK] & 0xC0) != 0x80)
        if at + CHUNK > len(raw):
            found = np.append(found, len(raw))
        yield found


def draws(doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that depend on the id alone (none: as an empty id)."""
    text = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(
    text: str, doc_id: int | None, rate: int = 90, spm_rate: int = 20, units: Callable[[bytes], Iterator[np.ndarray]] = code_points
) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of a text.

    Of 100 texts ``rate`` are cut, ``spm_rate`` of those with the suffix first. Empty texts
    and such that hold a sentinel stay plain."""
    data = text.encode("utf-8")
    cuts = Boundaries(units(data))
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(doc_id)
    if not data or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    low, high = (cuts.select(i) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (data[a:b].decode("utf-8") for a, b in ((0, low), (low, high), (high, len(data))))
    p, s, m = SENTINELS
    if h4 % 100 < spm_rate:
        return n, SPM, len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, PSM, len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    The cuts depend on the id alone, so reruns and other partitionings give the same rows.
    Null texts count as empty and stay plain (n 0, output empty); rows with a null id are cut
    like an empty id; repeated rows come out once each; other columns play no part; no
    rows give no rows. Memory follows one text and its output."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                ids = part.column("doc_id").to_pylist()
                rows = [transform(text.as_py(), i, rate, spm_rate) for i, text in zip(ids, part.column("text"))]
                columns = [ids, *map(list, zip(*rows))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The exact text behind an output, by its form alone: pieces hold no sentinel, so the
    sentinels of an output tell them apart."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def oracle() -> str:
    """The digests of every document in DuckDB."""
    group = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)"
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM documents
    ), c AS (
      SELECT doc_id, t, n,
             least({group(0)} % (n + 1), {group(1)} % (n + 1)) AS a, greatest({group(0)} % (n + 1), {group(1)} % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {group(2)} % 100 >= 90 THEN 'plain'
                  WHEN {group(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM d
    ), p AS (
      SELECT *, substr(t, 1, CAST(a AS BIGINT)) AS pre, substr(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS mid, substr(t, CAST(b AS BIGINT) + 1) AS suf FROM c
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p"""
