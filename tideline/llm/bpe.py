"""Byte-level BPE: encoding by a queue of merge ranks over linked symbols, and decoding.

The vocabulary file (a tokenizers JSON) is a parameter; its content travels with the
tasks, so executors need no copy of it."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from tideline.llm.common import per_text

BLANK = r"\t-\r \x85\xa0  -     　"
# The published split of byte-level BPE vocabularies, with white space spelled out.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
CACHED = 400_000  # pieces a task remembers before it starts anew


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


class Vocabulary:
    """Symbols, merges and special strings of a byte-level BPE file."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = data["model"]["vocab"]
        self.first = [ids[letters[b]] for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.ranks = {(ids[a] << 20) | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings: dict[int, bytes] = {}
        for token, i in ids.items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.strings |= {i: s.encode() for s, i in self.special.items()}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece. The queue holds (rank, place) as one number; an entry is
        stale if the pair that now stands at its place has another rank or none."""
        first, rank_of = self.first, self.ranks.get
        ids = [first[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue, left = [], ids[0]
        for i in range(1, n):
            right = ids[i]
            rank = rank_of(left << 20 | right)
            if rank is not None:
                queue.append(rank << shift | i - 1)
            left = right
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heapq.heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & mask
            j = after[i]
            if j >= n or rank_of(ids[i] << 20 | ids[j]) != entry >> shift:
                continue
            made = self.made[entry >> shift]
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(made << 20 | ids[k])
                if rank is not None:
                    heappush(queue, rank << shift | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] << 20 | made)
                if rank is not None:
                    heappush(queue, rank << shift | h)
        return [i for i in ids if i >= 0]


class Coder:
    """Encodes and decodes whole texts; equal pieces of a task are merged once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}
        self.touching = re.compile(r" \s|\s ").search
        self.split = regex.compile(SPLIT).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def encode(self, text: str) -> list[int]:
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self._plain(text)
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.vocabulary.special[part]] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        """A blank between two other characters starts a piece, so such words split alone."""
        if text[:1].isspace() or self.touching(text):
            return self._chunk(text)
        words = text.split(" ")
        out = list(self._chunk(words[0]))
        known = self.words
        for word in words[1:]:
            ids = known.get(word)
            if ids is None:
                ids = self._chunk(" " + word)
                if len(word) < 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def _chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(chunk):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.vocabulary.merged(piece.encode("utf-8"))
                if len(piece) < 64:
                    if len(self.pieces) >= CACHED:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, concatenated; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.strings.__getitem__, ids)).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` per document: digests of the ids
    as little-endian unsigned 32-bit integers, and of the decoded text in UTF-8.

    Null and empty texts have no ids and the digests of nothing; special strings inside a
    text become their own id; very long texts are taken whole, as are very long pieces."""
    return _coded(docs, vocabulary_file, True)


def round_trip(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """``encoded`` without the ids themselves."""
    return _coded(docs, vocabulary_file, False)


def _coded(docs: DataFrame, vocabulary_file: str, with_ids: bool) -> DataFrame:
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()

    def make():
        coder = Coder(Vocabulary(content))

        def of(text: str) -> tuple:
            ids = coder.encode(text)
            packed = np.array(ids, "<u4")
            decoded = coder.decode(ids).encode("utf-8")
            marks = hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()
            return (len(ids), packed.view("<i4"), *marks) if with_ids else (len(ids), *marks)

        return of

    return per_text(docs, make, f"n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string")
