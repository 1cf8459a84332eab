"""Token counts without token ids: pieces are counted once per distinct pre-token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import byte_letters
from tideline.llm.common import stored, texts

HEAVY = 200_000  # most pre-tokens that travel to every task
HELD = 300_000  # pre-tokens and words a task holds before it hands on or forgets


def splitter(content: str) -> Callable[[str], list[str]]:
    """Splits a blank-free word into pre-tokens (in the vocabulary's byte letters) as the
    tokenizer does; special strings are pre-tokens of their own."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
    letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
    latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def parts(word: str) -> list[str]:
        # below U+0250 normalising changes nothing and case is folded letter by letter
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha() and word[-1] in ".,;:!?":
                return [word[:-1].lower(), word[-1]]
        if max(word) < "ɐ" and "İ" not in word and "<|" not in word and not odd(word):
            return [p.encode().decode("latin-1").translate(letters) for p in latin(word.lower())]
        out = []
        for i, part in enumerate(cut(word) if cut else [word]):
            if i % 2:
                out.append(part)
            elif part:
                plain = tokenizer.normalizer.normalize_str(part)
                out += [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    return parts


odd = re.compile("[\x1c-\x1f]").search  # white space for Python, not for the tokenizer


def words_of(text: str) -> list[str]:
    """Runs without white space: no pre-token crosses it."""
    if odd(text):
        return [w for w in re.split("[ \n\t\r]", text) if w]
    return text.split()


def distinct_pretokens(docs: DataFrame, content: str) -> DataFrame:
    """``pretoken, occurrences`` over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known, seen = splitter(content), {}, Counter()

        def out():
            return pa.RecordBatch.from_pydict({"pretoken": list(seen), "n": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            words: Counter = Counter()
            for text in batch.column("text"):
                words.update(words_of(text.as_py()))
                if len(words) >= HELD:
                    yield from _spread(words, parts, known, seen, out)
            yield from _spread(words, parts, known, seen, out)
        if seen:
            yield out()

    found = texts(docs).mapInArrow(run, "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("occurrences"))


def _spread(words: Counter, parts, known: dict, seen: Counter, out) -> Iterator[pa.RecordBatch]:
    for word, n in words.items():
        got = known.get(word)
        if got is None:
            if len(known) >= HELD:
                known.clear()
            got = known[word] = parts(word)
        for p in got:
            seen[p] += n
    words.clear()
    if len(seen) >= HELD:
        yield out()
        seen.clear()


def piece_counts(pretokens: DataFrame, content: str) -> DataFrame:
    """Adds ``pieces``: into how many tokens the model cuts the pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        cut = tokenizer.model.tokenize
        for batch in batches:
            n = [1 if p in special else len(cut(p)) for p in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "pieces"])

    return pretokens.mapInArrow(run, "pretoken string, occurrences long, pieces long")


def token_counts(docs: DataFrame, vocabulary_file: str, limit: int = 2048, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document.

    Every distinct pre-token is cut into pieces once. Pre-tokens with at least a
    ``1 / heavy`` share of all occurrences (there can't be more than ``heavy``) travel to
    the documents; all others meet the documents' frequencies in a shuffle join, where no
    key is hot. Null and empty texts count 0 tokens; no documents give no rows; very long
    texts are counted whole; rows that share a ``doc_id`` or lack one come out once each,
    with the counts of their own text.
    """
    repeated = texts(docs).groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if not repeated.isEmpty():  # rows are numbered in a written table, so the numbers stand
        rows = stored(texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
        out = token_counts(rows.select(F.col("row").alias("doc_id"), "text"), vocabulary_file, limit, heavy)
        return rows.select("row", "doc_id").join(out.withColumnRenamed("doc_id", "row"), "row").drop("row")
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()
    table = stored(piece_counts(distinct_pretokens(docs, content), content), "pretokens")
    total = table.agg(F.sum("occurrences")).first()[0] or 0
    common = F.col("occurrences") * heavy >= total
    known_pieces = {r[0]: r[1] for r in table.filter(common).select("pretoken", "pieces").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(known_pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pieces, known = splitter(content), shared.value, {}
        for batch in batches:
            ids, names, counts, done, sizes = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                total, rare = 0, Counter()
                for word, n in Counter(words_of(text)).items():
                    got = known.get(word)
                    if got is None:
                        if len(known) >= HELD:
                            known.clear()
                        cut = parts(word)
                        got = (sum(pieces.get(p, 0) for p in cut), [p for p in cut if p not in pieces])
                        known[word] = got
                    total += n * got[0]
                    for p in got[1]:
                        rare[p] += n
                ids += [doc_id] * (1 + len(rare))
                names += [None, *rare]
                counts += [0, *rare.values()]
                done += [total] + [0] * len(rare)
                sizes += [len(text.encode("utf-8"))] + [0] * len(rare)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "pretoken": pa.array(names, pa.string()),
                    "n": pa.array(counts, pa.int64()),
                    "known": pa.array(done, pa.int64()),
                    "n_bytes": pa.array(sizes, pa.int64()),
                }
            )

    rows = texts(docs).mapInArrow(run, "doc_id long, pretoken string, n long, known long, n_bytes long")
    # rows without a rare pre-token spread by their id: no pre-token holds a blank
    rows = rows.withColumn("pretoken", F.coalesce("pretoken", F.concat(F.lit(" "), F.col("doc_id").cast("string"))))
    rare = table.filter(~common).select("pretoken", "pieces")
    counted = rows.join(rare, "pretoken", "left").groupBy("doc_id").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum(F.col("known") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
