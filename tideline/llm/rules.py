"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample.

The order only decides how soon a document leaves the cascade: a document is kept if no
rule rejects it, whatever the order."""

from __future__ import annotations

import math
import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SLICE, per_text, texts

SAMPLE = 500  # documents on which cost and selectivity are estimated
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


class Page:
    """A text and what rules measure of it, each measured once and only when asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.got = text, {}

    def __getattr__(self, name: str):
        measure = MEASURES.get(name)
        if measure is None:
            raise AttributeError(name)
        if name not in self.got:
            self.got[name] = measure(self)
        return self.got[name]


def _repeated(page: Page) -> int:
    """Words inside a five-word window that the text holds twice or more."""
    w = page.words
    windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
    if len(set(windows)) == len(windows):
        return 0
    count, covered, upto = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered += i + 5 - max(i, upto)
            upto = i + 5
    return covered


def _repeated_lines(page: Page) -> int:
    if "\n" not in page.text:
        return 0
    lines = [line for line in page.text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _compression(page: Page) -> float:
    """Compressed size as a share of the size."""
    raw = page.text.encode("utf-8")
    return len(zlib.compress(raw, 1)) / len(raw) if raw else 1.0


def _entropy(page: Page) -> float:
    """Bits a character of the text carries."""
    n = len(page.text)
    return -sum(c / n * math.log2(c / n) for c in Counter(page.text).values())


BOILERPLATE = ("lorem ipsum", "all rights reserved", "cookie policy", "enable javascript", "privacy policy", "terms of use", "click here", "log in or sign up")
BULLETS = ("-", "*", "+", "•", "‣", "◦", "▪")


def _boilerplate(page: Page) -> int:
    """Characters in phrases of page furniture."""
    text = page.text.lower()
    return sum(text.count(phrase) * len(phrase) for phrase in BOILERPLATE)


MEASURES: dict[str, Callable[[Page], object]] = {
    "words": lambda p: p.text.encode("utf-8").split(),  # bytes split at the six ASCII blanks only
    "n_words": lambda p: len(p.words),
    "word_chars": lambda p: len(p.text) - sum(map(p.text.count, BLANKS)),
    "n_symbols": lambda p: sum(map(p.text.count, SYMBOLS)),
    "n_dup_lines": _repeated_lines,
    "n_repeat_words": _repeated,
    "n_lines": lambda p: p.text.count("\n") + 1,
    "n_bullets": lambda p: sum(line.lstrip(BLANKS).startswith(BULLETS) for line in p.text.split("\n")),
    "n_boilerplate": _boilerplate,
    "compression": _compression,
    "entropy": _entropy,
}

# A rule rejects the document; every threshold is a parameter of `rules`.
Rule = Callable[[Page], bool]


def rules(
    min_words: int = 10,
    max_repeat: float = 0.2,
    min_word: float = 2.0,
    max_word: float = 20.0,
    max_symbols: float = 0.5,
    max_dup_lines: float = 0.3,
    max_same: float = 0.5,
    max_bullets: float = 0.9,
    max_boilerplate: float = 0.2,
    min_compression: float = 0.05,
    min_entropy: float = 2.0,
) -> dict[str, Rule]:
    return {
        "too_few_words": lambda p: p.n_words < min_words,
        "repeated_windows": lambda p: 100 * p.n_repeat_words > round(100 * max_repeat) * p.n_words,
        "word_length": lambda p: not min_word * p.n_words <= p.word_chars <= max_word * p.n_words,
        "symbols": lambda p: p.n_symbols > max_symbols * p.n_words,
        "repeated_lines": lambda p: p.n_dup_lines > max_dup_lines * p.n_lines,
        "one_word_text": lambda p: p.n_words > 0 and max(Counter(p.words).values()) > max_same * p.n_words,
        "bullet_lines": lambda p: p.n_lines > 1 and p.n_bullets > max_bullets * p.n_lines,
        "boilerplate": lambda p: p.n_boilerplate > max_boilerplate * p.word_chars,
        "compressible": lambda p: p.compression < min_compression,
        "few_characters": lambda p: p.entropy < min_entropy,
    }


BASE = ("too_few_words", "repeated_windows")


def tried(sample: Iterable[str], checks: dict[str, Rule]) -> dict[str, tuple[int, float]]:
    """Rejections and seconds of each rule on the sample. Every rule gets fresh pages, so it is
    charged for the measures it needs."""
    out = {name: (0, 0.0) for name in checks}
    for text in sample:
        for name, rejects in checks.items():
            start = time.perf_counter()
            hit = rejects(Page(text))
            out[name] = (out[name][0] + hit, out[name][1] + time.perf_counter() - start)
    return out


def ordered(facts: dict[str, tuple[int, float]], checks: dict[str, Rule]) -> list[str]:
    """Rule names by rejections per second, best first (ties, and rules not tried: as listed)."""
    gain = {name: (hits + 0.5) / (seconds + 1e-6) for name, (hits, seconds) in facts.items()}
    return sorted(checks, key=lambda name: -gain.get(name, 0.0))


def cascade(docs: DataFrame, checks: dict[str, Rule], size: int = SAMPLE) -> list[str]:
    """The order of the rules, from the documents with the ``size`` least hashes of their ids. They are
    tried where they lie: ids are sorted, and only a count and a time per rule reach the driver."""
    if not size:
        return list(checks)
    ids = texts(docs).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    chosen = texts(docs).join(F.broadcast(ids), "doc_id", "left_semi").select("text")  # `size` ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                facts = tried((t.as_py() for t in whole.slice(at, SLICE).column("text")), checks)
                columns = [list(facts), [f[0] for f in facts.values()], [f[1] for f in facts.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rule", "hits", "seconds"])

    found = chosen.mapInArrow(run, "rule string, hits long, seconds double").groupBy("rule")
    facts = found.agg(F.sum("hits").alias("hits"), F.sum("seconds").alias("seconds")).collect()
    return ordered({r.rule: (r.hits, r.seconds) for r in facts}, checks)


def screen(docs: DataFrame, checks: dict[str, Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, rejected_by`` per document.

    The measures are reported for every document; the verdict comes from the cascade,
    which stops at the first rule that rejects and names it. Null and empty texts have no
    words and fail; repeated rows come out once each; very long texts are taken whole."""
    checks = checks or rules()
    order = cascade(docs, checks, sample)

    def make():
        base = [name for name in BASE if name in checks]

        def of(text: str) -> tuple:
            page = Page(text)
            rejected = next((name for name in order if checks[name](page)), None)
            failed = rejected in base or any(checks[name](page) for name in base)
            return (
                page.n_words, page.word_chars, page.n_symbols, page.n_dup_lines, page.n_repeat_words,
                failed, rejected is None and not failed, rejected,
            )

        return of

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return per_text(docs, make, schema)
