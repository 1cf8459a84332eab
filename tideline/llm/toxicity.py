"""Toxicity by a weighted grammar of finite-state transducers.

Words become labels with weights (insult, threat, target, negation, report, quote,
clause end); transducers for negation scope, reported speech and clause patterns are
composed and run over each clause. Insult words and stems and their weights are learned
from labelled documents; the other word classes are short fixed lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import held_out, per_text, stored, texts

SAMPLE = 12_000  # labelled documents learned from, at most
ENTRIES = 3_000  # insult words and stems considered, at most
FEATURES = 4
STEMS = (3, 4, 5, 6, 7)

# fixed values: word classes in English, German, French and Spanish
TARGET = "you your yours u ya they them he she him her du dich dir dein deine ihr euch tu toi te vous votre tú ti usted ustedes vosotros".split()
NEGATION = "not no never none nobody nothing isn't aren't don't won't can't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split()
REPORT = "said says say told wrote claimed quoted called sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREAT = "kill hurt destroy beat shoot stab murder strangle töten umbringen verletzen schlagen tuer frapper détruire matar golpear destruir".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»]|[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")

Step = Callable[[object, str, float], tuple[object, str, float]]


@dataclass
class Transducer:
    """Reads (label, weight), writes (label, weight); ``step`` is its transition function."""

    start: object
    step: Step

    def then(self, other: Transducer) -> Transducer:
        """Composition: ``other`` reads what this one writes."""

        def step(state, label, weight):
            a, label, weight = self.step(state[0], label, weight)
            b, label, weight = other.step(state[1], label, weight)
            return (a, b), label, weight

        return Transducer((self.start, other.start), step)


def negation(scope: int = 3, factor: float = 0.5) -> Transducer:
    """The next ``scope`` words after a negation weigh less."""

    def step(left, label, weight):
        if label == "end":
            return 0, label, weight
        if label == "negation":
            return scope, label, weight
        return max(0, left - 1), label, weight * (factor if left and label in ("insult", "threat") else 1)

    return Transducer(0, step)


def reported(factor: float = 0.7) -> Transducer:
    """After a verb of saying up to the clause's end, and inside quotation marks, words weigh less."""

    def step(state, label, weight):
        said, quoted = state
        if label == "quote":
            return (said, not quoted), label, weight
        if label == "end":
            return (False, quoted), label, weight
        if label == "report":
            return (True, quoted), label, weight
        return state, label, weight * (factor if (said or quoted) and label in ("insult", "threat") else 1)

    return Transducer((False, False), step)


def pattern(aimed: float = 1.5) -> Transducer:
    """Writes what a word adds to its clause: an insult its weight, more beside a target;
    a threat only with a target in the clause; a target that comes later adds the rest."""

    def step(state, label, weight):
        target, insult, threat = state
        if label == "end":
            return (False, 0.0, 0.0), "end", 0.0
        if label == "target":
            gain = insult * (aimed - 1) + threat if not target else 0.0
            return (True, insult, threat), "match" if gain else "skip", gain
        if label == "insult":
            return (target, insult + weight, threat), "match", weight * (aimed if target else 1)
        if label == "threat":
            return (target, insult, threat + weight), "match" if target else "skip", weight if target else 0.0
        return state, "skip", 0.0

    return Transducer((False, 0.0, 0.0), step)


def grammar() -> Transducer:
    return negation().then(reported()).then(pattern())


def labeller(lexicon: dict[str, float], threat: float = 2.0) -> Callable[[str], tuple[str, float]]:
    """The lexical transducer: a word to its label and weight."""
    fixed = {w: ("threat", threat) for w in THREAT}
    for words, label in ((TARGET, "target"), (NEGATION, "negation"), (REPORT, "report")):
        fixed |= {w: (label, 0.0) for w in words}
    known: dict[str, tuple[str, float]] = {}

    def label(token: str) -> tuple[str, float]:
        got = known.get(token)
        if got is None:
            if len(known) >= 300_000:
                known.clear()
            word = token.lower()
            weights = [lexicon[f] for f in entries(word) if f in lexicon]
            if weights:
                got = ("insult", max(weights))
            elif word in fixed:
                got = fixed[word]
            elif not word[0].isalpha():
                got = ("quote", 0.0) if word[0] in "\"“”«»" else ("end", 0.0)
            else:
                got = ("word", 0.0)
            known[token] = got
        return got

    return label


def entries(word: str) -> list[str]:
    """Lexicon entries a lower-cased word answers to: itself and its stems."""
    return ["=" + word, *("^" + word[:n] for n in STEMS if len(word) > n)] if len(word) > 2 else []


def matcher(lexicon: dict[str, float]) -> Callable[[str], np.ndarray]:
    """Function from a text to (best clause, all clauses on a log scale, share of matching
    clauses, weight per word on a log scale)."""
    label, machine = labeller(lexicon), grammar()

    def clauses(text: str) -> np.ndarray:
        labels = [label(t) for t in TOKEN.findall(text)]
        if not any(kind in ("insult", "threat") for kind, _ in labels):
            return np.zeros(FEATURES)
        scores, now, state = [], 0.0, machine.start
        for kind, weight in [*labels, ("end", 0.0)]:
            state, out, gain = machine.step(state, kind, weight)
            now += gain
            if out == "end":
                scores.append(now)
                now = 0.0
        hits = [s for s in scores if s > 0]
        return np.array([max(hits, default=0.0), np.log1p(sum(hits)), len(hits) / len(scores), np.log1p(100 * sum(hits) / len(labels))])

    return clauses


def _sketch(words: list[str]) -> int:
    """Near copies mostly share it, so they count once in what is learned."""
    parts = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
    return min((xxhash.xxh64_intdigest(" ".join(p)) for p in parts), default=0) >> 1


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Insult lexicon and calibration from at most ``sample`` labelled documents that aren't held out.

    Of rows that share an id, and of near copies, the one whose text has the least hash is learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("y is not null")
    chosen = known.filter(~held_out()).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # `sample` ids at most
    # One row of each id, the same on every run, so the sample bounds rows however often an id is repeated.
    data = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [WORD.findall(t.lower()) for t in batch.column("text").to_pylist()]
            found = [list({e for w in set(ws) for e in entries(w)}) for ws in words]
            keys = pa.array([_sketch(ws) for ws in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("y"), keys, pa.array(found, pa.list_(pa.string()))], ["text", "y", "sketch", "found"])

    sketched = data.mapInArrow(run, "text string, y int, sketch long, found array<string>")
    survivor = F.min_by(F.struct("text", "found"), F.struct(F.xxhash64("text"), "text")).alias("kept")
    data = stored(sketched.groupBy("sketch", "y").agg(survivor).select("kept.text", "y", "sketch", "kept.found"), "toxic_sample")
    sizes = {r[0]: r[1] for r in data.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, np.array([0.0] * FEATURES + [3.0 if toxic else -3.0])
    least = max(3, toxic // 200)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    counted = data.select("y", F.explode("found").alias("entry")).groupBy("entry").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n"))
    counted = counted.filter(F.col("t") >= least).withColumn("odds", odds).filter("odds >= 1.5")
    table = {r.entry: r.odds for r in counted.orderBy(F.desc(F.col("odds") * F.log1p("t")), "entry").limit(ENTRIES).collect()}
    held = data.filter("y = 1").select(F.array_intersect("found", F.array(*[F.lit(e) for e in table])).alias("found")) if table else None
    lexicon = _cover([r[0] for r in held.collect()] if held is not None else [], table, least)

    def make():
        clauses = matcher(lexicon)
        return lambda text: (clauses(text).tolist(),)

    numbered = data.select(F.monotonically_increasing_id().alias("doc_id"), "text", "y")
    x = per_text(numbered, make, "x array<double>").join(numbered.select("doc_id", "y"), "doc_id").orderBy("doc_id").select("x", "y").toPandas()
    return lexicon, _logistic(np.array(x["x"].tolist()), x["y"].to_numpy())


def _cover(found: list[list[str]], odds: dict[str, float], least: int, times: int = 4) -> dict[str, float]:
    """Entries that explain toxic documents not yet explained ``times`` over, the best
    first; words that merely occur in documents full of insults explain nothing new."""
    left = np.full(len(found), times)
    where: dict[str, list[int]] = {}
    for i, have in enumerate(found):
        for e in have:
            where.setdefault(e, []).append(i)
    at = {e: np.array(ids) for e, ids in where.items()}
    out: dict[str, float] = {}
    while at:
        gain = {e: (left[ids] > 0).sum() * min(odds[e], 6.0) for e, ids in at.items()}
        best = max(gain, key=lambda e: (gain[e], e[0] == "=", -len(e), e))
        ids = at.pop(best)
        if (left[ids] > 0).sum() < least:
            break
        left[ids] -= 1
        out[best] = float(odds[best])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Newton steps for a small logistic regression; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(x.shape[1])
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + decay * w), -5, 5)
    return w


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document: the probability of toxic 1.

    Null and empty texts match nothing and get the least score; ids without labels and
    repeated rows are scored like any other; without both labels the grammar is empty
    and every document gets the same score."""
    lexicon, w = learn(docs, labels, sample)

    def make():
        clauses = matcher(lexicon)

        def of(text: str) -> tuple:
            return (float(1 / (1 + np.exp(-np.clip(clauses(text) @ w[:-1] + w[-1], -30, 30)))),)

        return of

    out = per_text(docs, make, "score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
