"""Quality classifier: random-indexing word vectors pooled per document, then a small
two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import held_out, keep_texts, per_text, stored, texts

SAMPLE = 8_000  # labelled documents the classifier is fitted on, at most
ROWS = 1 << 14  # word vectors; words share rows by hash
WIDTH = 48
ONES = 4  # non-zero entries of a word's index vector
REACH = 2  # neighbours to each side that make a word's context
SHAPES = ("#shape:symbol", "#shape:bar", "#shape:digit", "#shape:upper", "#shape:long", "#shape:repeat")


def row_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word, seed=7) % ROWS


def index_vectors() -> np.ndarray:
    """The fixed sparse vectors of +1 and -1 that stand for context words."""
    rng = np.random.default_rng(7)
    out = np.zeros((ROWS, WIDTH), np.float32)
    for _ in range(ONES):
        out[np.arange(ROWS), rng.integers(0, WIDTH, ROWS)] += rng.choice([-1.0, 1.0], ROWS)
    return out


def reader() -> Callable[[str], np.ndarray]:
    """Function from a text to the rows of its words. A word is lower-cased and freed of
    edge punctuation; shape words stand beside words with symbols, digits and the like,
    and before each word equal to the one before it."""
    known: dict[str, tuple] = {}
    shape = {s: row_of(s) for s in SHAPES}

    def look(word: str) -> tuple:
        core = word.strip(".,;:!?()\"'").lower()
        out = [row_of(core)] if core else []
        if any(c in "#*$%&|<>" for c in word):
            out.append(shape["#shape:bar" if word == "|" else "#shape:symbol"])
        if any(c.isdigit() for c in word):
            out.append(shape["#shape:digit"])
        if word.isupper() and len(word) > 2:
            out.append(shape["#shape:upper"])
        if len(word) > 24:
            out.append(shape["#shape:long"])
        return tuple(out)

    def rows(text: str) -> np.ndarray:
        out: list[int] = []
        before = None
        for word in text.split():
            got = known.get(word)
            if got is None:
                if len(known) >= 300_000:
                    known.clear()
                got = known[word] = look(word)
            if word == before:
                out.append(shape["#shape:repeat"])
            before = word
            out += got
        return np.array(out, np.int64)

    return rows


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Sums of the index vectors of each word's neighbours over the sample, centred and of length one."""
    index = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = reader(), np.zeros((ROWS, WIDTH), np.float32)
        for batch in batches:
            for text in batch.column("text"):
                ids = rows(text.as_py())
                for gap in range(1, REACH + 1):
                    np.add.at(total, ids[gap:], index[ids[:-gap]])
                    np.add.at(total, ids[:-gap], index[ids[gap:]])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_pydict({"row": pa.array(used), "vector": pa.array(list(total[used]), pa.list_(pa.float32()))})

    summed = sample.select("text").mapInArrow(run, "row long, vector array<float>")
    at = [F.sum(F.col("vector")[i].cast("double")).alias(f"v{i}") for i in range(WIDTH)]
    found = summed.groupBy("row").agg(*at).toPandas()  # ROWS rows at most
    out = index.copy()  # words never seen keep their own index vector
    if len(found):
        out[found["row"]] = found[[f"v{i}" for i in range(WIDTH)]].to_numpy() + 1e-3 * index[found["row"]]
    out -= out.mean(axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pooled(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Mean word vector, shares of the shape words, and size; zeros for a text without words."""
    shapes = np.array([row_of(s) for s in SHAPES])
    out = np.zeros(WIDTH + len(SHAPES) + 2, np.float32)
    if len(ids):
        out[:WIDTH] = vectors[ids].mean(axis=0) * 4
        out[WIDTH:-2] = np.sqrt((ids[:, None] == shapes).mean(axis=0)) if len(ids) < 64 else np.sqrt(np.bincount(ids, minlength=ROWS)[shapes] / len(ids))
        out[-2] = np.log1p(len(ids)) / 8
        out[-1] = len(np.unique(ids)) / len(ids)
    return out


@dataclass
class Network:
    """Two layers; ``temperature`` divides the logit."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 300, decay: float = 1e-3) -> Network:
    """Adam on the logistic loss; every fourth row is kept back for early stopping and the temperature."""
    rng = np.random.default_rng(3)
    if not len(y) or y.min() == y.max():
        return Network(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), 3.0 if not len(y) or y.max() > 0 else -3.0)
    back = np.arange(len(y)) % 4 == 3 if len(y) >= 16 else np.zeros(len(y), bool)
    xt, yt = x[~back].astype(np.float64), y[~back].astype(np.float64)
    xv, yv = (x[back], y[back]) if back.any() else (xt, yt)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    best, kept, step = np.inf, None, 0
    for turn in range(rounds):
        for part in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // 256)):
            h = np.tanh(xt[part] @ p[0] + p[1])
            z = h @ p[2] + p[3][0]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yt[part]) / len(part)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [xt[part].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        loss = _loss(Network(p[0], p[1], p[2], p[3][0]).logits(xv), yv)
        if loss < best - 1e-5:
            best, kept, since = loss, [q.copy() for q in p], turn
        elif turn - since > 20:
            break
    net = Network(kept[0], kept[1], kept[2], float(kept[3][0]))
    z = net.logits(xv)
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(z / t, yv)))
    return net


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most ``sample`` labelled documents, taken by a hash
    of the id from those that aren't held out; null labels teach nothing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y is not null")
    chosen = known.filter(~held_out()).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    data = stored(texts(docs).join(F.broadcast(chosen), "doc_id"), "labelled")  # `sample` rows at most
    vectors = word_vectors(data)

    def make():
        rows = reader()
        return lambda text: (pooled(vectors, rows(text)).tolist(),)

    x = per_text(data, make, "x array<float>").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id")).select("x", "y").toPandas()
    width = WIDTH + len(SHAPES) + 2
    features = np.array(x["x"].tolist(), np.float32).reshape(len(x), width)
    return vectors, fit(features, x["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document: the probability of quality 1.

    Null and empty texts get the score of a text without words; ids without labels and
    repeated rows are scored like any other; without usable labels every score is high."""
    make = scorer(*train(docs, labels, sample))
    out = per_text(docs, lambda: lambda text, of=make(): (of(text),), "score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scorer(vectors: np.ndarray, net: Network) -> Callable[[], Callable[[str], float]]:
    def make() -> Callable[[str], float]:
        rows = reader()
        return lambda text: float(net.probability(pooled(vectors, rows(text))[None].astype(np.float64))[0])

    return make


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the classifier predicts to be of quality 1."""
    make = scorer(*train(docs, labels, sample))
    return keep_texts(docs, lambda: lambda text, of=make(): of(text) >= threshold)
