"""Personal data: base patterns, overlapping candidates, boosted trees.

Everything runs as DataFrame expressions, row by row. Base spans come from fixed patterns with
validators. Broader patterns propose candidate spans; trees boosted on lessons made from the
whole corpus (all its base spans disguised, lookalikes made of their digits, and all candidates
that fail the validators) judge candidates by format and context. Those that pass their kind's
calibrated threshold and overlap no base span are added, and are redacted like the others."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import bound
from tideline.llm.common import held_out, stored, texts

KINDS = ("email", "ip", "card", "phone")
EVEN = 1_000  # all base spans of a kind weigh together as this many at most, and so do its failing candidates
PIECE = 200_000  # different lessons that one task holds while trees are fitted
BINS, LOOKED_AT = 32, 10_000  # places a feature may be cut at, and the lessons Spark ML takes them from with no more bins
CONTEXT = 24  # characters to each side that a candidate's context takes

# Possessive groups match the same as greedy ones here (nothing after them could take
# what they hold) and neither recurse nor step back on very long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HOLDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.:-])[0-9]{1,4}+(?:(?:[.:-]|\[\.\])[0-9]{1,4}+){3}+",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20.-]?[0-9]{2,6}+){2,6}+",
    "phone": r"(?<![0-9])(?:\+|00|\()?[0-9]{1,4}+(?:[\x20().-]{0,2}[0-9]{2,5}+){2,5}+",
}
CUES = {
    "email": r"mail|contact|kontakt|contacto|correo|courriel|@",
    "ip": r"\bip\b|host|server|addr",
    "card": r"card|visa|karte|carte|tarjeta|credit",
    "phone": r"tel|phone|call|fax|mobil|handy",
}
MATCHES = "array<struct<start:int,text:string,left:string,right:string>>"


def matches(text: Column, pattern: str, holds: str | None) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start, text, left, right>>``. A start is
    the length of the pieces between matches so far plus that of the matches; the context to
    each side ends at the next match."""
    split = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(z: Column) -> Column:
        pairs = F.zip_with(z.found, z.gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        pieces = F.zip_with(pairs, F.slice(z.gaps, 2, F.size(z.gaps)), lambda p, g: F.struct(p.m.alias("m"), p.g.alias("g"), g.alias("after")))
        hit = lambda acc, x: F.struct(
            (acc.at + F.length(x.g)).alias("start"), x.m.alias("text"), F.right(x.g, F.lit(CONTEXT)).alias("left"), F.left(x.after, F.lit(CONTEXT)).alias("right"),
        )
        return F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out")),
            lambda acc, x: F.when(x.m.isNull(), acc).otherwise(
                F.struct((acc.at + F.length(x.g) + F.length(x.m)).alias("at"), F.concat(acc.out, F.array(hit(acc, x))).alias("out"))
            ),
            lambda acc: acc.out,
        )

    has = text.rlike(pattern) if holds is None else text.contains(holds) & text.rlike(pattern)
    return F.when(has, bound(split, placed)).otherwise(F.array().cast(MATCHES))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(text, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(text))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(text))).otherwise(F.lit(False))
    return n.between(8, 15)


def _validator(kind: str) -> Callable[[Column], Column]:
    return lambda x: valid(kind, x.text)


def base_spans(text: Column) -> Column:
    """All base spans in the order of kinds, then start: ``array<struct<no, start, end, hit, left, right>>``."""

    def span(kind: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("no"), x.start.alias("start"), (x.start + F.length(x.text)).alias("end"),
            x.text.alias("hit"), x.left.alias("left"), x.right.alias("right"),
        )

    return F.concat(*[F.transform(F.filter(matches(text, BASE[k], HOLDS[k]), _validator(k)), span(k)) for k in KINDS])


def spans_text(spans: Column) -> Column:
    name = lambda no: F.element_at(F.array(*map(F.lit, KINDS)), no + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s.no), s.start.cast("string"), s.end.cast("string"))), ",")


def _features(kind: str, hit: Column, left: Column, right: Column) -> dict[str, Column]:
    """What the trees see of a candidate: its format, and what stands beside it."""
    count = lambda pattern: F.length(hit) - F.length(F.regexp_replace(hit, pattern, ""))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: F.length(g) > 0)
    longest = F.array_max(F.transform(groups, lambda g: F.length(g)))
    left, right = F.lower(left), F.lower(right)
    return {
        "kind_no": F.lit(KINDS.index(kind)), "size": F.length(hit), "digits": count("[0-9]"), "seps": count(r"[ ().-]"),
        "groups": F.size(groups), "longest": F.coalesce(longest, F.lit(0)), "plus": hit.startswith("+"), "paren": hit.startswith("("),
        "zeros": hit.startswith("00"), "dots": count(r"\."), "dashes": count("-"), "letters": count("[A-Za-z]"), "ends_in_word": hit.rlike("[A-Za-z]{2,}$"),
        "spelled": hit.rlike(r"[(\[](at|dot)[)\]]"), "bracketed": hit.contains("[.]"), "ten": hit.rlike(r"(?<![0-9])[0-9]{3}[ ).-]{1,2}[0-9]{3}[ .-][0-9]{4}$"),
        "year": hit.rlike(r"(?<![0-9])(19|20)[0-9]{2}(?![0-9])"), "valid": valid(kind, F.regexp_replace(hit, r"\[\.\]|[:-]", ".") if kind == "ip" else hit),
        "glued_left": left.rlike(r"[a-z0-9_]$"), "glued_right": right.rlike("^[a-z0-9_]"),
        "cue": left.rlike(CUES[kind]) | right.rlike(CUES[kind]), "digit_near": left.rlike("[0-9]") | right.rlike("[0-9]"),
    }


FEATURES = [
    "kind_no", "size", "digits", "seps", "groups", "longest", "plus", "paren", "zeros", "dots", "dashes", "letters", "ends_in_word",
    "spelled", "bracketed", "ten", "year", "valid", "glued_left", "glued_right", "cue", "digit_near",
]


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans that overlap no base span, with their features: ``array<struct<no, start, end, *features>>``."""

    def of(kind: str) -> Column:
        def made(x: Column) -> Column:
            facts = _features(kind, x.text, x.left, x.right)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("no"), x.start.alias("start"), (x.start + F.length(x.text)).alias("end"),
                *[facts[n].cast("double").alias(n) for n in FEATURES],
            )

        beside = lambda x: ~F.exists(base, lambda b: (b.start < x.start + F.length(x.text)) & (b.end > x.start))
        return F.transform(F.filter(matches(text, CANDIDATES[kind], None), beside), made)

    worth = text.rlike(r"[0-9]{2}|@|[(\[]at[)\]]")
    found = F.concat(*map(of, KINDS))
    return F.when(worth, found).otherwise(F.array())


def _disguises(hit: Column) -> dict[str, tuple[list[Column], list[Column]]]:
    """Per kind, disguised forms of a base span and lookalikes that are no personal data."""
    name, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    d = _digits(hit)
    cut = lambda *at: [F.substring(d, a, n) for a, n in at]
    tail = F.right(d, F.lit(10))
    area, three, four = F.substring(tail, 1, 3), F.substring(tail, 4, 3), F.substring(tail, 7, 4)
    other = F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))  # fails the check digit
    fours = lambda digits, sep: F.concat_ws(sep, *[F.substring(digits, a, 4) for a in (1, 5, 9, 13)])
    month, day = F.lpad((F.substring(d, 3, 2).cast("int") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.right(d, F.lit(2)).cast("int") % 28 + 1).cast("string"), 2, "0")
    year = F.concat(F.lit("20"), F.substring(d, 1, 2))
    numbers = [
        F.concat_ws("-", year, month, day), F.concat_ws(".", day, month, year), F.concat_ws(" ", F.concat_ws("-", year, month, day), F.concat(day, month)),
        F.left(d, F.lit(9)), F.left(d, F.lit(11)), F.concat_ws(".", *cut((1, 2), (3, 2), (5, 3))), F.concat_ws(" ", *cut((1, 2), (3, 3), (6, 3))),
        F.concat_ws("-", F.lit("978"), *cut((1, 2), (3, 5), (8, 2))), F.concat_ws(" ", year, F.concat(F.lit("19"), month), F.concat(F.lit("20"), day)),
    ]
    return {
        "email": (
            [F.concat(name, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))), F.concat(name, F.lit("[at]"), F.replace(host, F.lit("."), F.lit("[dot]"))), F.concat(name, F.lit("(at)"), host), F.concat(name, F.lit(" @ "), host)],
            [F.concat(F.lit("meet @ "), F.length(hit).cast("string"), F.lit(".30")), F.concat(F.lit("start (at) "), F.length(hit).cast("string"), F.lit(".45")), F.concat(F.lit("sold @ "), F.length(hit).cast("string"), F.lit(".99"))],
        ),
        "ip": (
            [F.replace(hit, F.lit("."), F.lit("-")), F.replace(hit, F.lit("."), F.lit("[.]"))],
            [F.concat_ws("-", year, month, day, month), F.concat_ws(".", month, F.lit("0"), F.concat(year), day), F.concat_ws(":", month, day, F.lit("45"), year)],
        ),
        "card": ([fours(d, ".")], [fours(other, "-"), fours(other, "."), fours(other, " "), other]),
        "phone": (
            [F.concat(F.lit("00"), F.substring(hit, F.lit(2), F.length(hit))), F.concat(F.lit("("), area, F.lit(") "), three, F.lit("-"), four), F.concat_ws("-", area, three, four), F.concat_ws(".", area, three, four)],
            numbers,
        ),
    }


def _weight(spans: int | None) -> Column:
    return F.lit(min(1.0, EVEN / (spans or 1)))


def lessons(found: DataFrame) -> DataFrame:
    """``doc_id, label, weight, *features`` from ``found(doc_id, base, cands)``: all base spans disguised (1)
    and lookalikes (0), each set in the context of its span and found by the candidate patterns,
    and all candidates of the texts themselves that fail their kind's validator (0). Weights keep
    the kinds even: the spans of a common kind share the weight of ``EVEN``."""
    failing = lambda c, no: (c.no == no) & (c.valid == 0)
    many = found.agg(
        *[F.sum(F.size(F.filter("base", lambda s: s.no == no))).alias(f"base_{no}") for no in range(len(KINDS))],
        *[F.sum(F.size(F.filter("cands", lambda c: failing(c, no)))).alias(f"own_{no}") for no in range(len(KINDS))],
    ).first()
    out = []
    for no, kind in enumerate(KINDS):
        spans = found.select("doc_id", F.explode("base").alias("b")).filter(F.col("b.no") == no).select("doc_id", "b.*")
        twins, decoys = _disguises(F.col("hit"))[kind]
        forms = [F.struct(F.lit(y).alias("twin"), e.alias("form")) for y, es in ((True, twins), (False, decoys)) for e in es]
        made = spans.select("doc_id", "left", "right", F.inline(F.array(*forms))).filter("form IS NOT NULL")
        made = made.select("doc_id", "twin", F.concat("left", "form", "right").alias("text"), F.length("left").alias("at"), F.length("form").alias("n"))
        made = made.withColumn("base", base_spans(F.col("text"))).withColumn("c", F.explode(candidates(F.col("text"), F.col("base"))))
        made = made.filter((F.col("c.start") == F.col("at")) & (F.col("c.end") == F.col("at") + F.col("n")))
        label = (F.col("twin") & (F.col("c.no") == no)).cast("double")
        out.append(made.select("doc_id", label.alias("label"), _weight(many[f"base_{no}"]).alias("weight"), *[f"c.{n}" for n in FEATURES]))
        own = found.select("doc_id", F.explode("cands").alias("c")).filter(failing(F.col("c"), no))
        out.append(own.select("doc_id", F.lit(0.0).alias("label"), _weight(many[f"own_{no}"]).alias("weight"), *[f"c.{n}" for n in FEATURES]))
    return reduce(DataFrame.unionByName, out)


def _tree(lines: Iterator[str]) -> Callable[[Column], Column]:
    """One printed tree as a function of a candidate: a leaf, or a question and its two sides."""
    line = next(lines)
    if leaf := re.search(r"Predict: (\S+)", line):
        return lambda c: F.lit(float(leaf[1]))
    name, limit = re.search(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    next(lines)  # the line of the other side
    high = _tree(lines)
    return lambda c: F.when(c[FEATURES[int(name)]] <= float(limit), low(c)).otherwise(high(c))


def probability(model: GBTClassificationModel) -> Callable[[Column], Column]:
    """The fitted trees as one expression of a candidate, so that candidates are judged inside their row."""
    parts = re.split(r"Tree \d+ \(weight (\S+)\):\n", model.toDebugString)[1:]
    trees = [(float(w), _tree(iter(body.splitlines()))) for w, body in zip(parts[::2], parts[1::2])]
    return lambda c: 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, [w * tree(c) for w, tree in trees])))


def fit(taught: DataFrame, trees: int = 12, precision: float = 0.98) -> Callable[[Column], Column] | None:
    """Whether a candidate is added. Each kind's threshold is the least one (0.5 or more) that keeps
    ``precision`` on the lessons of every fifth document, which the trees are not fitted on.

    Equal lessons become one with their number, so the trees see all of them in a table that
    grows with the different ones only. None if there is nothing to tell apart."""
    taught = taught.groupBy(held_out().alias("back"), "weight", "label", *FEATURES).agg(F.count("*").alias("n"))
    taught = stored(taught, "pii_lessons")
    first = taught.filter("NOT back")
    sizes = {r.label: r["count"] for r in first.groupBy("label").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        return None
    rows = sum(sizes.values())
    placed = first.repartition(math.ceil(rows / PIECE), *FEATURES).sortWithinPartitions("label", "weight", *FEATURES)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(placed.withColumn("weight", F.col("weight") * F.col("n")))
    bins = BINS if rows <= LOOKED_AT else math.isqrt(rows) + 1  # Spark ML takes the places to cut at from bins * bins lessons
    model = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.3, seed=1, maxBins=bins, cacheNodeIds=False, weightCol="weight").fit(vectors)
    p = probability(model)
    judged = taught.filter("back").withColumn("c", F.struct(*FEATURES)).withColumn("p", F.floor(p(F.col("c")) * 1000))
    judged = judged.groupBy("kind_no", "p", "weight").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    steps: dict[int, dict[int, list]] = {}
    for r in judged.orderBy(F.desc("p"), "weight").collect():  # 1,001 for each kind and weight at most
        step = steps.setdefault(int(r.kind_no), {}).setdefault(r.p, [0.0, 0.0])
        step[:] = step[0] + r.weight * r.good, step[1] + r.weight * r.n
    limits = [2.0] * len(KINDS)
    for no, by_p in steps.items():
        good = n = 0
        for at, step in by_p.items():
            good, n = good + step[0], n + step[1]
            if good and good >= precision * n and at >= 500:
                limits[no] = at / 1000
    limit = F.array(*map(F.lit, limits))
    return lambda c: p(c) >= F.get(limit, c.no)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s.no.alias("no"), s.start.alias("start"), s.end.alias("end")))


def _found(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("base", base_spans(F.col("text"))).withColumn("cands", candidates(F.col("text"), F.col("base")))


def _added(cands: Column, passes: Callable[[Column], Column] | None) -> Column:
    """Bare spans of the candidates that pass, each once."""
    chosen = F.filter(cands, passes) if passes else F.slice(cands, 1, 0)
    return F.array_distinct(_bare(chosen))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per document: counts
    and digest of the base spans; ``spans`` has the added ones too. Spans are code points,
    end exclusive, ordered by kind, then start.

    Texts are read once; what is found in them is written and judged. Null and empty texts have
    no spans; repeated and null ``doc_id`` come out row by row, each with its own spans; very long
    texts are searched whole; a kind without base spans to learn from gets no added spans."""
    found = stored(_found(docs).drop("text"), "pii_found")
    more = _added(F.col("cands"), fit(lessons(found)))
    out = found.select("doc_id", _bare(F.col("base")).alias("base"), more.alias("more"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s.no == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    digest = F.sha2(spans_text(F.col("base")).cast("binary"), 256)
    return out.select("doc_id", *counts, digest.alias("base_sha256"), spans_text(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[PII]") -> DataFrame:
    """``doc_id, clean_text`` row by row: every span of ``detect``, base and added, replaced; spans
    that overlap or touch the one before go with it."""
    rows = _found(docs)
    passes = fit(lessons(stored(rows.drop("text"), "pii_found")))
    spans = F.array_sort(F.transform(F.concat(_bare(F.col("base")), _added(F.col("cands"), passes)), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    text = F.col("text")
    kept = lambda a, b: F.substring(text, a + 1, b - a)

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc.out, F.array(kept(acc.at, s.start), F.lit(mask)))
        return F.when((s.start <= acc.at) & (acc.at > 0), F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out"))).otherwise(
            F.struct(s.end.alias("at"), new.alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc.out, ""), kept(acc.at, F.length(text))))
    return rows.select("doc_id", "text", spans.alias("spans")).select("doc_id", clean.alias("clean_text"))
