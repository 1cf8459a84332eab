"""Conversation repair: the cheapest edits that give every conversation a legal structure.

A conversation is a sequence of (role, text) rows by turn. Legal are the role initials
``(s?(ua)+)?``: maybe a system message, then user and assistant in turn, or nothing. Edits are
Keep, Rerole, Delete and Insert; of equally cheap repairs the one whose initials are least in
ASCII order counts. The search is a depth-first branch-and-bound over (row, role before it): an
explicit stack, lower bounds of the remaining rows from a slightly wider grammar, an incumbent (cost,
edits), and a table of the best prefix at each node that eliminates worse ones. It ends when
no open prefix can beat the incumbent.

Conversations of up to ``PIECE`` rows are solved each in one go. Longer ones are cut into pieces
of that many rows; each piece is solved for every role before and after it, and the pieces'
costs and order are put together, so no task holds a whole long conversation's texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SLICE, look_up, stored

PIECE = 2048  # rows solved at once; a power of two
CHARS = 16_000_000  # characters of a conversation taken at once
START, SYSTEM, USER, ASSISTANT = range(4)  # role before a row
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # insertions at the end
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs
CLEAN, CUT, MUST_GO = range(3)  # fault of a row: none, truncated, blank or duplicate
LEGAL = ("su", "ua", "au")
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\v\f\r"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
Row = tuple[str, int]  # role initial, fault
Found = tuple[int, str]  # cost, edits


def keeps(before: int, initial: str) -> int | None:
    """Role after a kept row, if it may be kept there."""
    if initial == "s" and before == START:
        return SYSTEM
    if initial == "u" and before != USER:
        return USER
    return ASSISTANT if initial == "a" and before == USER else None


def lower_bounds(rows: list[Row], end: int | None) -> list[list[float]]:
    """Least cost of the rows from each on, by the role before it, where a conversation may also end
    after its system message. ``end``: the role at the end, if fixed."""
    none = float("inf")
    if end is None:
        after = [0.0, 0.0, float(INSERT), 0.0]
    else:
        after = [0.0 if role == end else none for role in range(4)]
    out = [after]
    for initial, fault in reversed(rows):
        cut = TRUNCATED if fault == CUT else 0
        now = [cost + DELETE for cost in after]
        if fault != MUST_GO:
            for role in range(4):
                kept = keeps(role, initial)
                now[role] = min(now[role], cut + REROLE + after[NEXT[role]], none if kept is None else cut + after[kept])
        user, assistant = now[USER], now[ASSISTANT]
        for role in range(4):  # insertions before the row, two at most
            now[role] = min(now[role], INSERT + (assistant if role == USER else min(user, INSERT + assistant)))
        after = now
        out.append(after)
    return out[::-1]


def search(rows: list[Row], start: int = START, end: int | None = None) -> Found | None:
    """Cost and edits of the best repair of ``rows`` after role ``start``: of a conversation's last
    rows (``end`` None, insertions at the end included), or with role ``end`` after the last row
    and no insertion behind it."""
    bounds = lower_bounds(rows, end)
    best: list[dict[int, Found]] = [{} for _ in range(len(rows) + 1)]
    incumbent: Found | None = None
    stack = [(0, start, 0, "")]
    while stack:
        i, role, cost, edits = stack.pop()
        known = best[i].get(role)
        if known is not None and known <= (cost, edits):
            continue
        least = cost + bounds[i][role]
        if incumbent is not None and (least, edits) > (incumbent[0], incumbent[1][: len(edits)]):
            continue
        if least == float("inf"):
            continue
        best[i][role] = (cost, edits)
        if i == len(rows):
            if end is None:
                done = (cost + INSERT * len(TAIL[role]), edits + TAIL[role])
            elif role == end:
                done = (cost, edits)
            else:
                continue
            incumbent = done if incumbent is None else min(incumbent, done)
            continue
        initial, fault = rows[i]
        steps = [(i + 1, role, cost + DELETE, edits + "D"), (i, NEXT[role], cost + INSERT, edits + "I")]
        if fault != MUST_GO:
            cut = TRUNCATED if fault == CUT else 0
            steps.append((i + 1, NEXT[role], cost + REROLE + cut, edits + "R"))
            after = keeps(role, initial)
            if after is not None:
                steps.append((i + 1, after, cost + cut, edits + "K"))
        steps.sort(key=lambda s: (s[2] + bounds[s[0]][s[1]], s[3]), reverse=True)
        stack += steps
    return incumbent


def edited(rows: list[tuple[str, str]], edits: str, role: int = START) -> list[tuple[str, str]]:
    """The messages that ``edits`` make of ``rows`` (role, text) after ``role``."""
    out, at = [], iter(rows)
    for edit in edits:
        if edit == "I":
            role = NEXT[role]
            out.append((NAMES[role], ""))
            continue
        name, text = next(at)
        if edit == "R":
            role = NEXT[role]
            out.append((NAMES[role], text))
        elif edit == "K":
            role = keeps(role, name[:1])
            out.append((name, text))
    return out


def fault_of(text: str) -> str | None:
    text = text.rstrip(BLANK_CHARS)
    if not text:
        return "blank"
    return None if text[-1] in ".!?" else "truncated"


def conversation(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The summary of a conversation and its repaired messages."""
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen: set[tuple[str, str]] = set()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    marks = []
    for row in rows:
        fault = fault_of(row[1])
        if fault != "blank" and row in seen:
            fault = "duplicate"
        seen.add(row)
        if fault:
            counts[fault] += 1
        marks.append((row[0][:1], CLEAN if fault is None else CUT if fault == "truncated" else MUST_GO))
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(marks, marks[1:]))
    cost, edits = search(marks)
    messages = [{"role": r, "text": t} for r, t in edited(rows, edits)]
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, messages


class Repaired(NamedTuple):
    """``conversations``: a row per conversation with its summary and ``messages`` (array of role,
    text; null for long conversations). ``long_messages``: ``conv_id, at, place, role, text``, the messages of long
    ones in the order of (at, place), or None if there are none."""

    conversations: DataFrame
    long_messages: DataFrame | None


def plain(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with roles and texts that are null as one space."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), of("role"), of("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by a checksum of conversation and turn: of 20 rows
    one each is dropped, emptied, loses its sentence ends, is repeated, or becomes a user's."""
    rows = plain(rows)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("fault", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, every: DataFrame | None = None, piece: int = PIECE, chars: int = CHARS, hot_rows: int = 1_000_000) -> Repaired:
    """The faults and the cheapest repair of every conversation of ``rows(conv_id, turn, role, text)``.

    Rows stand by turn, nulls first, and by role and text within a turn. Null roles and texts count
    as one space; rows without ``conv_id`` form one conversation. ``every(conv_id)`` names
    conversations that come out even if no row is left: zeros, no edits, no messages. Repeated
    rows are duplicates; other columns play no part; no rows give no rows but those of ``every``.
    ``piece`` (a power of two) and ``chars`` bound what one task takes of a conversation at once.
    """
    rows = plain(rows)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long_ids = stored(sizes.filter((F.col("n") > piece) | (F.col("chars") > chars)).select(F.col("conv_id").alias("id")), "long_conversations")
    none = long_ids.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    out = _short(rows if none else rows.join(long_ids, same, "left_anti"))
    messages = None
    if not none:
        summary, messages = _long(rows.join(long_ids, same, "left_semi"), piece, hot_rows)
        out = out.unionByName(summary, allowMissingColumns=True)
    if every is not None:
        every = every.select(F.col("conv_id").alias("id")).distinct()
        out = every.join(out, same, "left").drop("conv_id").withColumnRenamed("id", "conv_id")
        out = out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"])
    return Repaired(out, messages)


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, each as one row."""
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {SUMMARY}, messages array<struct<role string, text string>>"
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "messages"]
    message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = [pa.int64()] * 6 + [pa.string(), message]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                got = []
                for rows in part.column("rows"):
                    rows = rows.as_py()
                    got.append(conversation([r["turn"] for r in rows], [(r["role"], r["text"]) for r in rows]))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*got), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *columns], ["conv_id", *names])

    return lists.mapInArrow(run, schema)


def _long(rows: DataFrame, piece: int, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Summary and messages of conversations of any size, piece by piece."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    mark = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    copies = rows.groupBy(key.alias("key"), "conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    copies = stored(copies.withColumn("mark", mark).withColumn("place", F.struct(F.col("turn").isNotNull(), "turn")), "distinct_rows")
    firsts = copies.groupBy("key", "mark").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("heat"))
    known = look_up(copies, firsts, ["key", "mark"], "heat", hot_rows)
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    ended = F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")
    fault = F.when(blank, "blank").when(F.col("place") != F.col("first"), "duplicate").when(~ended, "truncated").otherwise("")
    known = known.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    total = copies.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = 1 + max((total[0] or 0) // (8 * piece), (total[1] or 0) // 64_000_000)
    order = ["key", F.col("turn").isNotNull(), "turn", "role", "text"]
    known = known.drop("mark", "place", "first").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lines = stored(known.withColumn("at", F.monotonically_increasing_id()), "ordered_rows")  # rises with the order
    lines = lines.withColumn("piece", F.expr(f"shiftright(at, {piece.bit_length() - 1})"))

    marks = lines.select("key", "piece", "at", "initial", "fault", "n")
    solved = stored(marks.groupBy("key", "piece").applyInPandas(_solve_piece, "key string, piece long, before int, after int, cost long, rank int, edits string, head string, foot string, illegal long"), "pieces")
    path = solved.drop("edits").groupBy("key").applyInPandas(_best_path, "key string, piece long, before int, after int, cost long, illegal long, tail string")
    path = stored(path, "best_path")
    chosen = stored(path.join(solved.select("key", "piece", "before", "after", "edits"), ["key", "piece", "before", "after"]), "chosen_edits")

    expanded = lines.select("key", "piece", "at", "n").groupBy("key", "piece").cogroup(chosen.groupBy("key", "piece")).applyInPandas(_expanded, "key string, piece long, audit string")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda x: x.audit), "")
    audits = expanded.groupBy("key").agg(audit.alias("audit"))
    costs = chosen.groupBy("key").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    more = lambda kind: F.sum(F.when(F.col("fault") == kind, F.col("n")).otherwise(0))
    repeats = F.sum(F.when(F.col("fault") == "duplicate", F.col("n")).when(F.col("fault") != "blank", F.col("n") - 1).otherwise(0))
    counts = lines.groupBy("key").agg(
        F.min(F.struct("conv_id")).alias("c"), more("blank").alias("blank"), repeats.alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    turns = lines.select("key", "turn").distinct().groupBy("key").agg(F.count("turn").alias("turns"))
    summary = counts.join(turns, "key").join(costs, "key").join(audits, "key")
    gaps = F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0))
    summary = summary.select(F.col("c.conv_id").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    texts = lines.select("key", "piece", "at", "role", "text")
    messages = texts.groupBy("key", "piece").cogroup(chosen.groupBy("key", "piece")).applyInPandas(_messages, "key string, at long, place int, role string, text string")
    named = F.when(F.col("key") != "", F.expr(f"cast(substring(key, 2) as {id_type})"))
    return summary, messages.select(named.alias("conv_id"), "at", "place", "role", "text")


def _solve_piece(rows: pd.DataFrame) -> pd.DataFrame:
    """The best repair of a piece for each role before and after it; copies of a row beyond the
    first are deleted right behind it."""
    rows = rows.sort_values("at")
    kinds = {"": CLEAN, "truncated": CUT}
    marks = [(i, kinds.get(f, MUST_GO)) for i, f in zip(rows["initial"], rows["fault"])]
    initials, n = list(rows["initial"]), rows["n"].to_numpy()
    illegal = int((n - 1).sum()) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    found = [(b, a, s) for b in range(4) for a in range(4) if (s := search(marks, b, a))]
    ranks = {e: i for i, e in enumerate(sorted({s[1] for *_, s in found}))}
    more = DELETE * int((n - 1).sum())
    out = [(rows["key"].iat[0], rows["piece"].iat[0], b, a, c + more, ranks[e], e, initials[0], initials[-1], illegal) for b, a, (c, e) in found]
    return pd.DataFrame(out, columns=["key", "piece", "before", "after", "cost", "rank", "edits", "head", "foot", "illegal"])


def _best_path(pieces: pd.DataFrame) -> pd.DataFrame:
    """The roles between the pieces of a conversation that make the best repair.

    Edits of paths that part in one piece are told apart there, as they hold a letter for
    every row and end with one; so a path's place among the others is its place before, then its rank."""
    best = {START: (0, 0, None)}  # cost, place among the paths, steps so far
    illegal, foot = 0, None
    for piece, rows in pieces.sort_values("piece").groupby("piece", sort=False):
        reached: dict[int, tuple] = {}
        for before, after, cost, rank in zip(rows["before"], rows["after"], rows["cost"], rows["rank"]):
            if before in best:
                sum_, place, steps = best[before]
                option = (sum_ + cost, (place, rank), (steps, piece, before, after))
                if after not in reached or option[:2] < reached[after][:2]:
                    reached[after] = option
        places = {p: i for i, p in enumerate(sorted({o[1] for o in reached.values()}))}
        best = {r: (c, places[p], s) for r, (c, p, s) in reached.items()}
        first = rows.iloc[0]
        illegal += int(first["illegal"]) + (foot is not None and foot + first["head"] not in LEGAL)
        foot = first["foot"]
    last = min(best, key=lambda r: (best[r][0] + INSERT * len(TAIL[r]), best[r][1]))
    cost, steps, out, key = best[last][0] + INSERT * len(TAIL[last]), best[last][2], [], pieces["key"].iat[0]
    tail = TAIL[last]
    while steps:
        steps, piece, before, after = steps
        out.append((key, piece, before, after, cost, illegal, tail))
        tail = ""
    return pd.DataFrame(out, columns=["key", "piece", "before", "after", "cost", "illegal", "tail"])


def _expanded(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """The edits of a piece with the deletions of repeated rows."""
    n = iter(rows.sort_values("at")["n"])
    parts = [e if e == "I" else e + "D" * (next(n) - 1) for e in chosen["edits"].iat[0]]
    return pd.DataFrame([(chosen["key"].iat[0], chosen["piece"].iat[0], "".join(parts) + chosen["tail"].iat[0])], columns=["key", "piece", "audit"])


def _messages(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """The messages of a piece; ``at`` is that of its first row."""
    rows = rows.sort_values("at")
    pick = chosen.iloc[0]
    made = edited(list(zip(rows["role"], rows["text"])), pick["edits"] + pick["tail"], int(pick["before"]))
    first = int(rows["at"].iat[0])
    return pd.DataFrame([(pick["key"], first, i, role, text) for i, (role, text) in enumerate(made)], columns=["key", "at", "place", "role", "text"])


def digests(repaired: Repaired) -> DataFrame:
    """The summary with ``repaired_sha256``: of the ``role:text`` lines of the repaired messages."""
    line = lambda m: F.concat(m.role, F.lit(":"), m.text)
    whole = F.coalesce(F.array_join(F.transform("messages", line), "\n"), F.lit(""))
    out = repaired.conversations.withColumn("repaired_sha256", F.sha2(whole.cast("binary"), 256)).drop("messages")
    if repaired.long_messages is None:
        return out
    long = _streamed(repaired.long_messages)
    joined = out.join(long, out["conv_id"].eqNullSafe(long["id"]), "left")
    return joined.withColumn("repaired_sha256", F.coalesce("streamed", "repaired_sha256")).drop("id", "streamed")


def _streamed(messages: DataFrame) -> DataFrame:
    """``id, streamed``: the digest of each long conversation, its lines read in order and never held
    together. A digest is made from front to back, so one task reads a conversation's lines."""
    import hashlib

    lines = messages.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place")
    kind = messages.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for i, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if digest is None or i != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest, between = i, hashlib.sha256(), ""
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
        if digest is not None:
            out.append((now, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], batch.schema.field("conv_id").type), pa.array([h for _, h in out])], ["id", "streamed"])

    return lines.mapInArrow(run, f"id {kind}, streamed string")
