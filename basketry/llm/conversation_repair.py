"""Conversation structure repair by A* on the edit lattice.

A conversation is well formed if its turns' role initials read (s?(ua)+)?. Edits: keep a turn (0), give it the role user or assistant (3), delete it (4; a blank
or repeated turn must go), insert an empty turn (3, anywhere); a truncated turn that stays adds 3. Among the cheapest edits, that whose initials
(the audit) come first in ASCII order counts.

The lattice has a node for each (turns read, state of the pattern). A*'s heuristic at a turn is the suffix sum, from there on, of 4 for each turn that must go and
3 for each truncated one, which costs at least that whether it stays or goes. The queue is keyed (cost plus heuristic, audit), so the first goal taken has the
least cost and of those the first audit.

Turns are ranged over partitions by (conversation, turn, role, digest), without their texts. A conversation that lies within a partition and has up to SEGMENT turns is
searched as a whole; any other is cut into segments of SEGMENT turns, each searched from every state to every state, and the segments of one conversation are
joined by a shortest path over them. Two cheapest audits of one segment between the same states never begin with one another (what follows would be insertions, which cost), so the
least of joined audits is the join of least ones. What one task holds of a conversation is its audit, a letter a turn, and that at most sixteen times.
Texts are shuffled once, to where the edits are applied to them as they pass, sorted, in batches.

Defined results: null role and text count as one space; null turns come first; turns of the same number go by role, then by the digest of role and text;
rows with a null conv_id are one conversation; a role's initial is its first character, none if it is empty; repeated rows are repeated turns; extra
columns are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .streams import batches_of, rows_of, schema_of

#: States of the pattern: nothing yet, after s, after u, after a. The first and last may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SEGMENT = 512

KEYS = ["conv_id", "numbered", "turn", "role", "digest"]
SEGMENTS = "conv_id long, part int, seg int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long, paths array<struct<entry:int,exit:int,cost:long,audit:string>>"
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"


def wanted(state: int) -> str:
    """The role that may come after a state (after nothing, s may come as well)."""
    return "assistant" if state == USER else "user"


def after(state: int) -> int:
    return ASSISTANT if state == USER else USER


def search(turns: list[tuple[str, bool, bool]], entry: int, goals: tuple[int, ...], first_only: bool) -> dict[int, tuple[int, str]]:
    """By end state, (cost, audit) of the cheapest, then ASCII-least edits of turns (initial, must go, truncated) from a state.

    With first_only the search ends at the first of the goals, else when all that can be reached are.
    """
    n = len(turns)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if turns[i][1] else TRUNCATED if turns[i][2] else 0)
    found, settled, queue = {}, set(), [(ahead[0], "", 0, entry)]
    while queue:
        estimate, audit, i, state = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        cost = estimate - ahead[i]
        if i == n and state in goals:
            found[state] = (cost, audit)
            if first_only or len(found) == len(goals):
                break
        steps = [(INSERT, "I", i, after(state))]
        if i < n:
            initial, must_go, truncated = turns[i]
            steps.append((DELETE, "D", i + 1, state))
            if not must_go:
                stays = TRUNCATED * truncated
                if initial == wanted(state)[0]:
                    steps.append((stays, "K", i + 1, after(state)))
                elif initial == "s" and state == START:
                    steps.append((stays, "K", i + 1, SYSTEM))
                steps.append((RENAME + stays, "R", i + 1, after(state)))
        for extra, letter, j, to in steps:
            if (j, to) not in settled:
                heapq.heappush(queue, (cost + extra + ahead[j], audit + letter, j, to))
    return found


def joined(segments: Iterator[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation from the paths of its segments in order."""
    best = {START: (0, "")}
    for paths in segments:
        reached: dict[int, tuple[int, str]] = {}
        for entry, end, cost, audit in paths:
            if entry in best:
                way = (best[entry][0] + cost, best[entry][1] + audit)
                if end not in reached or way < reached[end]:
                    reached[end] = way
        best = reached
    return min(best[x] for x in ENDS if x in best)


def is_legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


class _Segment:
    """Turns of one conversation in order, up to SEGMENT of them, and what was counted in them."""

    def __init__(self, conv_id: int | None, whole_start: bool):
        self.conv_id, self.whole_start, self.turns = conv_id, whole_start, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, initial: str, blank: bool, repeated: bool, truncated: bool) -> None:
        if self.turns:
            self.illegal += not is_legal(self.turns[-1][0] + initial)
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += blank
        self.duplicate += not blank and repeated
        self.truncated += not blank and not repeated and truncated
        self.turns.append((initial, blank or repeated, truncated and not blank and not repeated))

    def row(self, part: int, seg: int, whole: bool) -> tuple:
        if whole:
            ways = [(START, search(self.turns, START, ENDS, True))]
        else:
            ways = [(x, search(self.turns, x, (START, SYSTEM, USER, ASSISTANT), False)) for x in range(4)]
        paths = [{"entry": entry, "exit": end, "cost": cost, "audit": audit} for entry, found in ways for end, (cost, audit) in found.items()]
        n, ends = len(self.turns), (self.turns[0][0], self.turns[-1][0]) if self.turns else ("", "")
        return (self.conv_id, part, seg, n, self.blank, self.duplicate, self.truncated, self.illegal, *ends, self.first_turn, self.last_turn, self.distinct, paths)


def _digest() -> Column:
    """Of role and text; the role's length keeps the two apart."""
    return F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, numbered (whether there is a turn number; false comes first), turn, role, digest, text."""
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return filled.select("conv_id", F.col("turn").isNotNull().alias("numbered"), "turn", "role", _digest().alias("digest"), "text")


def features(turns: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text), without the text: how many there are, blank, truncated, and whether it is the first of its role and text."""
    last = F.substring(F.rtrim("text", F.lit(common.GAP_CHARS)), -1, 1)
    rows = keyed(turns).select(*KEYS, (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    rows = rows.groupBy(*KEYS, "blank", "truncated").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("what")).agg(F.min("numbered").alias("numbers"), F.min("turn").alias("least"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("what"))
    is_first = F.when(F.col("numbers"), F.col("turn") == F.col("least")).otherwise(~F.col("numbered"))
    return rows.join(first, same).select(*KEYS, "blank", "truncated", "copies", is_first.alias("is_first"))


def segments(turns: DataFrame) -> DataFrame:
    """The searched segments of all conversations."""
    schema = schema_of(SEGMENTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            open_, seg, any_before = None, 0, False
            for conv_id, _, turn, role, _, blank, truncated, copies, is_first in rows_of(batches):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        yield open_.row(part, seg, open_.whole_start and seg == 0)
                        any_before = True
                    open_, seg = _Segment(conv_id, any_before), 0
                for k in range(copies):
                    if len(open_.turns) == SEGMENT:
                        yield open_.row(part, seg, False)
                        open_, seg = _Segment(conv_id, False), seg + 1
                    open_.add(turn, role[:1], blank, k > 0 or not is_first, truncated)
            if open_ is not None:  # the conversation may go on in the next partition
                yield open_.row(part, seg, False)

        yield from batches_of(rows(), schema)

    order = [F.col(c) for c in KEYS]
    return features(turns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, SEGMENTS)


def audits(turns: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation of turns (conv_id, turn, role, text)."""
    schema = schema_of(AUDITS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversation(parts: list[tuple]) -> tuple:
            sums = [sum(p[k] for p in parts) for k in (4, 5, 6, 7)]
            sums[3] += sum(not is_legal(a[9] + b[8]) for a, b in zip(parts, parts[1:]))
            numbered = [p for p in parts if p[10] is not None]
            gaps = 0
            if numbered:
                distinct = sum(p[12] for p in numbered) - sum(a[11] == b[10] for a, b in zip(numbered, numbered[1:]))
                gaps = numbered[-1][11] - numbered[0][10] + 1 - distinct
            cost, audit = joined([(x["entry"], x["exit"], x["cost"], x["audit"]) for x in p[13]] for p in parts)
            return (parts[0][0], gaps, *sums, cost, audit)

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            for row in rows_of(batches):
                if held and held[-1][0] != row[0]:
                    yield conversation(held)
                    held = []
                held.append(row)
            if held:
                yield conversation(held)

        yield from batches_of(rows(), schema)

    return segments(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(whole, AUDITS)


def repair(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place from 0, edit (K, R or I), role, text. `found` is what `audits` gives.

    A conversation's rows follow each other in order within one partition.
    """
    schema = schema_of(REPAIRED)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            audit, at, place, state, of = "", 0, 0, START, None

            def inserted() -> Iterator[tuple]:
                nonlocal at, place, state
                while at < len(audit) and audit[at] == "I":
                    yield (of, place, "I", wanted(state), "")
                    at, place, state = at + 1, place + 1, after(state)

            for conv_id, _, turn, role, digest, text, edits in rows_of(batches):
                if edits is not None:
                    audit, at, place, state, of = edits, 0, 0, START, conv_id
                    yield from inserted()
                    continue
                letter, at = audit[at], at + 1
                if letter != "D":
                    kept = role if letter == "K" else wanted(state)
                    yield (of, place, letter, kept, text)
                    place, state = place + 1, SYSTEM if letter == "K" and role[:1] == "s" else after(state)
                yield from inserted()

        yield from batches_of(rows(), schema, 500)

    heads = found.select("conv_id", F.lit(None).cast("boolean").alias("numbered"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), "audit")
    rows = keyed(turns).withColumn("audit", F.lit(None).cast("string")).unionByName(heads)
    order = [F.col(c) for c in KEYS]  # nulls first, so a conversation's audit comes before its turns
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(applied, REPAIRED)


def line_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the newline-joined `role:text` of every conversation that `repair` left turns of, taken as the rows pass, straight after `repair`."""
    schema = schema_of("conv_id long, repaired_sha256 string")

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            of, taken = None, None
            for conv_id, place, _, role, text in rows_of(batches):
                if place == 0:
                    if taken is not None:
                        yield (of, taken.hexdigest())
                    of, taken = conv_id, hashlib.sha256()
                else:
                    taken.update(b"\n")
                taken.update(f"{role}:{text}".encode())
            if taken is not None:
                yield (of, taken.hexdigest())

        yield from batches_of(rows(), schema)

    return repaired.mapInArrow(of_rows, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with planted faults, chosen by crc32(`conv_id:turn`) % 20: dropped, emptied, without ends of sentences, repeated, or set to user."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = (F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"])) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", filled["role"].alias("role"), filled["text"].alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("nth")).drop("nth")
