"""Removal of passages that repeat across documents, with a count-min prefilter.

A window is WINDOW consecutive words of one document. A word goes if a window over it has a word sequence that also starts earlier: in a document with a smaller
doc_id, or earlier in the same one. Windows are judged on the input.

Pass 1 counts windows in a count-min sketch. A window is counted by its anchor, the least hash among its pieces of PIECE words (leftmost, if equal), so consecutive windows
mostly share one count, about a sixth of a count a window: equal windows have equal anchors at the same place in them, so an anchor's count is never below its windows' counts.
Each task fills a sketch of its own (its cells that aren't zero, with counters that stop at two); the tasks' sketches are added cell by cell and only "two or more" is
kept of the sum, ROWS * 2**CELLS bits, a fixed size, sent to all tasks. Pass 2 takes the windows whose count is estimated at two or more, whatever else fell on their cells, and groups them
exactly, by 128 bits: the hash of the anchor and that of the window. As the sketch only overestimates, no repeated window is lost; the more windows there are, the more
single ones pass it as well, up to all of them, which costs more rows in pass 2 and changes no result.

A run is the windows in a row that share an anchor. Equal runs are found first: within a task at once, then among tasks, so a passage that stands in a third of all
documents gives a row a run and task there, not one a document. Of equal runs all but the first go. Windows are grouped one by one only where an anchor still has several different
runs, as at the edges of passages.

Defined results: null and blank texts have no words; rows with a null doc_id come before all others; rows of equal doc_id go by the hash of their text, and rows with equal doc_id and text are
one document stated more than once, each judged alike; extra columns pass through `deduplicated`; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .streams import rows_of

WINDOW, PIECE = 20, 10
#: The sketch: rows of 2 ** CELLS counters each.
ROWS, CELLS = 2, 27
#: The sketch is added up in pieces of 2 ** SLICE cells.
SLICE = 21
#: Cells that a task holds before it adds equal ones up.
HELD = 4_000_000
#: Texts are handled together up to so many bytes (a single one may be longer).
BATCH_BYTES = 2_000_000
#: Runs that a task remembers before it begins anew.
REMEMBER = 500_000

# Odd 64-bit multipliers with mixed bits, as public hash functions use them (the last two are the finalizer of splitmix64).
BASE, OTHER_BASE, STEP, OTHER_STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0 .. n - 1; kept for texts to come."""
    found = _POWERS.get(int(base))
    if found is None or len(found) < n:
        found = np.full(max(n, BATCH_BYTES + (BATCH_BYTES >> 3)), base, np.uint64)
        found[0] = 1
        found = _POWERS[int(base)] = np.multiply.accumulate(found)
    return found[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Words:
    """Words of several texts together: byte offsets, two hashes a word, and the text each is of."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate(([True], white)).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(self.starts, bounds)  # of each text, the place of its first word; at last, the number of words
        values = mixed(data.astype(np.uint64) + np.uint64(1))
        self.one = self._hashes(values, BASE)
        self.two = self._hashes(values * MIX_B, OTHER_BASE)

    def _hashes(self, values: np.ndarray, base: np.uint64) -> np.ndarray:
        """Of every word, a polynomial in base of its bytes' values, by differences of prefix sums, and its length, scrambled."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)), dtype=np.uint64)))
        back = powers(inverse(base), len(values))
        return mixed((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))


def spans(hashes: np.ndarray, length: int, step: np.uint64) -> np.ndarray:
    """The hash of every `length` numbers in a row."""
    n = len(hashes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(step, n), dtype=np.uint64)))
    back = powers(inverse(step), n)
    return mixed((sums[length:] - sums[:-length]) * back[: n - length + 1])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Of every `width` values in a row, the place of the leftmost least one."""
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        far = min(have, width - have)
        right = best[far:] < best[: len(best) - far]
        place = np.where(right, place[far:], place[: len(place) - far])
        best = np.where(right, best[far:], best[: len(best) - far])
        have += far
    return place


class Runs:
    """The windows of several texts: runs (text, first window, last window, anchor) and hashes of windows."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, piece: int = PIECE):
        words = Words(texts)
        self.n_words = np.diff(words.first)
        total = len(words.one)
        empty = np.zeros(0, np.int64)
        self.text = self.begin = self.end = empty
        self.anchor = self.windows = np.zeros(0, np.uint64)
        if total < window:
            return
        owner = np.repeat(np.arange(len(texts)), self.n_words)
        pieces = spans(words.one, piece, STEP)
        place = least_places(pieces, window - piece + 1)
        starts = np.flatnonzero(owner[: total - window + 1] == owner[window - 1 :])
        if not len(starts):
            return
        self.windows = spans(words.two, window, OTHER_STEP)
        at = place[starts]
        fresh = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(starts) != 1)))
        self.begin = starts[fresh]
        self.end = starts[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(starts) - 1]))]
        self.anchor = pieces[at[fresh]]
        self.text = owner[self.begin]
        #: Of each run, its windows all together, and where its anchor lies in the first.
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.windows, dtype=np.uint64)))
        self.whole = mixed((sums[self.end + 1] - sums[self.begin]) + (at[fresh] - self.begin).astype(np.uint64) * MIX_A + (self.end - self.begin).astype(np.uint64) * MIX_B)
        self.offset = words.first[self.text]


def grouped(batches: Iterator[pa.RecordBatch], texts: int, most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with the bytes of their texts (column number `texts`), up to `most` bytes or one text together."""
    for batch in batches:
        sizes = np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column(texts)).to_pylist()), np.int64, batch.num_rows)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
            part = batch.slice(at, n)
            yield part, [x or b"" for x in part.column(texts).cast(pa.binary()).to_pylist()]
            at += n


def cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each anchor in each row of the sketch."""
    twice = mixed(anchor + MIX_B)
    return [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (twice, mixed(twice))][:ROWS]


def added(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their counts, two at most."""
    order = np.argsort(at, kind="stable")
    at, counts = at[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    return at[first], np.minimum(np.add.reduceat(counts, first) if len(first) else counts, 2).astype(np.uint8)


def sketch(texts: DataFrame, bits: int = CELLS) -> np.ndarray:
    """Bits, row after row, of the cells on which two or more anchors fall in all of texts.text together."""
    part_bits = min(SLICE, bits)
    schema = pa.schema([("piece", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, new = np.zeros(0, np.int64), np.zeros(0, np.uint8), []

        def together() -> tuple[np.ndarray, np.ndarray]:
            fresh = np.concatenate([held, *new])
            return added(fresh, np.concatenate([counts, np.ones(len(fresh) - len(held), np.uint8)]))

        waiting = 0
        for _, found in grouped(batches, 0):
            anchors = Runs(found).anchor
            new += [at + (row << bits) for row, at in enumerate(cells(anchors, bits))]
            waiting += ROWS * len(anchors)
            if waiting >= HELD:
                held, counts = together()
                new, waiting = [], 0
        held, counts = together()
        piece = held >> part_bits
        edges = np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1, [len(held)])) if len(held) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            inside = (held[a:b] & ((1 << part_bits) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([int(piece[a])], pa.int32()), pa.array([inside.tobytes()]), pa.array([np.packbits(counts[a:b] > 1).tobytes()])], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = None, np.zeros(1 << part_bits, np.uint8)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"piece": pa.array([of], pa.int32()), "twice": [np.packbits(sums > 1, bitorder="little").tobytes()]})

        for piece, inside, more in rows_of(batches):
            if piece != of:
                if of is not None:
                    yield row()
                of, sums = piece, np.zeros(1 << part_bits, np.uint8)
            at = np.frombuffer(inside, np.uint32)
            sums[at] = np.minimum(sums[at] + 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)), 2)
        if of is not None:
            yield row()

    parts = texts.select("text").mapInArrow(fill, "piece int, cells binary, counts binary")
    merged = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, twice binary")
    out, width = np.zeros(ROWS << max(bits - 3, 0), np.uint8), 1 << (part_bits - 3)
    with common.shuffles_removed(texts.sparkSession):
        rows = merged.collect()  # the sketch's fixed size
    for row in rows:
        out[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["twice"], np.uint8)
    return out


def estimated_twice(sketched: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    """Of each anchor, whether its count is estimated at two or more."""
    out = np.ones(len(anchor), bool)
    for row, at in enumerate(cells(anchor, bits)):
        at = at + (row << bits)
        out &= (sketched[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


RUNS = "doc_id long, th long, begin int, end int, anchor long, whole long, windows array<long>"


def repeated_runs(docs: DataFrame, bits: int = CELLS) -> DataFrame:
    """Runs of docs (doc_id, th, text) that the sketch doesn't rule out. Those without windows, anchor and whole were met before by the same task, in an earlier document or place."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch(docs, bits))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketched, seen = shared.value, {}
        for part, found in grouped(batches, 2):
            runs = Runs(found)
            keep = np.flatnonzero(estimated_twice(sketched, runs.anchor, bits))
            if not len(keep):
                continue
            ids, hashes = part.column(0).to_pylist(), part.column(1).to_pylist()
            text, place = runs.text[keep].tolist(), (runs.begin - runs.offset)[keep].tolist()
            first = np.zeros(len(keep), bool)
            for i, (t, at, key) in enumerate(zip(text, place, zip(runs.anchor[keep].tolist(), runs.whole[keep].tolist()))):
                # Nulls come first; of two equal runs the later is marked, whichever was met first.
                own = (ids[t] is not None, ids[t] or 0, hashes[t], at)
                before = seen.get(key)
                if before is None or own <= before:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen[key], first[i] = own, True
            sizes = np.where(first, runs.end[keep] - runs.begin[keep] + 1, 0)
            stops = np.cumsum(sizes)
            inside = np.repeat(runs.begin[keep] - (stops - sizes), sizes) + np.arange(stops[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(runs.windows[inside].view(np.int64)), mask=pa.array(~first))
            columns = [pa.array([ids[t] for t in text], pa.int64()), pa.array([hashes[t] for t in text], pa.int64()), pa.array(place, pa.int32()), pa.array((runs.end - runs.offset)[keep], pa.int32()), *(pa.array(x[keep].view(np.int64), mask=~first) for x in (runs.anchor, runs.whole)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "begin", "end", "anchor", "whole", "windows"])

    return docs.select("doc_id", "th", "text").mapInArrow(passed, RUNS)


def covered(docs: DataFrame, bits: int = CELLS) -> DataFrame:
    """doc_id, th and spans: ranges [from, to) of words that go, of every document of docs (doc_id, th, text) that loses any."""
    salt = F.when(F.col("windows").isNull(), F.pmod(F.hash("doc_id", "begin"), F.lit(4096)))  # what is known as repeated already has no key and only passes by
    same_run = Window.partitionBy("anchor", "whole", "salt").orderBy("doc_id", "th", "begin")  # a few rows a task and run
    runs = repeated_runs(docs, bits).withColumn("salt", salt).withColumn("place", F.rank().over(same_run))
    runs = common.cut(runs.select("doc_id", "th", "begin", "end", "anchor", F.when(F.col("place") == 1, F.col("windows")).alias("windows")))
    again = runs.where(F.col("windows").isNull()).select("doc_id", "th", "begin", "end")
    firsts = runs.where(F.col("windows").isNotNull())
    many = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    each = firsts.join(many, "anchor").select("doc_id", "th", "begin", "anchor", F.posexplode("windows").alias("nth", "window"))
    each = each.select("doc_id", "th", (F.col("begin") + F.col("nth")).alias("begin"), "anchor", "window")
    first = each.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "th", "begin")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("anchor").alias("of"), F.col("window").alias("what"), "first")
    later = each.join(first, (F.col("anchor") == F.col("of")) & (F.col("window") == F.col("what"))).where(F.struct("doc_id", "th", "begin") > F.col("first"))
    all_ = later.select("doc_id", "th", "begin", F.col("begin").alias("end")).unionByName(again)
    span = F.struct(F.col("begin").alias("from"), (F.col("end") + WINDOW).alias("to"))
    return all_.groupBy("doc_id", "th").agg(F.collect_set(span).alias("spans"))


def kept_words(text: bytes, spans: list | None) -> tuple[int, int, bytes]:
    """(words, words removed, the kept words joined by one space)."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, [x["from"] for x in spans], 1)
    np.add.at(marks, [x["to"] for x in spans], -1)
    stays = np.cumsum(marks[:-1]) == 0
    return len(words), int((~stays).sum()), b" ".join([w for w, s in zip(words, stays.tolist()) if s])


def deduplicated(docs: DataFrame, bits: int = CELLS) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space), under names that docs doesn't have yet."""
    id_, hash_, spans, words, removed, kept = common.scratch(docs, "id_of", "th", "spans", "n_words", "n_removed", "kept")
    rows = docs.withColumn(hash_, F.xxhash64(common.text_or_empty("text")))
    found = covered(rows.select("doc_id", F.col(hash_).alias("th"), common.text_or_empty("text").alias("text")), bits)
    found = found.select(F.col("doc_id").alias(id_), F.col("th").alias(f"{hash_}_of"), F.col("spans").alias(spans))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(f"{hash_}_of"))
    rows = rows.join(found, same, "left").select(*docs.columns, spans)
    made = [T.StructField(words, T.LongType()), T.StructField(removed, T.LongType()), T.StructField(kept, T.StringType())]
    at, over = docs.columns.index("text"), len(docs.columns)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in grouped(batches, at):
            told = [kept_words(x, s) for x, s in zip(texts, part.column(over).to_pylist())]
            new = [pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64()), pa.array([x[2].decode() for x in told], pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns[:over], *new], names=[*part.schema.names[:over], words, removed, kept])

    return rows.mapInArrow(shorten, T.StructType([*docs.schema.fields, *made]))
