"""The trie of conversations' shared beginnings, from the LCP array of the sorted conversations.

A conversation is the sequence of its turns' digests (role and text). Conversations with equal sequences count as one, with their number and ids, so however many
copies there are, one row goes on. The sequences are ranged over partitions and sorted; the LCP of two neighbours is the number of turns they share. The Cartesian
tree over the LCP array, with nodes of equal LCP merged, has one node per LCP interval and one per sequence: the trie without the nodes that have one child and
the same members. Those are put back between a node's depth and its parent's ("expand missing depths").

All nearest smaller values are found in parallel: each partition runs the stack over its own LCPs and closes every interval whose nearest smaller values both
lie inside. What is left are the minima from its left edge and those from its right edge, at most one each per LCP value, with what was summed in them so far (least id, members,
children, leaves, saved tokens). One task runs the same stack over these minima of all partitions, in order; its input is bounded by partitions times shared depth, not by rows.

Defined results: null role and text are empty; null turns come first; turns of the same number go by their digest; rows without a conv_id
are of no conversation and are left out; repeated rows are repeated turns; extra columns are ignored; conversations without turns are members of the root
alone; an empty table has no trie, so no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .streams import batches_of, rows_of, schema_of

#: Bytes of a turn's digest.
WIDTH = 16
#: Bytes of a sequence that decide its partition; longer shared beginnings meet in one partition.
RANGED = 64 * WIDTH

#: A node: its id and its parent's, its depth and its parent's, least conv_id, members, children, leaves, tokens saved below its own chain, code points of the chain's turns, digest of the ids that end at it.
NODE = "part int, node long, up_part int, up_node long, depth int, above int, first long, members long, children long, leaves long, saved long, chain array<long>, ends string"
#: Of an edge of a partition's stack: its rank; the first has the outermost sequences of the partition.
EDGE = "rank int, head binary, tail binary"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (sym, chars): digest of role and text, code points of the text."""
    filled = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sym = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    key = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", sym.alias("sym"), F.char_length("text").cast("long").alias("chars"))
    rows = filled.select("conv_id", key.alias("k")).groupBy("conv_id").agg(F.sort_array(F.collect_list("k")).alias("k"))
    return rows.select("conv_id", F.transform("k", lambda x: F.struct(x["sym"].alias("sym"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, family: int = 100, shares: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % family in place of its own first h; h = crc32(c) % shares."""
    base = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, shares - 1).alias("base"))
    rows = own.join(base, F.col("conv_id") - F.col("conv_id") % family == F.col("base_id"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % shares).cast("int")
    none = F.array().cast("array<struct<sym:binary,chars:bigint>>")
    taken = F.slice(F.coalesce("base", none), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return rows.select("conv_id", F.concat(taken, rest).alias("turns"))


def sequences(rows: DataFrame) -> DataFrame:
    """Distinct sequences: key (the digests joined), chars, first (least conv_id), members, ends (SHA-256 of the ids, ascending, comma-joined)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["sym"])), ""))
    chars = F.transform("turns", lambda x: x["chars"])
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    return rows.select("conv_id", key.alias("key"), chars.alias("chars")).groupBy("key").agg(
        F.first("chars").alias("chars"), F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("members"), F.sha2(ids.cast("binary"), 256).alias("ends")
    )


def shared(a: bytes, b: bytes) -> int:
    """How many leading turns two keys have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    if n <= 64 * WIDTH:
        return len(os.path.commonprefix([a, b])) // WIDTH
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differs.argmax()) // WIDTH


class _Open:
    """A node whose interval isn't closed yet: sums of its closed children and of what ends at it."""

    __slots__ = ("depth", "id", "first", "members", "children", "leaves", "saved", "chars", "ends")

    def __init__(self, depth: int, id: tuple[int, int], chars: list[int], first: int | None = None, members: int = 0, ends: str | None = None):
        self.depth, self.id, self.chars, self.first, self.members, self.ends = depth, id, chars, first, members, ends
        self.children = self.leaves = self.saved = 0

    def take(self, first: int | None, members: int, children: int, leaves: int, saved: int) -> None:
        if first is not None:
            self.first = first if self.first is None else min(self.first, first)
        self.members, self.children, self.leaves, self.saved = self.members + members, self.children + children, self.leaves + leaves, self.saved + saved

    def sums(self) -> tuple:
        return (self.first, self.members, self.children, self.leaves, self.saved)


class _Stack:
    """Open nodes of growing depth; `closed` is called with a node and its parent as it closes."""

    def __init__(self, part: int, closed):
        self.part, self.closed, self.open, self.made = part, closed, [], 0

    def new_id(self) -> tuple[int, int]:
        self.made += 1
        return (self.part, self.made)

    def close_above(self, depth: int) -> _Open | None:
        """Close what is deeper than depth. A closed node's parent is the next open one, or a new one of that depth if the next is less deep.

        The bottom node reaches to the left edge of what the stack has seen; it is returned rather than closed, as only what comes before can tell how far it goes.
        """
        while len(self.open) > 1 and self.open[-1].depth > depth:
            node = self.open.pop()
            if self.open[-1].depth < depth:
                self.open.append(_Open(depth, self.new_id(), node.chars))
            self.finish(node, self.open[-1])
        return self.open.pop() if self.open and self.open[-1].depth > depth else None

    def finish(self, node: _Open, parent: _Open) -> None:
        own = max(node.members - 1, 0) * sum(node.chars[parent.depth : node.depth])
        parent.take(node.first, node.members, 1, node.leaves if node.children else 1, own + node.saved)
        self.closed(node, parent)


def _row(node: _Open, parent: _Open | None) -> tuple:
    above, up = (parent.depth, parent.id) if parent else (-1, (None, None))
    return (*node.id, *up, node.depth, above, node.first, node.members, node.children, node.leaves if node.children else 1, node.saved, node.chars[max(above, 0) : node.depth], node.ends)


def _edge(node: _Open, rank: int, head: bytes | None, tail: bytes | None) -> tuple:
    return (*node.id, None, None, node.depth, None, *node.sums(), node.chars[: node.depth], node.ends, rank, head, tail)


def local_nodes(ranged: DataFrame) -> DataFrame:
    """Closed nodes of each partition, and the edges of its stack (rank is not null), of sorted sequences."""
    schema = schema_of(f"{NODE}, {EDGE}")

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def rows() -> Iterator[tuple]:
            done: list[tuple] = []
            stack = _Stack(TaskContext.get().partitionId(), lambda node, parent: done.append((*_row(node, parent), None, None, None)))
            left: list[_Open] = []  # nodes from the left edge, deepest first
            head = last = None
            for key, chars, first, members, ends in rows_of(batches):
                if last is None:
                    head = key
                else:
                    lcp = shared(last, key)
                    if (edge := stack.close_above(lcp)) is not None:
                        left.append(edge)
                        stack.open.append(_Open(lcp, stack.new_id(), edge.chars))
                stack.open.append(_Open(len(key) // WIDTH, stack.new_id(), chars, first, members, ends))
                last = key
                yield from done
                done.clear()
            for rank, node in enumerate([*left, *stack.open]):
                yield _edge(node, rank, head if rank == 0 else None, last if rank == 0 else None)

        yield from batches_of(rows(), schema)

    return ranged.mapInArrow(climb, f"{NODE}, {EDGE}")


def joined_edges(edges: DataFrame, empty: DataFrame) -> DataFrame:
    """Nodes of the trie that reach over partitions, the root among them; part and node of each edge with the node it became part of, as rows without a depth.

    `empty` has the sequence without turns, if there is one.
    """
    schema = schema_of(NODE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            done: list[tuple[_Open, _Open | None]] = []
            stack, became = _Stack(-1, lambda node, parent: done.append((node, parent))), []
            root = _Open(0, stack.new_id(), [])
            stack.open.append(root)
            last = None
            for part, id, _, _, depth, _, first, members, children, leaves, saved, chars, ends, _, head, tail in rows_of(batches):
                if part is None:  # the sequence without turns
                    root.take(first, members, 0, 0, 0)
                    root.ends = ends
                    continue
                if head is not None:
                    lcp = shared(last, head) if last is not None else 0
                    stack.close_above(lcp)
                    last = tail
                stack.close_above(depth)
                if stack.open[-1].depth == depth:
                    node = stack.open[-1]
                    node.ends = node.ends or ends
                else:
                    node = _Open(depth, stack.new_id(), chars, ends=ends)
                    stack.open.append(node)
                node.take(first, members, children, leaves, saved)
                became.append(((part, id), node))
            if root.members or root.children or len(stack.open) > 1:
                stack.close_above(0)
                done.append((root, None))
            for node, parent in done:
                yield _row(node, parent)
            for (part, id), node in became:
                yield (part, id, *node.id, None, None, node.first, None, None, None, None, None, None)

        yield from batches_of(rows(), schema)

    plain = empty.select(
        *(F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("node", "long"), ("up_part", "int"), ("up_node", "long"), ("depth", "int"), ("above", "int"))), "first", "members",
        *(F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")), F.array().cast("array<bigint>").alias("chain"), "ends", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("binary").alias("head"), F.lit(None).cast("binary").alias("tail"),
    )
    return edges.unionByName(plain).repartition(1).sortWithinPartitions("part", "rank").mapInArrow(merge, NODE)


def trie(rows: DataFrame) -> DataFrame:
    """Every node of the trie over rows (conv_id, turns: array of (sym, chars)).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    found = common.cut(sequences(rows))
    ranged = found.where(F.length("key") > 0).repartitionByRange(F.substring("key", 1, RANGED)).sortWithinPartitions("key")
    local = common.cut(local_nodes(ranged.select("key", "chars", "first", "members", "ends")))
    edges = local.where(F.col("rank").isNotNull())
    over = common.cut(joined_edges(edges, found.where(F.length("key") == 0)))
    inner = local.where(F.col("rank").isNull()).drop("rank", "head", "tail")
    names = over.where(F.col("depth").isNull()).select("part", "node", "first")
    tops = over.where(F.col("depth").isNotNull())
    nodes = inner.unionByName(tops)
    parents = nodes.select("part", "node", "first").unionByName(names).select(F.col("part").alias("p_part"), F.col("node").alias("p_node"), F.col("first").alias("p_first"))
    nodes = nodes.join(parents, (F.col("up_part") == F.col("p_part")) & (F.col("up_node") == F.col("p_node")), "left")
    return expanded(nodes)


def expanded(nodes: DataFrame) -> DataFrame:
    """One row per depth of each node's chain, from its parent's depth to its own."""
    rows = nodes.select("*", F.explode(F.sequence(F.greatest(F.col("above") + 1, F.lit(0)), F.col("depth"))).alias("at"))
    last, top = F.col("at") == F.col("depth"), F.col("at") == F.col("above") + 1
    below = F.aggregate(F.slice("chain", F.greatest(F.col("at") - F.col("above"), F.lit(1)), F.size("chain")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        F.col("first").alias("conv_id"),
        F.col("at").cast("long").alias("depth"),
        F.when(F.col("at") > 0, F.when(top, F.col("p_first")).otherwise(F.col("first"))).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("members") - 1) * below).alias("saved_tokens"),
        F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

