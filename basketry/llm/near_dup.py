"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of the text's word shingles.
Fingerprints link at `most` or fewer differing bits. Equal fingerprints are one node from the start, so exact copies cost
one row, however many there are.

Candidates: the bits are cut into m = 2 * most + 1 segments on a ring. By the pigeonring principle two linked fingerprints have a start
from which every chain of l consecutive segments differs in at most l * most / m bits: its first two segments agree, and of the next two at most one differs, by one bit.
The bits of segments i + 2 and i + 3 fall into GROUPS groups, of which at most one then differs: a node is filed for every start i and every group under segments i and i + 1 and all
groups but that one, 42 files of 33 or 34 bits for 3 bits. Each more bit halves the strangers that meet: random fingerprints meet fewer than in the 20 files of 32 bits that a choice of 3 out of 6
segments takes, and a twentieth of those that files of three whole segments (27 bits) would bring together. Within a file the chain is extended from its start and a pair is dropped at the first sum over budget; what comes round the whole ring has
passed the full Hamming check. A pair counts only in the first file of its first such start, so each is met once. Small files give their pairs
natively; large ones are cut into blocks, and each pair of blocks is one group that returns a spanning forest of its links
instead of all pairs, so a large group of near copies gives few rows and loses no component.

Components come from alternating star contractions on the links, each stored in the shared folder. Copies beyond counting share one node; where
rows meet their node again, a hot one is split by adaptive execution.

Defined results: null and blank texts have fingerprint 0 and link like any other; rows with a null doc_id count in the
components, whose id is the smallest doc_id that is not null (null if there is none); repeated rows are kept; extra columns
are ignored by `components` and pass through `one_of_each`, which keeps one row of every component, with or without doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
SEED = 42
MOST = 3
#: Groups that the bits with one link's budget are cut into for the files.
GROUPS = 6
#: Files of up to so many nodes give their pairs in one array, larger ones go by blocks of BLOCK nodes.
SMALL, BLOCK = 12, 2048
#: Shingle hashes held as bits at once.
CHUNK = 65_536


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), CHUNK):
        part = shingles[i : i + CHUNK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in part), "u8", len(part))
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a signed long."""

    @F.pandas_udf("long")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(x) for x in texts], dtype="u8").view("i8"))

    return of_batches(text)


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def segments(count: int) -> list[int]:
    """Masks of consecutive segments that together have all 64 bits, as evenly as possible."""
    ends = [64 * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(most: int) -> list[int]:
    """The segments; budgets of two links or more give chains whose first two segments agree."""
    return segments(2 * max(most, 2) + 1)


def groups(mask: int, count: int = GROUPS) -> list[int]:
    """The bits of a mask in groups of neighbours, as evenly as possible."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    ends = [len(bits) * i // count for i in range(count + 1)]
    return [sum(bits[a:b]) for a, b in zip(ends, ends[1:])]


def files(most: int = MOST) -> list[int]:
    """Masks of the files: by start i, then by the group of segments i + 2 and i + 3 that is left out."""
    masks = ring(most)
    m = len(masks)
    out = []
    for i in range(m):
        ahead = masks[(i + 2) % m] | masks[(i + 3) % m]
        out += [masks[i] | masks[(i + 1) % m] | (ahead ^ g) for g in groups(ahead)]
    return out


def chains(most: int = MOST) -> list[list[tuple[int, int]]]:
    """Per start, (mask, budget) of its chains of 3 segments and longer; the last goes round the ring with the budget `most`."""
    masks = ring(most)
    m, t = len(masks), max(most, 2)
    out = []
    for i in range(m):
        sums = [sum(masks[(i + k) % m] for k in range(n)) for n in range(m + 1)]
        out.append([(sums[n], n * t // m) for n in range(2, m)] + [(sums[m], most)])
    return out


def held_by(differing: Column, most: int = MOST) -> Column:
    """The first file whose chain the difference of two fingerprints stays within, null if it stays within none."""
    bits = lambda mask: F.bit_count(differing.bitwiseAND(F.lit(signed(mask))))
    out = F.lit(None).cast("int")
    masks = files(most)
    for i, chain in reversed(list(enumerate(chains(most)))):
        holds = bits(chain[0][0]) <= chain[0][1]
        for mask, budget in chain[1:]:
            holds = holds & (bits(mask) <= budget)
        first = F.coalesce(*(F.when(bits(masks[GROUPS * i + g]) == 0, GROUPS * i + g) for g in range(GROUPS)))
        out = F.when(holds, first).otherwise(out)
    return out


def forest(nodes: np.ndarray, start: int, most: int = MOST) -> np.ndarray:
    """Links (pairs of positions) of a spanning forest of the nodes whose chains from `start` stay within their budgets."""
    n, strip, chain = len(nodes), 256, chains(most)[start]
    linked = np.zeros((n, n), bool)
    for i in range(0, n, strip):
        differing = nodes[i : i + strip, None] ^ nodes[None, :]
        a, b = np.nonzero(np.bitwise_count(differing & np.uint64(chain[0][0])) <= chain[0][1])
        for mask, budget in chain[1:]:
            kept = np.bitwise_count(differing[a, b] & np.uint64(mask)) <= budget
            a, b = a[kept], b[kept]
        linked[i + a, b] = True
    left, out = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root], front = False, np.array([root])
        while len(front):
            near = np.zeros(n, bool)
            for x in front:
                near |= linked[x]
            front = np.flatnonzero(near & left)
            left[front] = False
            out += [(root, x) for x in front]
    return np.array(out, np.int64).reshape(-1, 2)


def filed(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, pick, value, n): each node of nodes.fp in every file where it isn't alone; n is how many are there."""
    masks = files(most)
    rows = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(x))) for x in masks))).alias("pick", "value"))
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pick", "value"))).where("n > 1")


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) with a < b, distinct: links between the distinct values of nodes.fp that keep every component whole."""
    rows = filed(nodes, most)
    small = rows.where(F.col("n") <= SMALL).groupBy("pick", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    few = small.select("pick", F.explode(pairs).alias("p")).where(held_by(F.col("p")["a"].bitwiseXOR(F.col("p")["b"]), most) == F.col("pick")).select("p.a", "p.b")
    whole = Window.partitionBy("pick", "value")
    ranked = rows.where(F.col("n") > SMALL).withColumn("block", F.floor((F.row_number().over(whole.orderBy("fp")) - 1) / BLOCK).cast("int"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    other = ranked.select("pick", "value", "fp", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    other = other.select("pick", "value", "fp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def of_blocks(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(group["fp"].to_numpy())
        pairs = fps[forest(fps.view("u8"), int(group["pick"].iloc[0]) // GROUPS, most)]
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    many = other.groupBy("pick", "value", "lo", "hi").applyInPandas(of_blocks, "a long, b long")
    return few.unionByName(many).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the smallest node of its component.

    Alternating large-star and small-star steps until the edges stay the same; each step is stored in the shared folder.
    """
    edges = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def labelled(marked: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, first, label) of every fingerprint of marked (doc_id, fp): its smallest doc_id, and the label of its component."""
    nodes = common.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = stars(links(nodes, most))
    return nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def components(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) and component_id of every row."""
    marked = common.cut(docs.select("doc_id", fingerprints(common.text_or_empty("text")).alias("fp")))
    named = labelled(marked, most)
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = named.join(least, "label").select("fp", "component_id")
    return marked.join(of_node, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, then the smallest hash of its text; rows without a doc_id come last."""
    kept_id, kept_hash, own_hash = common.scratch(docs, "n_id", "n_kept", "n_hash")
    text_hash = F.xxhash64(common.text_or_empty("text"))
    marked = common.cut(docs.select("doc_id", fingerprints(common.text_or_empty("text")).alias("fp"), text_hash.alias("hash")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    first = marked.join(labelled(marked, most).select("fp", "label"), "fp").groupBy("label").agg(F.min(order).alias("k"))
    first = first.select(F.col("k.doc_id").alias(kept_id), F.col("k.hash").alias(kept_hash))
    rows = docs.withColumn(own_hash, text_hash)
    stay = rows.join(first, rows["doc_id"].eqNullSafe(first[kept_id]) & (rows[own_hash] == first[kept_hash]), "left_semi")
    return stay.dropDuplicates(["doc_id", own_hash]).drop(own_hash)
