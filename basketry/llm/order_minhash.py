"""Order MinHash fingerprints, from DataFrame functions alone.

The k-mers of a text (k words in a row; a shorter text is one k-mer) are numbered by occurrence, so the second copy of a
k-mer is another element than the first. Each numbered k-mer is hashed once; its top bits name one of `bins` bins, and in each
bin the 2 elements with the least hashes are kept, put in the order in which they stand in the text, and hashed as a
tuple; a bin that has one takes the least of the next filled bin as its second (round the end), so short texts have ordered tuples too. A fingerprint is the list of bins with their tuple hashes; two fingerprints are alike by the share of
bins filled in either in which they agree. As tuples hold the order, moving text about lowers the likeness as edits do, which
plain MinHash doesn't see.

How it stays native and near linear: (bits of the hash, place) are packed into longs, so both sorts are of primitive
arrays; the occurrence number of an element is its distance from the start of its run, found by halving steps and only
where its neighbour is equal.

Defined results: null is the empty text; a text without words has one k-mer, the empty one; equal texts have equal
fingerprints; repeated rows are fingerprinted each; other columns pass through `fingerprint`; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 5
BIN_BITS = 6
#: Bits of a packed long that hold the place: as many as an array can have.
PLACE = 31
_MASK = (1 << PLACE) - 1


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _top(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def fingerprint(docs: DataFrame, text: str, out: str, k: int = K, bin_bits: int = BIN_BITS) -> DataFrame:
    """docs with `out`, an array of longs: bin in the top bits, tuple hash below, one for each bin that is filled."""
    if out in docs.columns:
        docs = docs.drop(out)
    ws, kmers, runs, mins, low = common.scratch(docs, "f_words", "f_kmers", "f_runs", "f_sorted", "f_least")
    rows = docs.withColumn(ws, F.transform(common.words(text), lambda w: F.xxhash64(w)))
    n = F.size(ws)
    several = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(F.col(ws), i + j) for j in range(k))))
    rows = rows.withColumn(kmers, F.when(n >= k, several).otherwise(F.array(F.xxhash64(F.concat_ws(",", F.transform(ws, lambda x: x.cast("string")))))))
    pack = lambda h, i: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long"))
    rows = rows.withColumn(runs, F.sort_array(F.transform(kmers, pack)))
    equal = lambda x, i: F.coalesce(_top(F.get(F.col(runs), i)) == _top(x), F.lit(False))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(PLACE))))
    number = lambda x, i: F.when(
        equal(x, i - 1), F.aggregate(steps, F.lit(0), lambda far, step: F.when((i - far - step >= 0) & equal(x, i - far - step), far + step).otherwise(far))
    ).otherwise(0)
    bins = 64 - bin_bits
    rows = rows.withColumn(mins, F.sort_array(F.transform(runs, lambda x, i: F.xxhash64(_top(x), number(x, i)).bitwiseAND(F.lit(~_MASK)).bitwiseOR(_place(x)))))
    bin_of = lambda x: F.shiftright(x, bins)
    rows = rows.withColumn(low, F.filter(mins, lambda x, i: F.coalesce(bin_of(F.get(F.col(mins), i - 2)) != bin_of(x), F.lit(True))))
    second = lambda i: F.coalesce(F.get(F.col(low), i + 1), F.get(F.col(low), F.lit(0)))
    leads = F.filter(F.transform(low, lambda x, i: F.when(F.coalesce(bin_of(F.get(F.col(low), i - 1)) != bin_of(x), F.lit(True)), F.struct(x.alias("a"), second(i).alias("b")))), lambda p: p.isNotNull())

    def tuple_hash(p: Column) -> Column:
        a, b = p["a"], p["b"]
        both = F.when(a == b, F.xxhash64(_top(a))).when(_place(a) < _place(b), F.xxhash64(_top(a), _top(b))).otherwise(F.xxhash64(_top(b), _top(a)))
        return F.shiftleft(bin_of(a), bins).bitwiseOR(F.shiftrightunsigned(both, bin_bits))

    return rows.select(*(rows[c] for c in docs.columns), F.transform(leads, tuple_hash).alias(out))


def likeness(a: Column, b: Column, bin_bits: int = BIN_BITS) -> Column:
    """Share of the bins filled in either that hold the same tuple, 0 to 1."""
    bins = lambda x: F.transform(x, lambda y: F.shiftright(y, 64 - bin_bits))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(bins(a), bins(b))), F.lit(1))


def digest(fingerprint: Column) -> Column:
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def with_next(docs: DataFrame, columns: list[str], enrich: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """enrich(docs) with next_<column> of the row that follows by descending key, which is a number; the first row follows the last.

    Rows go to ranges of the key whose bounds are quantiles found by a sketch, so a range holds about 1 / parts of the rows;
    the first row of each range also goes to the range before it, where it comes last and is dropped again once the others have their next rows.
    What is broadcast is the key and hash of each range's first row, parts + 1 rows of two numbers at most.
    Rows with a null key come after all others. Ties of the key are put in the order of a hash of the columns, then of the columns.
    """
    parts = parts or 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, digest, guest, goes, h_part, h_key, h_digest, h_to = common.scratch(docs, "n_part", "n_digest", "n_guest", "n_goes", "h_part", "h_key", "h_digest", "h_to")
    plain = [c for c in columns if c in docs.columns]
    bounds = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = sorted({int(x) for x in bounds})
    number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x >= F.col(key))) if bounds else F.lit(0)
    rows = docs.withColumn(part, F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(number)).withColumn(digest, F.xxhash64(*plain))
    heads = rows.groupBy(F.col(part).alias(h_part)).agg(F.max(F.struct(key, digest)).alias("h"))
    ring = Window.orderBy(h_part)
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(h_part, F.col("h")[key].alias(h_key), F.col("h")[digest].alias(h_digest), F.coalesce(F.lag(h_part).over(ring), F.last(h_part).over(every)).alias(h_to))
    rows = enrich(rows).join(F.broadcast(heads), (F.col(part) == F.col(h_part)) & (F.col(digest) == F.col(h_digest)) & F.col(key).eqNullSafe(F.col(h_key)), "left")
    places = F.array(F.struct(F.col(part).alias("to"), F.lit(False).alias("guest")), F.struct(F.col(h_to).alias("to"), F.lit(True).alias("guest")))
    kept = [c for c in rows.columns if c not in (part, digest, h_part, h_key, h_digest, h_to)]
    rows = rows.select(*kept, digest, F.explode(F.when(F.col(h_to).isNull(), F.slice(places, 1, 1)).otherwise(places)).alias(goes))
    rows = rows.select(*kept, digest, F.col(goes)["to"].alias(part), F.col(goes)["guest"].alias(guest))
    inside = Window.partitionBy(part).orderBy(guest, F.col(key).desc_nulls_last(), F.col(digest).desc(), *map(F.col, plain))
    follow = F.lead(F.struct(*columns)).over(inside)
    rows = rows.withColumn(goes, follow).where(~F.col(guest))
    return rows.select(*kept, *(F.col(goes)[c].alias(f"next_{c}") for c in columns))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by the first as many code points of the following one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))
