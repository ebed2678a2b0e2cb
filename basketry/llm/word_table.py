"""BPE encoding and decoding through distinct words.

A text is cut at white space into words; what a word encodes to depends on the word alone, so each distinct word is encoded once
and its ids go back to the texts by position. Ids are decoded word by word too: the ids of every distinct word meet the vocabulary in
an id-to-piece join (`decode`), and a text's decoding is put together from its words' by position.

* The `hot` most frequent words (a fixed number, so their table has a size bound) are encoded and decoded into a table (word, ids, said) that
  goes to all tasks. A text becomes a list of places in that table. Frequent words, which would be hot keys of a join, are so joined without a
  shuffle. Words that no task has seen twice aren't counted; which words are in the table changes no result.
* Every other word goes as (text key, position, word) to the task that its hash names; there equal words lie next to each other, each
  distinct one is encoded once, and the ids go back by the text's key and position, where they meet the pieces. A word over LONGEST characters,
  which is never in the table, goes to one of SALTS tasks by its text, so it is encoded SALTS times at most however many texts have it.

The text's list of places and its rare words meet in one join on the text's key, which is spread by doc_id. A text without rare words,
as all texts of a large group of equal rows are, gets a key of its own, so such groups don't meet in one task.

Defined results: null is the empty text with no ids, which decodes to the empty text; special strings inside a text become their one id;
repeated rows are encoded each; other columns are kept; columns named like ours are replaced; empty input gives empty output.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .word_bpe import chunks, vocabulary

#: Words in the table that all tasks hold, at most; words longer than LONGEST characters are never in it, and go to SALTS tasks at most.
HOT, LONGEST, SALTS = 1_000_000, 64, 64
#: Distinct words that a task counts before it hands the counts on.
HELD = 300_000
#: Words of texts put together at once; characters of texts looked up at once.
TOGETHER, LOOKED_UP = 400_000, 8_000_000
#: Tasks that encode the frequent words.
TASKS = 16
#: Columns of the frequent words' table.
TABLE = ["word", "ids", "said"]
#: Second key of texts that have no rare words.
NO_RARE = -(1 << 63)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, of words that some task has seen twice at least."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    held.update(chunks(text))
                    if len(held) > HELD:
                        yield _repeated(held)
                        held = Counter()
        yield _repeated(held)

    counts = docs.select("text").mapInPandas(partial, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _repeated(held: Counter) -> pd.DataFrame:
    return pd.DataFrame([x for x in held.items() if x[1] > 1 and len(x[0]) <= LONGEST], columns=["word", "n"])


def encoder(path: str):
    @F.pandas_udf("array<int>")
    def encode_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for words in batches:
            yield pd.Series([x.astype(np.int32) for x in vocab.encode_chunks(words.tolist())], dtype=object)

    return encode_words


def pieces(spark, path: str) -> DataFrame:
    """(id, piece) of the vocabulary; its size is the vocabulary's."""
    found = vocabulary(path).pieces
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(found), dtype=np.int32), "piece": found}), "id int, piece string")


def decode(rows: DataFrame, path: str, keys: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """(keys, ids, out): ids meet the pieces in a broadcast join and the pieces are put together by position.

    `keys` tell the rows apart; rows that are dealt by some of them already aren't shuffled. Rows whose ids are null or empty decode to the empty text.
    """
    table = F.broadcast(pieces(rows.sparkSession, path))
    names = [f"d_{i}" for i in range(len(keys))]
    long = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.posexplode_outer(ids).alias("d_place", "d_id"))
    long = long.join(table, long["d_id"] == table["id"], "left")
    part = F.when(F.col("d_place").isNotNull(), F.struct("d_place", "d_id", "piece"))
    long = long.groupBy(*names).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return long.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("parts")["d_id"].alias(ids), F.concat_ws(" ", F.col("parts")["piece"]).alias(out))


def _pieces_of(ids: np.ndarray, table: pa.Table) -> pa.Array:
    """The same join inside a task: the pieces of ids, in their order."""
    rows = pa.table({"id": pa.array(ids.astype(np.int32)), "at": pa.array(np.arange(len(ids)))})
    return rows.join(table, "id", join_type="left outer", use_threads=False).sort_by("at")["piece"].combine_chunks()


def text_key(docs: DataFrame) -> list[Column]:
    """What tells rows apart: doc_id, where one repeats also 32 bits of the text's hash, and without doc_id 96 bits of it. Rows that agree have equal texts."""
    number, first, second = F.col("doc_id").try_cast("long"), F.xxhash64("text"), F.shiftright(F.xxhash64(F.lit("second"), "text"), 32)
    repeated = not docs.select(number.alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return [F.coalesce(number, first).alias("k1"), (second if repeated else F.when(number.isNull(), second).otherwise(0)).alias("k2")]


def _pack(codes: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Places as compressed byte planes: low bytes first, so that the mostly empty high ones cost little."""
    return squeeze.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = np.frombuffer(expand.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _column(held, name: str) -> pa.Array:
    """A column of the frequent words' table; a word's place in it stands for the word."""
    options = pa.ipc.IpcReadOptions(included_fields=[TABLE.index(name)])
    return pa.ipc.open_stream(held.value, options=options).read_all()[name].combine_chunks()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values end (0 first), and all values."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, "<u4")
    ends = np.asarray(column.offsets, np.int64)
    return ends - ends[0], np.asarray(column.flatten(), dtype="<u4")


def _joined(ends: np.ndarray, values: pa.Array) -> pa.Array:
    """The values between each end and the next one with a space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), " ")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts have about LOOKED_UP characters together; a longer text is alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + LOOKED_UP, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _looked_up(texts: pa.Array, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts in order, their places (len(words) for rare ones), and how many each text has."""
    split = [pa.array(chunks(x) if x else [], pa.string()) for x in texts.to_pylist()]
    flat = pa.concat_arrays([*split, pa.array([], pa.string())])
    which = flat.dictionary_encode()
    places = pc.fill_null(pc.index_in(which.dictionary, value_set=words), len(words)) if len(words) else pa.array(np.zeros(len(which.dictionary), np.int32))
    return flat, np.asarray(places)[np.asarray(which.indices)], np.fromiter(map(len, split), np.int64, len(split))


def encoded_by_word(rare: DataFrame, path: str) -> DataFrame:
    """rare (k1, k2, place, word) with the ids of the word instead of it, each row once; each distinct word is encoded once."""
    narrow = vocabulary(path).size <= 1 << 16

    def encode_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, last, before = vocabulary(path), (None, []), None
        for batch in batches:
            batch = batch.drop_duplicates(ignore_index=True)
            if len(batch) and before == tuple(batch.iloc[0]):
                batch = batch.iloc[1:].reset_index(drop=True)
            which, words = pd.factorize(batch["word"])
            known = [last[1]] if len(words) and words[0] == last[0] else []
            ids = known + [x.astype("<u2").view(np.int16) if narrow else x.astype(np.int32) for x in vocab.encode_chunks(words[len(known) :].tolist())]
            if len(words):
                last, before = (words[-1], ids[which[-1]]), tuple(batch.iloc[-1])
            yield pd.DataFrame({"k1": batch["k1"], "k2": batch["k2"], "place": batch["place"], "ids": pd.Series([ids[i] for i in which], dtype=object)})

    salt = F.when(F.char_length("word") > LONGEST, F.pmod("k1", F.lit(SALTS)))
    dealt = rare.repartition("word", salt).sortWithinPartitions("word", "k1", "k2", "place")
    out = dealt.mapInPandas(encode_sorted, f"k1 long, k2 long, place int, ids array<{'short' if narrow else 'int'}>")
    return out


def _frequent(docs: DataFrame, path: str, hot: int):
    """The most frequent words with their ids and what these decode to, as bytes that all tasks get."""
    with common.shuffles_removed(docs.sparkSession):
        found = count_words(docs).orderBy(F.desc("n"), "word").limit(hot).repartition(TASKS, "word")
        words = found.select("word", "n", encoder(path)("word").alias("ids")).repartition(TASKS, "word")
        table = decode(words, path, ["word", "n"], out="said").toArrow()
    table = table.sort_by([("n", "descending"), ("word", "ascending")]).select(TABLE)  # small places for frequent words
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """The kept columns (all, if none are named), and of each text ids (array<int>), ids_le (the same as little-endian unsigned 32-bit integers) and decoded."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("ids", "ids_le", "decoded")]
    held, listed = _frequent(docs, path, hot), docs.sparkSession.sparkContext.broadcast(vocabulary(path).pieces.tolist())

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _column(held, "word")
        for batch in (x for b in batches for x in _slices(b)):
            flat, places, sizes = _looked_up(batch["text"], words)
            missing = np.flatnonzero(places == len(words))
            owner = np.repeat(np.arange(len(sizes)), sizes)[missing]
            nth = np.arange(len(missing)) - np.searchsorted(owner, owner)  # among the rare words of its text
            columns = [batch["k1"].take(pa.array(owner)), batch["k2"].take(pa.array(owner)), pa.array(nth.astype(np.int32)), flat.take(pa.array(missing))]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "place", "word"])

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze, seen = _column(held, "word"), zstandard.ZstdCompressor(level=3), Counter()
        for batch in (x for b in batches for x in _slices(b)):
            _, places, sizes = _looked_up(batch["text"], words)
            codes = np.split(places, np.cumsum(sizes)[:-1])
            k1, k2 = batch["k1"].to_pylist(), batch["k2"].to_pylist()
            for i, own in enumerate(codes):
                if not (own == len(words)).any():
                    seen[k1[i], k2[i]] += 1  # the nth row of its key in the task, in whatever order rows come
                    k1[i], k2[i] = _own_key(k1[i], seen[k1[i], k2[i]]), NO_RARE
            kept = [i for i, name in enumerate(batch.schema.names) if name.startswith("c_")]
            columns = [*(batch.column(i) for i in kept), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([_pack(x, squeeze) for x in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), "k1", "k2", "places"])

    keyed = [c.cast("long").alias(n) for c, n in zip(text_key(docs), ("k1", "k2"))]
    rare = docs.select(*keyed, "text").mapInArrow(rare_words, "k1 long, k2 long, place int, word string")
    rare = encoded_by_word(rare, path).repartition("k1", "k2").groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("own"))
    rare = rare.select("k1", "k2", F.transform(F.col("own")["ids"], lambda x: F.size(x)).alias("sizes"), F.flatten(F.col("own")["ids"]).alias("ids"))
    rows = docs.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(keep)), *keyed, "text")
    blobs = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("places", T.BinaryType())])
    rows = rows.mapInArrow(compact, blobs).join(rare, ["k1", "k2"], "left")
    rows = rows.select(*(f"c_{i}" for i in range(len(keep))), "places", "sizes", "ids")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ends, flat), said, expand = _lists(_column(held, "ids")), _column(held, "said"), zstandard.ZstdDecompressor()
        n, parts = len(ends) - 1, pa.table({"id": np.arange(len(listed.value), dtype=np.int32), "piece": pa.array(listed.value, pa.string())})

        def of_group(codes: list[np.ndarray], own: tuple[np.ndarray, np.ndarray, pa.Array], kept: pa.RecordBatch) -> pa.RecordBatch:
            whole = np.concatenate(codes).astype(np.int64)
            missing = np.flatnonzero(whole == n)
            whole[missing] = n + np.arange(len(missing))
            table, spoken = np.concatenate([flat, own[1]]), pa.concat_arrays([said, own[2]])
            starts = np.r_[ends, len(flat) + np.cumsum(own[0])]
            first, sizes = starts[whole], starts[whole + 1] - starts[whole]
            ids = table[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            cuts = np.cumsum([0, *map(len, codes)])
            stops, some = np.r_[0, np.cumsum(sizes)][cuts], np.r_[0, np.cumsum(sizes > 0)][cuts]
            texts = _joined(some, spoken.take(pa.array(whole[sizes > 0])))
            spans = zip(stops[:-1].tolist(), stops[1:].tolist())
            columns = [pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), texts]
            return pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "ids", "ids_le", "decoded"])

        for batch in batches:
            kept = batch.select([x for x in batch.schema.names if x.startswith("c_")])
            words = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch["sizes"]), 0), dtype=np.int64))]
            sizes, own_ids = np.asarray(batch["sizes"].flatten(), dtype=np.int64), np.asarray(batch["ids"].flatten())
            own_ids = own_ids.view("<u2").astype("<u4") if own_ids.dtype == np.int16 else own_ids.astype("<u4")
            places = np.r_[0, np.cumsum(sizes)]
            own_said = _joined(places, _pieces_of(own_ids, parts))
            codes, size, at = [], 0, 0
            for i, blob in enumerate(batch["places"].to_pylist()):
                codes.append(_unpack(blob, expand))
                size += len(codes[-1])
                if size >= TOGETHER or i + 1 == len(batch):
                    a, b = words[at], words[i + 1]
                    yield of_group(codes, (sizes[a:b], own_ids[places[a] : places[b]], own_said[a:b]), kept.slice(at, i + 1 - at))
                    codes, size, at = [], 0, i + 1

    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType())]
    out = rows.mapInArrow(together, T.StructType([*rows.schema.fields[: len(keep)], *made]))
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)), "ids", "ids_le", "decoded")


def _own_key(k1: int, nth: int) -> int:
    """A key for the nth row that has k1."""
    x = (k1 + nth * 0x9E3779B97F4A7C15) % (1 << 64)
    return x - (1 << 64) if x >> 63 else x
