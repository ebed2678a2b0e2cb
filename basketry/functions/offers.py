"""What the stores ask for a product as a few bytes a store, so that it can be shuffled with every line: whole agorot and steps between store numbers, in no more bytes than they need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes before a product's rows: the widths of a step, of a price and of a distance, and the first store.
HEAD = 11
#: Added to the width of prices that aren't whole agorot: these are kept as they are, in eight bytes.
RAW = 128


def whole(x: np.ndarray) -> np.ndarray:
    """floor(x) as Spark's: a long, of no number 0, at most the greatest."""
    x = np.floor(x)
    return x.astype(np.int64) if np.all(np.abs(x) < 2**62) else np.where(np.isnan(x), 0, np.clip(x, -(2.0**63), 2.0**63 - 1024)).astype(np.int64)


def agorot(x: np.ndarray) -> np.ndarray:
    """`money.agorot` of an array."""
    return whole(x * 100 + 0.5) / 100


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts + 0, 1, ... of each size, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)


def pack(sizes: np.ndarray, stores: np.ndarray, units: np.ndarray, away: np.ndarray | None = None) -> pa.Array:
    """A binary a product with its stores (ascending), their prices and, if given, how far they are. Bytes of the same rank stand together, so that the many zeros among them are compressed."""
    first = np.cumsum(sizes) - sizes
    steps = np.diff(stores, prepend=stores[:1])
    steps[first[sizes > 0]] = 0
    cents = np.round(units * 100) if len(units) and np.all(np.abs(units) < 2.0**45) and units.min() >= 0 else None
    if cents is None or not np.array_equal(cents / 100, units):
        prices, price_width, mark = np.ascontiguousarray(units, np.float64).view(np.uint64), 8, RAW
    else:
        prices, mark = cents.astype(np.uint64), 0
        price_width = _width(prices)
    parts = [(steps.astype(np.uint64), _width(steps)), (prices, price_width)] + ([(np.ascontiguousarray(away, np.float64).view(np.uint64), 8)] if away is not None else [])
    each = sum(w for _, w in parts)
    lengths = HEAD + sizes * each
    ends = np.cumsum(lengths)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    starts = ends - lengths
    out[starts], out[starts + 1], out[starts + 2] = parts[0][1], price_width + mark, 8 if away is not None else 0
    head = np.zeros(len(sizes), np.int64)
    head[sizes > 0] = stores[first[sizes > 0]]
    for i in range(8):
        out[starts + 3 + i] = (head >> (8 * i)) & 255
    at, step = _places(starts + HEAD, sizes), np.repeat(sizes, sizes)
    for values, width in parts:
        for i in range(width):
            out[at] = (values >> np.uint64(8 * i)) & np.uint64(255)
            at += step
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def unpack(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(sizes, stores, prices, distances or None) of what `pack` made; of a null nothing."""
    offsets = np.frombuffer(blobs.buffers()[1], np.int64 if pa.types.is_large_binary(blobs.type) else np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
    starts, lengths = offsets[:-1], np.diff(offsets)
    kept = np.flatnonzero(np.asarray(blobs.is_valid()) & (lengths >= HEAD))
    sizes = np.zeros(len(blobs), np.int64)
    if not len(kept):
        return sizes, np.zeros(0, np.int64), np.zeros(0), None
    heads = (data[starts[kept]].astype(np.int64) << 16) | (data[starts[kept] + 1].astype(np.int64) << 8) | data[starts[kept] + 2]
    kinds = np.unique(heads)
    widths = ((kinds >> 16), (kinds >> 8) & (RAW - 1), kinds & 255)
    sizes[kept] = (lengths[kept] - HEAD) // sum(widths)[np.searchsorted(kinds, heads)]
    ends = np.cumsum(sizes)
    stores, units = np.empty(ends[-1], np.int64), np.empty(ends[-1])
    away = np.empty(ends[-1]) if kinds[0] & 255 else None
    for kind in kinds:
        mine = kept[heads == kind]
        n = sizes[mine]
        at, step = _places(starts[mine] + HEAD, n), np.repeat(n, n)

        def taken(width: int) -> np.ndarray:
            value = data[at].astype(np.uint64)
            at.__iadd__(step)
            for i in range(1, width):
                value |= data[at].astype(np.uint64) << np.uint64(8 * i)
                at.__iadd__(step)
            return value

        head = np.zeros(len(mine), np.int64)
        for i in range(8):
            head |= data[starts[mine] + 3 + i].astype(np.int64) << (8 * i)
        far = np.cumsum(taken(int(kind) >> 16).view(np.int64))
        first = np.cumsum(n) - n
        some = n > 0
        base = np.zeros(len(mine), np.int64)
        base[some] = head[some] - far[first[some]]
        found = [far + np.repeat(base, n)]
        prices = taken((int(kind) >> 8) & (RAW - 1))
        found.append(prices.view(np.float64) if (int(kind) >> 8) & RAW else prices.astype(np.float64) / 100)
        if away is not None:
            found.append(taken(8).view(np.float64))
        rows = slice(None) if len(kinds) == 1 else _places(ends[mine] - n, n)
        for whole_column, x in zip((stores, units, away), found):
            whole_column[rows] = x
    return sizes, stores, units, away


def packed(sold: Column) -> Column:
    """`pack` of arrays of structs (store, price) or (store, price, distance), sorted by store."""

    @F.arrow_udf("binary")
    def told(x: pa.Array) -> pa.Array:
        return pack(x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *(c.to_numpy(zero_copy_only=False) for c in x.flatten().flatten()))

    return told(sold)


def unpacked(blobs: Column) -> Column:
    """The arrays `stores` and `units` of what `packed` made, in a struct; of a null nulls."""

    @F.arrow_udf("struct<stores:array<bigint>,units:array<double>>")
    def told(x: pa.Array) -> pa.Array:
        sizes, stores, units, _ = unpack(x)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.concatenate((np.asarray(x.is_null()), [False])))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(stores)), pa.ListArray.from_arrays(offsets, pa.array(units))], names=["stores", "units"])

    return told(blobs)
