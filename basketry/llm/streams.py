"""Rows of Arrow batches as tuples and back, for functions that pass over sorted rows with little in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def schema_of(text: str) -> pa.Schema:
    """The Arrow schema of a DDL string; called on the driver, as it asks the session's parser."""
    return to_arrow_schema(_parse_datatype_string(text))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield made()
            held = []
    if held:
        yield made()
