"""Token counts by rank-synchronous merging of ragged arrays.

Texts of a batch are cut at white space, the chunks not seen before by the task are split into pre-tokens, and all
these are merged together as one ragged numpy array, each by its own lowest rank per round; what is left is counted.
No shuffle: a row's count depends on the row alone.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as one token each;
repeated rows are counted each; other columns pass through `count_tokens`; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_bpe import REMEMBER, chunks, vocabulary

LIMIT = 2048
#: Characters merged together at most (a single text may be longer).
BATCH_CHARS = 4_000_000


def counter(path: str):
    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab, seen = vocabulary(path), {}

        def count(texts: list[str]) -> list[int]:
            nonlocal seen
            split = [[([*chunks(part)], special) for part, special in vocab.parts(x)] for x in texts]
            fresh = list({c for parts in split for part, _ in parts for c in part if c not in seen})
            if len(seen) + len(fresh) > REMEMBER and seen:
                seen = {}
                fresh = list({c for parts in split for part, _ in parts for c in part})
            seen.update(zip(fresh, vocab.count_chunks(fresh)))
            return [sum(sum(map(seen.__getitem__, part)) + (special is not None) for part, special in parts) for parts in split]

        for texts in batches:
            out, group, size = [], [], 0
            for x in texts:
                x = x or ""
                group.append(x)
                size += len(x)
                if size >= BATCH_CHARS:
                    out += count(group)
                    group, size = [], 0
            yield pd.Series(out + count(group), dtype="int64")

    return tokens


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; these replace columns of the same names."""
    text = common.text_or_empty("text")
    out = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", counter(path)(text))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
