"""Language identification by compression with per-language zstandard dictionaries.

Each language has a raw-content dictionary made of texts that are labelled with it. A text in lower case, with one space for whatever
is no letter, is cut into pieces of CHUNK characters, and every piece is compressed with every dictionary; the language with the smallest total wins. The margin is the share by which
the best total is below the second; narrow margins are marked as rejected, and callers may drop those.

Learning reads labelled rows only. Labels are counted per language, and about SAMPLE rows per language, those whose hash of doc_id
lies below sample / count, give EXCERPT characters each from their middle, so a dictionary has a size bound whatever the
table's size is. The texts to predict are only mapped over, so there is no shuffle of them.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if nothing could be learned; ties go to
the language with more labelled rows, then by name; repeated rows are predicted each; other columns pass through; columns named like ours are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Rows a dictionary is made of, about; characters of each. A dictionary has about SAMPLE * EXCERPT characters at most, in every language.
SAMPLE, EXCERPT = 500, 500
#: Characters compressed at once; zstandard's level.
CHUNK, LEVEL = 4_096, 9
#: Margin under which a prediction counts as rejected.
NARROW = 0.01
#: Margin at which the score is about two thirds.
SCALE = 0.03

_LETTER, _OTHER = regex.compile(r"\p{L}"), re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """The dictionary of each language, the most frequent first, from the rows of docs (doc_id, text, lang) that have a language."""
    rows = docs.where(F.col("lang").isNotNull() & (F.char_length("text") > 0))
    counts = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(y for k, n in sorted(counts.items()) for y in (F.lit(k), F.lit(min(1.0, sample / n)))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    start = F.greatest(F.lit(1), F.floor((F.char_length("text") - excerpt) / 2) + 1).cast("int")
    chosen = rows.where(draw < share[F.col("lang")]).select("lang", draw.alias("draw"), F.substring("text", start, F.lit(excerpt)).alias("part"))
    parts: dict[str, list[str]] = {}
    for x in sorted(chosen.collect(), key=lambda x: (x["lang"], x["draw"], x["part"])):
        parts.setdefault(x["lang"], []).append(x["part"])
    ordered = sorted(parts, key=lambda k: (-counts[k], k))
    return {k: "".join(dict.fromkeys(map(normal, parts[k]))).encode() for k in ordered}


def _sizes(text: str, coders: list[zstandard.ZstdCompressor]) -> np.ndarray:
    pieces = [text[i : i + CHUNK].encode() for i in range(0, len(text), CHUNK)]
    return np.array([sum(len(c.compress(x)) for x in pieces) for c in coders], dtype=np.float64)


def _coders(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in dictionaries.values():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))
    return out


def predictor(dictionaries: dict[str, bytes], narrow: float = NARROW, scale: float = SCALE):
    names = list(dictionaries)

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = _coders(dictionaries)
        for texts in batches:
            out = []
            for text in texts:
                if not text or not names or not _LETTER.search(text):
                    out.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                sizes = _sizes(normal(text), coders)
                order = np.argsort(sizes, kind="stable")
                margin = float(1 - sizes[order[0]] / sizes[order[1]]) if len(names) > 1 else 1.0
                out.append((names[order[0]], float(1 - np.exp(-margin / scale)), margin, margin < narrow))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "margin", "rejected"])

    return predict


def identify(docs: DataFrame, dictionaries: dict[str, bytes], **options) -> DataFrame:
    """docs with lang_pred, score, margin and rejected, from the texts alone."""
    ours = ("lang_pred", "score", "margin", "rejected")
    kept = [c for c in docs.columns if c.lower() not in ours]
    found = common.scratch(docs, "l_found")[0]
    rows = docs.select(*kept, predictor(dictionaries, **options)(F.col("text")).alias(found))
    return rows.select(*kept, *(F.col(found)[c].alias(c) for c in ours))
