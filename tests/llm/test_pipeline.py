"""The numbered queries and the pipeline on the smallest tables, against brute force where they are whole results."""

import collections
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from basketry.llm import near_dup, queries  # noqa: E402

COLUMNS = {
    1: {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    2: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    3: {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    4: {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    5: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    6: {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    7: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    8: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    9: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    10: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    11: {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    12: {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    13: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
}


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table(spark, sf, name):
    number = int(name[2:].split("_")[0])
    df = queries.QUERIES[name](spark, sf)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[number]} == COLUMNS[number]
    if number in (11, 12):  # a row a conversation; the conversations that end at the nodes are all there are
        ids = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
        assert ids == (df.count() if number == 11 else df.where("depth = 0").first()["n_convs"])
        return
    table = "pages" if number in (1, 5) else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    source = docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert set(source.columns) <= set(out.columns)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == source.columns
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        sizes[name] = docs.count()
        if name == "near-duplicates":
            labels = near_dup.components(before).select("component_id").distinct().count()
            assert sizes[name] == labels
    assert 0 < sizes["near-duplicates"] <= sizes["quality rules"] <= source.count()
    assert sizes["near-duplicates"] == sizes["personal data"] and sizes["mixing"] == sizes["tokens"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = collections.Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "0")).join(labels, "doc_id").select("quality").collect())
    assert kept[(0,)] == 0


def test_pipeline_on_nothing(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
