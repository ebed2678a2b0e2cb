"""Passages that repeat across documents against brute force, and the sketch against plain counts."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import queries, substring_dedup

DOCS = "doc_id long, text string"


def expected(rows):
    """{(doc_id, text): (words, removed, kept)}: every window of every document, outright."""
    texts = sorted({(i is not None, i or 0, i, t) for i, t in rows}, key=lambda x: x[:2] + ((x[3] is not None), x[3] or ""))
    starts, words = collections.defaultdict(list), {}
    for *_, i, t in texts:
        words[i, t] = (t or "").encode().split()
    hashed = {k: signed_hash(k[1]) for k in words}
    for k, w in words.items():
        for s in range(len(w) - 19):
            starts[tuple(w[s : s + 20])].append((k[0] is not None, k[0] or 0, hashed[k], s))
    out = {}
    for k, w in words.items():
        goes = [False] * len(w)
        for s in range(len(w) - 19):
            if min(starts[tuple(w[s : s + 20])]) < (k[0] is not None, k[0] or 0, hashed[k], s):
                goes[s : s + 20] = [True] * 20
        out[k] = (len(w), sum(goes), b" ".join(x for x, g in zip(w, goes) if not g).decode())
    return out


HASHES = {}


def signed_hash(text):
    return HASHES[text]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return [rng.choice(pool) + str(rng.randint(0, 30)) for _ in range(n)]

    passages = [prose(n) for n in (19, 20, 21, 25, 60, 150)]
    texts = []
    for _ in range(120):
        words = prose(rng.randint(0, 70))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = p
        texts.append(rng.choice([" ", "\n", "\t ", "  "]).join(words))
    texts += [texts[0], texts[1].upper(), None, "", " \t\n", "a " * 300, "x y " * 50, "a b 　 c\x85d " * 30, " ".join(prose(4000) + passages[4])]
    out = [(i * 3 % 140 - 5, t) for i, t in enumerate(texts)]
    return out + out[:4] + [(None, texts[2]), (None, None), (None, " ".join(passages[5])), (out[7][0], texts[9])]


def got(spark, rows, bits, n=5):
    docs = spark.createDataFrame(rows, DOCS).withColumn("Kept", F.lit("k")).withColumn("th", F.lit("t")).repartition(n)
    out = substring_dedup.deduplicated(docs, bits)
    assert out.columns[:4] == ["doc_id", "text", "Kept", "th"]
    return [tuple(r) for r in out.drop("Kept", "th").collect()]


@pytest.mark.parametrize("bits", [4, 12, 20])
def test_equals_brute_force(spark, rows, bits):
    """A sketch far too small lets everything pass to the exact grouping; the result stays the same."""
    HASHES.update({r[0]: r[1] for r in spark.createDataFrame(rows, DOCS).select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()})
    want = expected(rows)
    assert sorted(((i, t, *want[i, t]) for i, t in rows), key=str) == sorted(got(spark, rows, bits), key=str)


def test_each_task_alone_and_few_remembered(spark, rows, monkeypatch):
    HASHES.update({r[0]: r[1] for r in spark.createDataFrame(rows, DOCS).select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()})
    want = expected(rows)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "REMEMBER", 20)
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    for n in (1, 30):
        assert sorted(((i, t, *want[i, t]) for i, t in rows), key=str) == sorted(got(spark, rows, 14, n), key=str)


def test_no_rows(spark):
    assert got(spark, [], 12) == []
    assert got(spark, [(1, None), (None, "few words")], 12, 1)


def test_sketch_never_underestimates(spark, rows):
    counts = collections.Counter()
    for _, t in rows:
        counts.update(substring_dedup.Runs([(t or "").encode()]).anchor.tolist())
    anchors = np.array(list(counts), np.uint64)
    for bits in (6, 16, 22):
        told = substring_dedup.estimated_twice(substring_dedup.sketch(spark.createDataFrame(rows, DOCS).repartition(6), bits), anchors, bits)
        assert all(told[i] for i, a in enumerate(anchors.tolist()) if counts[a] > 1)
    assert (~told).sum() > 0.99 * sum(n == 1 for n in counts.values())  # and at a fitting size it tells them apart


def test_equal_windows_share_their_anchor():
    rng = random.Random(2)
    shared = [f"w{rng.randint(0, 9)}" for _ in range(40)]
    texts = [" ".join([f"u{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))] + shared + [f"v{rng.randint(0, 99)}"] * rng.randint(0, 30)).encode() for _ in range(20)]
    runs = substring_dedup.Runs(texts)
    of_window = {}
    for a, b, e in zip(runs.anchor.tolist(), runs.begin.tolist(), runs.end.tolist()):
        for s in range(b, e + 1):
            assert of_window.setdefault(int(runs.windows[s]), a) == a
    assert len(of_window) == len({tuple(t.split()[s : s + 20]) for t in texts for s in range(len(t.split()) - 19)})
    assert len(runs.anchor) < (runs.end - runs.begin + 1).sum() / 3


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_substring_dedup"]).fetchall()
    rows = queries.op13_substring_dedup(spark, sf)
    assert rows.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = [tuple(r) for r in rows.collect()]
    assert sorted(rows) == sorted(want) and sum(r[2] for r in rows) > 0
    blank = hashlib.sha256(b"").hexdigest()
    assert all(r[3] == blank for r in rows if r[1] == r[2])
