"""The counts of op4 against its base patterns, on texts to which the tagger adds spans."""

import hashlib
import re

from basketry.llm import queries

KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits(x)))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
}


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def test_counts_are_those_of_the_base(spark, tmp_path):
    shown = ["mail anna.b (at) firm (dot) example (dot) com now", "Tel: (212) 555-0142, or 212-555-0142.", "IP 10[.]20[.]30[.]4 from", "call 0049 30 1234567!", "card 4111.1111.1111.1111 ok", "a@b.co 1.2.3.4 4111 1111 1111 1111 +49 (30) 123-4567", None, ""]
    spark.createDataFrame(list(enumerate(shown * 4)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_personal_data(spark, str(tmp_path)).collect()
    assert len(rows) == 4 * len(shown)
    assert sum(len(r["spans"].split(",")) for r in rows if r["spans"]) > sum(r[f"n_{k}"] for r in rows for k in KINDS)  # the tagger did add some
    for r in rows:
        text = shown[r["doc_id"] % len(shown)] or ""
        base = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in KINDS.items()}
        assert {k: r[f"n_{k}"] for k in KINDS} == {k: len(x) for k, x in base.items()}
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, x in base.items() for a, b in x).encode()).hexdigest()
