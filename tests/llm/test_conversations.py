"""Conversation repair and the prefix trie against brute force on small conversations, with nulls, ties, repeated rows, long ones and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketry.llm import common, conversation_repair, queries

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"


def blank(text):
    return not text.strip(WHITE)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def damaged_rows(conv_id, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by dynamic programming over all prefixes: an own way, without a queue or a heuristic."""
    kinds, n = faults(rows), len(rows)
    best = {(0, ""): (0, "", ())}  # (rows read, role initials so far shortened to the state) to the least way
    legal = re.compile(r"(s?(ua)*u?)?$")

    def better(into, key, way):
        if key not in into or way[:2] < into[key][:2]:
            into[key] = way

    def state(initials):
        return "" if not initials else "s" if initials == "s" else initials[-1]

    layer = {"": (0, "", ())}
    for i in range(n + 1):
        for _ in range(3):  # insertions, until nothing changes
            for s, (cost, audit, made) in list(layer.items()):
                role = "assistant" if s == "u" else "user"
                better(layer, role[0], (cost + 3, audit + "I", (*made, (role, ""))))
        if i == n:
            break
        _, role, text = rows[i]
        nxt = {}
        for s, (cost, audit, made) in layer.items():
            better(nxt, s, (cost + 4, audit + "D", made))
            if kinds[i] in ("", "truncated"):
                stays, due = 3 * (kinds[i] == "truncated"), "assistant" if s == "u" else "user"
                if role[:1] == due[0]:
                    better(nxt, due[0], (cost + stays, audit + "K", (*made, (role, text))))
                if role[:1] == "s" and s == "":
                    better(nxt, "s", (cost + stays, audit + "K", (*made, (role, text))))
                better(nxt, due[0], (cost + 3 + stays, audit + "R", (*made, (due, text))))
        layer = nxt
    del best, legal, state
    cost, audit, made = min(layer[s] for s in ("", "a") if s in layer)
    return cost, audit, made


def every_edit(rows, most_inserts):
    """The cheapest audit by trying all edits outright; for tiny conversations."""
    kinds, best = faults(rows), None
    for spots in itertools.product(range(most_inserts + 1), repeat=len(rows) + 1):
        for letters in itertools.product("KRD", repeat=len(rows)):
            if any(k in ("blank", "duplicate") and x != "D" for k, x in zip(kinds, letters)):
                continue
            steps = ["I"] * spots[0] + [y for x, m in zip(letters, spots[1:]) for y in [x] + ["I"] * m]
            cost, made, i, good = 0, "", 0, True
            for x in steps:
                due = "a" if made.endswith("u") else "u"
                if x == "I":
                    cost, made = cost + 3, made + due
                    continue
                if x == "D":
                    cost += 4
                elif x == "R":
                    cost, made = cost + 3 + 3 * (kinds[i] == "truncated"), made + due
                else:
                    cost, made = cost + 3 * (kinds[i] == "truncated"), made + (rows[i][1][:1] or "?")
                i += 1
            good = re.fullmatch("(s?(ua)+)?", made)
            if good and (best is None or (cost, "".join(steps)) < best):
                best = (cost, "".join(steps))
    return best


def expected(rows):
    """What op11 gives for rows (conv_id, turn, role, text)."""
    by = collections.defaultdict(list)
    for conv_id, *rest in rows:
        by[conv_id].append(tuple(rest))
    out = {}
    for conv_id, own in by.items():
        now = in_order(damaged_rows(conv_id, own))
        kinds, numbers = faults(now), [r[0] for r in now if r[0] is not None]
        cost, audit, made = cheapest(now)
        out[conv_id] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return out


def conversation(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Fine.", "Well!", "Cut off", "Why?", " \t", "", None, "Done. ", "a\nb.", "Ünï 😀."]
    out = []
    for i in range(n):
        role = rng.choice(roles) if rng.random() < 0.3 else ["user", "assistant"][i % 2]
        text = rng.choice(texts) if rng.random() < 0.4 else f"Turn {i} says {rng.random()}{rng.choice(['.', '', '?'])}"
        out.append((None if rng.random() < 0.04 else i + (i > 5) * 2 - rng.randint(0, 1), role, text))
    return out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    out = [(c, *r) for c in [*range(60), 100, 101, 163, -7] for r in conversation(rng, rng.choice([1, 2, 3, 5, 8, 13]))]
    out += [(300, i, ["user", "assistant"][i % 2 if i % 7 else 0], f"{i % 90}." if i % 11 else f"{i}") for i in range(1300)]  # more than a segment
    out += [(301, 5, "user", "Same.")] * 700  # one turn again and again
    out += [(None, 0, "user", "No id."), (None, None, "assistant", "No turn."), (None, None, None, None), (302, None, "assistant", None)]
    return out + out[:3]


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, TURNS).repartition(n)


def saved(spark, tmp_path_factory, rows):
    folder = str(tmp_path_factory.mktemp("conversations"))
    clash = F.lit("x")
    frame(spark, rows).withColumn("Audit", clash).withColumn("place", clash).withColumn("sym", clash).write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_repair_equals_dynamic_programming(spark, turns, tmp_path_factory):
    rows = queries.op11_conversation_repair(spark, saved(spark, tmp_path_factory, turns)).collect()
    assert [*rows[0].asDict()] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert len(rows) == len(got) and got == expected(turns)


def test_repair_of_no_rows_and_of_none_left(spark, tmp_path_factory):
    assert queries.op11_conversation_repair(spark, saved(spark, tmp_path_factory, [])).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = queries.op11_conversation_repair(spark, saved(spark, tmp_path_factory, [(gone, 0, "user", "x.")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_search_equals_all_edits():
    rng = random.Random(5)
    for n in range(4):
        for _ in range(40 if n else 1):
            rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", "c."])) for i in range(n)]
            kinds = faults(rows)
            given = [(r[1][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(rows, kinds)]
            found = conversation_repair.search(given, conversation_repair.START, conversation_repair.ENDS, True)
            assert min(found.values()) == every_edit(rows, 2) == cheapest(rows)[:2]


def test_segments_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(150):
        given = [(rng.choice("uuaasx"), rng.random() < 0.15, False) for _ in range(rng.randint(0, 12))]
        given = [(a, b, not b and rng.random() < 0.3) for a, b, _ in given]
        cuts = [0, *sorted(rng.sample(range(len(given) + 1), min(2, len(given)))), len(given)]
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            parts.append([(s, e, *w) for s in range(4) for e, w in conversation_repair.search(given[a:b], s, (0, 1, 2, 3), False).items()])
        whole = conversation_repair.search(given, conversation_repair.START, conversation_repair.ENDS, True)
        assert conversation_repair.joined(iter(parts)) == min(whole.values())


def test_repaired_turns_are_well_formed(spark, turns):
    found = common.cut(conversation_repair.audits(frame(spark, turns)))
    rows = conversation_repair.repair(frame(spark, turns), found).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append(r)
    for own in by.values():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in own))


def tries(rows):
    """The trie's nodes by brute force: every prefix of every rebuilt conversation."""
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + x[h:])
    members = collections.defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        kids = children[p]
        below[p] = (sum(below[k][0] for k in kids) or 1, own_saved + sum(below[k][1] for k in kids))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def few_turns(rng, n):
    """Conversations over few distinct turns, so that they share beginnings of any length, whole others as well."""
    out = []
    for c in range(n):
        start = rng.choice([0, 0, 0, 1, 2])
        out += [(c, None if i == 0 and rng.random() < 0.1 else i, ["user", "assistant"][i % 2], rng.choice(["a", "b", "ccc", None]) if i >= start else "x" * (i + 1)) for i in range(rng.choice([1, 2, 3, 6, 9]))]
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_trie_equals_all_prefixes(spark, turns, tmp_path_factory, parts):
    rng = random.Random(parts)
    rows = few_turns(rng, 230) + [(1000 + c, i, "user", "same" * 2) for c in range(120) for i in range(70)] + ([r for r in turns if r[0] not in (300, 301)] if parts == 7 else [])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.op12_prefix_trie(spark, saved(spark, tmp_path_factory, rows))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == tries(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_none_and_of_the_turnless(spark, tmp_path_factory):
    assert queries.op12_prefix_trie(spark, saved(spark, tmp_path_factory, [])).count() == 0
    assert queries.op12_prefix_trie(spark, saved(spark, tmp_path_factory, [(None, 1, "user", "x")])).count() == 0
    h5 = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5][:3]  # their base is absent, so nothing is left
    rows = [(c, 0, "user", "x") for c in h5]
    got = sorted(map(tuple, queries.op12_prefix_trie(spark, saved(spark, tmp_path_factory, rows)).collect()))
    assert got == tries(rows) and len(got) == 1 and got[0][3] == 3
