"""Personal data: base patterns, and a character tagger that adds what they miss.

Base spans are the leftmost non-overlapping matches of one pattern per kind that pass the kind's check; a match that fails is dropped.
So the base misses a phone number that runs on into an address of four numbers (one failing match), and whatever isn't written its way: addresses
spelled out ("name at mail dot com") or with their points in brackets, phone numbers without a plus, card numbers in other groups,
and secrets behind a name such as token or password, which are a kind of their own.
The tagger, a bidirectional LSTM with CRF transitions, was trained on labelled spans and reads characters in context: it marks where each of
them begins and ends.

Windows of WINDOW characters, half overlapping, cover every stretch with a trigger (a digit, an @, a spelled-out at or dot) and CONTEXT characters around. Windows of a
batch are decoded together; where two windows cover a character, the one whose middle is nearer gives its tag and how sure the model is of it, so each
text has one sequence of tags. Runs of tags become spans if the model is sure of all their characters (SURE), if they aren't part of a longer number or word, if a light
check of their kind holds (how many digits, Luhn's sum, parts up to 255, an at and a dot, letters and digits) and if they don't overlap a base span; base spans always stay.

Training data: windows of a bounded number of rows (those with the least hash of doc_id among rows with a digit or @) labelled by their base spans, except for words with a digit or an @, or about an at
or dot, that the base leaves out (it can't tell a secret from nothing, so those are left open in the loss), and windows made from fixed templates, whose places in the text are known. The model is small, and is sent to the tasks; texts are only mapped over.

Defined results: null is the empty text without spans; spans are in code points, end exclusive; repeated rows are read each; other columns
pass through; columns named like ours are replaced; empty input gives empty output, the model then being made from templates alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tagger import PAD, Tagger, classes

#: The base has the first four kinds, the tagger all.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
#: Tags: 0 outside, 1 + 2 * kind begins a span, 2 + 2 * kind goes on.
TAGS = 1 + 2 * len(KINDS)
WINDOW, CONTEXT = 64, 32
#: Least chance, by the model, of each tag of a span that it adds.
SURE = 0.5
#: Rows whose windows are training data at most, windows of each, windows made from templates, times over all of these.
ROWS, PER_ROW, MADE, EPOCHS = 200, 2, 2_600, 13
#: Windows decoded together.
BATCH = 2_048

# The patterns of the four kinds. Emails are found from their @ on, addresses from their runs of digits and points.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_POINTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What makes a window, and light checks of what the tagger marks.
_DIGIT = re.compile(r"[0-9@]")
_OPEN = re.compile(r"\S*[0-9@]\S*|\S+\s+[\[({<]?(?i:at|dot)[\])}>]?\s+\S+|\S*[\[({](?i:at|dot|\.)[\])}]\S*")
_TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])(?i:dot)(?![A-Za-z])|[\[({](?i:at|dot|\.)[\])}]|(?<![A-Za-z])(?i:at)\x20+[A-Za-z0-9-]+\.[A-Za-z]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[({<]\s*(?:@|(?i:at))\s*[\])}>]|\s(?i:at)\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[({<]\s*(?:\.|(?i:dot))\s*[\])}>]|\s(?i:dot)\s)\s*[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]{1,3}(?:\s*(?:\.|[\[({]\s*(?:\.|(?i:dot))\s*[\])}]|\s(?i:dot)\s)\s*[0-9]{1,3}){3}")
_NUMBER = re.compile(r"[+(]*[0-9][0-9()\s./\u00a0\u2010-\u2015-]*[0-9]")
_OPAQUE = re.compile(r"[A-Za-z0-9_+/=.-]{12,}")

Span = tuple[int, int, int]


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _card(text: str) -> bool:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def _ip(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def _phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start. Time is linear in the text, also for long runs of letters or digits."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                end = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _POINTS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            piece = ".".join(parts[i : i + 4])
            if _ip(piece):
                out.append((1, at, at + len(piece)))
            at += len(piece) + 1
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _card(m[0])]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if _phone(m[0])]
    return out


def _plausible(text: str, start: int, end: int, kind: int) -> bool:
    """Whether a tagged run is a whole thing of its kind, not part of a longer number or word, and looks like one."""
    run, before, after = text[start:end], text[start - 1 : start] if start else "", text[end : end + 1]
    if before.isalnum() or after.isalnum():
        return False
    digits = _digits(run)
    if kind == 0:
        return _EMAIL.fullmatch(run) is not None and before not in _LOCAL and after not in ("@", "-", "_")
    if kind == 1:
        return _IP.fullmatch(run) is not None and all(int(x) <= 255 for x in re.findall("[0-9]+", run)) and re.match(r"\.[0-9]", text[end : end + 2]) is None and before not in ("+", ".")
    if kind == 2:
        return _NUMBER.fullmatch(run) is not None and "+" not in run and _card(run)
    if kind == 3:
        parts = re.findall("[0-9]+", run)
        return _NUMBER.fullmatch(run) is not None and 9 <= len(digits) <= 15 and (len(parts) > 1 or run[0] == "+") and [*map(len, parts)] != [3, 2, 4] and before not in ("+", ".", "-")
    return _OPAQUE.fullmatch(run) is not None and len(digits) >= 2 and any(x.isalpha() for x in run)


def windows(text: str) -> list[int]:
    """Starts of the windows: half overlapping ones over each stretch that has a trigger within CONTEXT characters."""
    out: list[int] = []
    lo = hi = -1
    step = WINDOW // 2

    def over(lo: int, hi: int) -> None:
        at = lo
        while True:
            out.append(at)
            if at + WINDOW >= hi:
                break
            at += step

    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if a > hi:
            if hi >= 0:
                over(lo, hi)
            lo = a
        hi = b
    if hi >= 0:
        over(lo, hi)
    return out


def _filled(codes: np.ndarray, start: int) -> np.ndarray:
    part = codes[start : start + WINDOW]
    return np.concatenate([part, np.full(WINDOW - len(part), PAD, np.int16)]) if len(part) < WINDOW else part


def added_spans(texts: list[str], base: list[list[Span]], model: Tagger) -> list[list[Span]]:
    """What the tagger adds to each text's base spans."""
    starts = [windows(x) for x in texts]
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list[int], np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            parts = [model.decode(x) for x in np.array_split(np.concatenate([w for *_, w in held]), -(-size // BATCH))]
            tags, sure = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            at = 0
            for i, own, _ in held:
                out[i] = _reconciled(texts[i], base[i], own, tags[at : at + len(own)], sure[at : at + len(own)])
                at += len(own)
        held, size = [], 0

    for i, own in enumerate(starts):
        if own:
            codes = classes(texts[i])
            held.append((i, own, np.stack([_filled(codes, s) for s in own])))
            size += len(own)
            if size >= BATCH:
                flush()
    flush()
    return out


def _reconciled(text: str, base: list[Span], starts: list[int], tags: np.ndarray, sure: np.ndarray) -> list[Span]:
    """One tag per character, from the window whose middle is nearest; then checked runs that don't overlap base spans."""
    found: dict[int, tuple[int, float]] = {}
    for row in np.flatnonzero(tags.any(axis=1)).tolist():
        start = starts[row]
        for at in np.flatnonzero(tags[row]).tolist():
            far = abs(2 * at - WINDOW + 1)
            place = start + at
            for other in (row - 1, row + 1):  # only the next windows to either side can cover this place nearer their middle
                if 0 <= other < len(starts) and starts[other] <= place < starts[other] + WINDOW and abs(2 * (place - starts[other]) - WINDOW + 1) < far:
                    break
            else:
                found[place] = (int(tags[row][at]), float(sure[row][at]))
    taken = sorted((a, b) for _, a, b in base)
    out, places = [], sorted(found)
    i = 0
    while i < len(places):
        kind, j = (found[places[i]][0] - 1) // 2, i + 1
        while j < len(places) and places[j] == places[j - 1] + 1 and found[places[j]][0] == 2 + 2 * kind:
            j += 1
        start, end = places[i], places[j - 1] + 1
        begins, certain = found[places[i]][0] % 2 == 1, min(found[x][1] for x in places[i:j]) >= SURE
        if begins and certain and end <= len(text) and _plausible(text, start, end, kind) and not any(a < end and start < b for a, b in taken):
            out.append((kind, start, end))
        i = j
    return out


# Training data.


def _tagged(length: int, spans: list[Span], start: int = 0) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if a < length and b > 0:
            out[max(a, 0) : b] = 2 + 2 * kind
            if a >= 0:
                out[a] = 1 + 2 * kind
    return out


def made(count: int, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Texts from templates with the spans they hold, alone, in rows of several kinds, and among numbers and words that are nothing."""
    rng = random.Random(seed)
    letters, digits, opaque = "abcdefghijklmnopqrstuvwxyzéüñ", "0123456789", "0123456789abcdef"
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: rng.choice(["at", "dot", "the", "a"]) if rng.random() < 0.08 else some(letters, rng.randint(1, 9))
    name, number = lambda: some(letters[:26], rng.randint(2, 9)), lambda n: some(digits, n)

    def either(*makers):
        return rng.choice(makers)()

    def email() -> str:
        local = either(name, lambda: f"{name()}.{name()}", lambda: f"{name()}{rng.choice('._+')}{number(rng.randint(1, 2))}", lambda: f"{number(2)}x")
        host, end = either(name, lambda: f"mail{number(1)}.example", lambda: f"{name()}.example", lambda: f"{name()}-{name()}"), rng.choice(["com", "org", "net", "de", "co"])
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), (" at ", "."), ("[at]", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("@", "[.]"), ("(at)", "."), (" AT ", " DOT "), (" @ ", " . "), (" [AT] ", ".")])
        return local + at + host.replace(".", dot) + dot + end

    def ip() -> str:
        return rng.choice([".", ".", "[.]", "(.)", " . ", " dot ", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def luhn(digits: str) -> int:
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed([*map(int, digits)]))) % 10

    def card(right: bool = True) -> str:
        head = number(rng.choice([15, 15, 15, 15, 14, 12]))
        ends = [str(d) for d in range(10) if (luhn(head + str(d)) == 0) == right]
        whole = head + rng.choice(ends)
        return rng.choice(["", "", " ", "-", ".", "\u00a0"]).join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        plus = lambda: f"+{rng.randint(1, 99)} {rng.choice([f'({a})', a])} {b}-{c}"
        return either(plus, plus, lambda: f"({a}) {b}-{c}", lambda: f"{a}-{b}-{c}", lambda: f"{a}.{b}.{c}", lambda: f"{a} {b} {c}", lambda: f"0{number(2)} {b} {c}", lambda: f"00{rng.randint(1, 99)} {a} {b} {c}", lambda: f"0{number(3)}/{b}{c}", lambda: f"0{number(4)} {number(6)}", lambda: f"00{rng.randint(10, 99)} {a} {number(7)}", lambda: f"({a}) {b} {c}")

    def secret() -> str:
        return either(lambda: some(opaque, rng.choice([32, 40])), lambda: some(letters[:26] + letters[:26].upper() + digits, rng.randint(16, 28)) + number(2), lambda: some(opaque.upper(), 24))

    def decoy() -> str:
        year = f"{rng.choice(['19', '20'])}{number(2)}"
        return either(
            *[lambda n=n: number(n) for n in (1, 2, 4, 6, 8, 10, 12)],
            lambda: card(False), lambda: card(False).replace(" ", ""), lambda: f"{number(1)}.{number(1)}", lambda: f"{number(1)}.{number(2)}.{number(1)}", lambda: some(opaque, 32), lambda: f"{year}-{number(2)}-{number(2)}", lambda: f"{number(2)}/{number(2)}/{year}",
            lambda: f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: f"{number(1)},{number(3)},{number(3)}.{number(2)}", lambda: f"({year})", lambda: f"@{name()}", lambda: f"{year}-{year}", lambda: f"{number(2)}:{number(2)}:{number(2)}",
            lambda: f"at {name()} . {name()}", lambda: f"the dot {name()} at {name()}", lambda: f"{name()} at {name()}", lambda: f"{name()} at the dot", lambda: f"§ {number(3)} {number(2)}", lambda: f"{rng.randint(256, 999)}.{number(3)}.{number(3)}.{number(3)}", lambda: f"{number(3)}.{number(3)}.{number(3)}",
        )

    kinds = (email, ip, card, phone, secret)
    leads = ("", "", "", "", "call ", "Tel: ", "mail ", "IP ", "from ", "(")
    holds = ("token", "api_key", "password", "secret", "TOKEN", "key", "Authorization", "access_token")
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.choice([1, 2, 2, 3])):
            text += rng.choice([" ", " ", " ", " ", "\n", ", "]) if text else ""
            k = rng.choice((0, 0, 1, 1, 2, 3, 3, 4, 5, 5, 5))
            if k == SECRET:
                quote = rng.choice(['"', '"', "'", ""])
                text += rng.choice(holds) + rng.choice([" = ", "=", ": ", ":"]) + quote
                value = secret()
                spans.append((k, len(text), len(text) + len(value)))
                text += value + quote
            elif k < 5:
                text += rng.choice(leads)
                value = kinds[k]()
                spans.append((k, len(text), len(text) + len(value)))
                text += value + rng.choice(["", "", "", ".", ",", "!!", "***", f":{number(2)}" if k == 1 and value.count(" ") == 0 else ""])
            else:
                text += decoy() + rng.choice(["", "", ".", ",", "!!", "###"])
        out.append((text + " " + " ".join(word() for _ in range(rng.randint(0, 4))), spans))
    return out


def unjudged(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an @, or about a spelled-out at or dot, that no base span touches: the base not finding them doesn't make them nothing, so they are no training data."""
    base = [(a, b) for _, a, b in base_spans(text)]
    return [m.span() for m in _OPEN.finditer(text) if not any(a < m.end() and m.start() < b for a, b in base)]


def labelled(docs: DataFrame, rows: int = ROWS) -> list[tuple[str, list[Span], list[Span]]]:
    """Stretches of a bounded number of rows with their base spans, and where the base can't say what is there."""
    chosen = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", F.lit("tagger")).alias("h"), "doc_id", "text")

    @F.pandas_udf("array<string>")
    def stretches(texts: pd.Series) -> pd.Series:
        return pd.Series([[x[s : s + WINDOW] for s in windows(x)[:PER_ROW]] for x in texts], dtype=object)

    # The rows are chosen by (hash, doc_id) before any text is moved, so ties and reruns agree and the driver gets rows * PER_ROW windows at most.
    near = chosen.select("h", "doc_id").orderBy("h", "doc_id").limit(rows).agg(F.max("h")).first()[0]
    if near is None:
        return []
    got = chosen.where(F.col("h") <= near).select("h", stretches("text").alias("parts")).orderBy("h", "parts").limit(rows).collect()
    return [(x, base_spans(x), unjudged(x)) for row in got for x in row["parts"]]


def train(texts: list[tuple], epochs: int = EPOCHS) -> Tagger:
    """The model of texts (text, spans) or (text, spans, where nothing is known)."""
    cut = [(classes(t), spans, open_[0] if open_ else [], s) for t, spans, *open_ in texts for s in (windows(t) or [0])]
    x = np.stack([_filled(codes, s) for codes, _, _, s in cut])
    y = np.stack([_tagged(WINDOW, spans, s) for _, spans, _, s in cut])
    known = np.ones(x.shape, bool)
    for row, (_, _, open_, s) in zip(known, cut):
        for a, b in open_:
            row[max(a - s, 0) : max(b - s, 0)] = False
    y[x == PAD], known[x == PAD] = 0, True
    model = Tagger(TAGS)
    model.train(x, y, epochs, known=known)
    return model


def fitted(docs: DataFrame, rows: int = ROWS, count: int = MADE, epochs: int = EPOCHS) -> Tagger:
    return train(labelled(docs, rows) + made(count), epochs)


# Application.


def finder(model: Tagger):
    """Spans of each text as an array of (kind, start, end, base)."""

    @F.pandas_udf("array<struct<kind:int,start:int,end:int,base:boolean>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            plain = [x or "" for x in texts]
            base = [base_spans(x) for x in plain]
            more = added_spans(plain, base, model)
            yield pd.Series([[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in sorted([*((*s, True) for s in x), *((*s, False) for s in y)])] for x, y in zip(base, more)], dtype=object)

    return spans


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """docs with `found`: spans ordered by kind and start."""
    kept = [c for c in docs.columns if c.lower() != "found"]
    return docs.select(*kept, finder(model)(common.text_or_empty("text")).alias("found"))


def masker(model: Tagger):
    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            plain = [x or "" for x in texts]
            base = [base_spans(x) for x in plain]
            more = added_spans(plain, base, model)
            yield pd.Series([None if whole is None else _masked(x, [*b, *m]) for whole, x, b, m in zip(texts, plain, base, more)], dtype=object)

    return masked


def _masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans of two kinds that overlap are one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, -b, k) for k, a, b in spans):
        end = -end
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger) -> DataFrame:
    """docs with the personal data in text replaced; n_chars, if there, follows."""
    out = docs.withColumn("text", masker(model)(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
