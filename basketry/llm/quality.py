"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides.

Each rule looks at one statistic of a text and votes 1 (clean), -1 (junk) or 0 (abstains). Texts with equal votes are
one pattern; patterns are counted before any shuffle and there are at most 3 ** rules of them, however many texts
there are. The model has a share of clean texts and, per rule and class, the chance that a rule that votes at all votes junk, independent
within a class; abstaining says nothing. Rules are taken to be no worse than chance, so the classes can't change places, and a few
imagined votes keep every chance inside (0, 1). Every expectation-maximisation step is one aggregation over the pattern table. The posterior
chance that a text is clean is then a native expression over its votes. The model is fitted on the texts that pass the base rules.

Texts that fail the fixed base rules are out whatever the posterior is.

Defined results: null and blank texts have no words and fail; repeated rows are judged each; other columns, also ones
whose names clash with ours, pass through `filter_clean`; an empty table gives an empty result and the starting model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 3
#: Bits of a packed hash-and-position that hold the position: as many as an array can have.
PLACE = 31
ROUNDS = 20
THRESHOLD = 0.5
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
NO_LETTERS = "".join(map(chr, range(32, 65))) + "\t\n\x0b\f\r[\\]^_`{|}~"
HAS_LETTER = "[A-Za-z\\x{80}-\\x{10FFFF}]"
STOPS = ".!?…。！？:;\"')»”"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the struct `stat`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what rules need besides.

    Words of repeated windows: the top bits of the windows' hashes are packed with their places into longs and sorted; a window is repeated
    if its neighbour has the same hash (compared in full). In a text where different hashes share their top bits, whose places may
    lie between each other's, (hash, place) are sorted in full instead. The places are sorted again and each covers the words up
    to the next one, at most the window's length.
    """
    kept = docs.columns if keep is None else keep
    ws, hs, packed, whole, places, t, ls = common.scratch(docs, "q_words", "q_hashes", "q_packed", "q_whole", "q_places", "q_text", "q_lines")
    rows = docs.select(*(docs[c] for c in kept), common.text_or_empty(docs[text]).alias(t))
    rows = rows.withColumn(ws, common.words(F.col(t)))
    n = F.size(ws)
    window = lambda i: F.xxhash64(*(F.get(F.col(ws), i + k) for k in range(WINDOW)))
    rows = rows.withColumn(hs, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<long>")))
    mask = (1 << PLACE) - 1
    pack = lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    rows = rows.withColumn(packed, F.sort_array(F.transform(hs, pack)))

    at = lambda i: F.get(F.col(packed), i)
    alike = lambda x, y: (x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0)
    same = lambda x, y: F.coalesce(alike(x, y) & (F.get(F.col(hs), place(x)) == F.get(F.col(hs), place(y))), F.lit(False))
    mixed = F.size(F.filter(packed, lambda x, i: F.coalesce(alike(x, at(i + 1)) & (F.get(F.col(hs), place(x)) != F.get(F.col(hs), place(at(i + 1)))), F.lit(False)))) > 0
    repeated = F.transform(F.filter(packed, lambda x, i: same(x, at(i - 1)) | same(x, at(i + 1))), place)
    full = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(whole, F.when(mixed, full))
    equal = lambda x, i: F.coalesce(F.get(F.col(whole), i)["h"] == x["h"], F.lit(False))
    exact = F.transform(F.filter(whole, lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x["i"])
    rows = rows.withColumn(places, F.sort_array(F.when(F.col(whole).isNotNull(), exact).otherwise(repeated)))
    covered = F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(places), i + 1), p + WINDOW) - p)), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn(ls, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(common.GAP_CHARS)) != ""))
    length, bare = F.char_length(t), F.regexp_replace(t, common.GAP, "")
    stat = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
        F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
        F.char_length(F.translate(t, NO_LETTERS, "")).cast("long").alias("n_letters"),
        F.size(F.filter(ws, lambda w: w.rlike(HAS_LETTER))).cast("long").alias("n_letter_words"),
        F.size(F.filter(ls, lambda x: F.instr(F.lit(STOPS), F.right(F.rtrim(x), F.lit(1))) > 0)).cast("long").alias("n_stop_lines"),
    )
    return rows.select(*(rows[c] for c in kept), stat.alias(common.scratch(docs, "stat")[0]))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)


def rules(s: Column) -> list[Column]:
    """One vote a rule: 1, -1 or 0."""
    per = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))

    def between(x: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    symbol, lines, repeat = per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words")
    letters, spoken, stops = per("n_letters", "word_chars"), per("n_letter_words", "n_words"), per("n_stop_lines", "n_lines")
    mean, kinds = per("word_chars", "n_words"), per("n_distinct", "n_words") * F.sqrt(s["n_words"].cast("double"))
    return [
        between(symbol, symbol <= 0.02, symbol > 0.1),
        between(letters, letters > 0.85, letters < 0.75),
        between(spoken, spoken > 0.9, spoken < 0.8),
        between(lines, lines <= 0.05, lines > 0.3),
        between(repeat, repeat <= 0.1, repeat > 0.3),
        between(mean, (mean >= 3.5) & (mean <= 7), (mean < 3) | (mean > 10)),
        between(kinds, kinds >= 5, kinds < 2.5),
        between(stops, stops >= 0.8, stops < 0.1),
    ]


class Model:
    """Share of clean texts, and per rule the chance of a junk vote, if it votes, on clean and on junk texts."""

    #: Where the fit starts: share of clean texts, chances of a junk vote on clean and junk texts; and imagined votes that hold it there.
    CLEAN, FALSE, TRUE, HELD = 0.9, 0.02, 0.5, 20

    def __init__(self, count: int):
        self.clean = self.CLEAN
        self.false, self.true = [self.FALSE] * count, [self.TRUE] * count

    def posterior(self, votes: Column) -> Column:
        """1 / (1 + exp(-odds)), the odds being a sum over rules."""
        odds = F.lit(math.log(self.clean) - math.log(1 - self.clean))
        for i, (f, t) in enumerate(zip(self.false, self.true)):
            odds = odds + F.when(votes[i] == -1, math.log(f) - math.log(t)).when(votes[i] == 1, math.log(1 - f) - math.log(1 - t)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: DataFrame, count: int, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over (votes, n)."""
    model = Model(count)
    patterns = common.cut(patterns)
    for _ in range(rounds):
        rows = patterns.withColumn("clean", model.posterior(F.col("votes"))).withColumn("n", F.col("n").cast("double"))
        good, bad = F.col("n") * F.col("clean"), F.col("n") * (1 - F.col("clean"))
        sums = [F.sum("n").alias("total"), F.sum(good).alias("clean")]
        for i in range(count):
            vote = F.col("votes")[i]
            sums += [F.sum(F.when(when, part).otherwise(0.0)).alias(f"{name}{i}") for name, when, part in (("gn", vote == -1, good), ("gv", vote != 0, good), ("bn", vote == -1, bad), ("bv", vote != 0, bad))]
        got = rows.agg(*sums).first()
        if not got["total"]:
            break
        before, held = model.clean, Model.HELD
        model.clean = (got["clean"] + 10 * Model.CLEAN) / (got["total"] + 10)
        model.false = [(got[f"gn{i}"] + Model.FALSE * held) / (got[f"gv{i}"] + held) for i in range(count)]
        model.true = [max(f, (got[f"bn{i}"] + Model.TRUE * held) / (got[f"bv{i}"] + held)) for i, f in enumerate(model.false)]
        if abs(model.clean - before) < 1e-7:
            break
    return model


def judged(stats: DataFrame, threshold: float = THRESHOLD, stat: str = "stat") -> DataFrame:
    """Adds posterior, base_failed and kept to rows that have the struct `stat`; these are stored rows, as `cut_statistics` gives them, else every use of a statistic computes it anew."""
    votes, p, failed, kept = common.scratch(stats, "votes", "posterior", "base_failed", "kept")
    rows = stats.withColumn(votes, F.array(*rules(F.col(stat))))
    patterns = rows.where(~base_failed(F.col(stat))).groupBy(F.col(votes).alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    model = fit(patterns, len(rules(F.col(stat))))
    rows = rows.withColumn(p, model.posterior(F.col(votes))).withColumn(failed, base_failed(F.col(stat)))
    return rows.withColumn(kept, ~F.col(failed) & (F.col(p) >= threshold)).drop(votes)


def cut_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and the statistics, stored in the shared folder; texts are read once."""
    return common.cut(statistics(docs, keep=keep))


def filter_clean(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept; texts are read once and stored with their statistics in between."""
    stat = common.scratch(docs, "stat")[0]
    rows = judged(cut_statistics(docs, docs.columns), threshold, stat)
    return rows.where(rows[rows.columns[-1]]).select(*docs.columns)
