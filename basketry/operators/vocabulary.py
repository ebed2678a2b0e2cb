"""What texts say in the terms of a vocabulary table: spans of terms, profiles, constraints, other ways to say it, and whether a product may stand for a query.

The vocabulary is a table (term, mode, kind, attribute, value, priority, implies_attribute, implies_value). mode is token, phrase, alias or exact (the whole text is the term); kind
is attribute, concept, penalty, alias or stopword. Terms are matched word by word. Up to MOST_TERMS terms go to all tasks as one Aho-Corasick automaton over word ids, which
reads a text once, however many terms there are; a larger vocabulary meets the runs of words of the texts in an equi join. Both give the same spans.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import text as tx

TERM = ["term", "mode", "kind", "attribute", "value", "priority", "implies_attribute", "implies_value"]
SPAN = "array<struct<term:string,kind:string,attribute:string,value:string,implies_attribute:string,implies_value:string,start:int,end:int>>"
#: A vocabulary of more terms isn't sent to tasks.
MOST_TERMS = 200_000


class Automaton:
    """Aho-Corasick over word ids: steps of the trie, the longest proper suffix of each node that is a node, and the terms that end there."""

    def __init__(self, terms: list[tuple[list[str], int]]):
        self.ids: dict[str, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for words, term in terms:
            node = 0
            for w in words:
                nxt = self.steps[node].setdefault(self.ids.setdefault(w, len(self.ids)), len(self.steps))
                if nxt == len(self.steps):
                    self.steps.append({})
                    self.ends.append([])
                node = nxt
            self.ends[node].append((len(words), term))
        self.back = [0] * len(self.steps)
        queue = deque(self.steps[0].values())
        while queue:
            node = queue.popleft()
            for w, child in self.steps[node].items():
                self.back[child] = self._step(self.back[node], w)
                queue.append(child)
            self.ends[node] = self.ends[node] + self.ends[self.back[node]]  # the suffix is less deep, so its list is complete

    def _step(self, node: int, word: int) -> int:
        while word not in self.steps[node] and node:
            node = self.back[node]
        return self.steps[node].get(word, 0)

    def found(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(start, end, term) of every term in words."""
        node = 0
        for at, w in enumerate(words):
            node = self._step(node, self.ids.get(w, -1))
            for length, term in self.ends[node]:
                yield at + 1 - length, at + 1, term


def _chosen(hits: list[tuple[int, int, int]], rank: list[tuple]) -> list[tuple[int, int, int]]:
    """Hits of which none partly overlaps a better one: by priority, then words, then letters, then place. Terms may share one span."""
    taken: list[tuple[int, int]] = []
    for start, end, term in sorted(hits, key=lambda h: (rank[h[2]][0], h[0] - h[1], rank[h[2]][1], h[0], rank[h[2]][2:])):
        if all((start, end) == s or end <= s[0] or s[1] <= start for s in taken):
            taken.append((start, end))
            yield start, end, term


def _words_of(vocabulary: DataFrame) -> DataFrame:
    """Terms that can be matched, with their words and their text in normal form."""
    rows = vocabulary.where("kind <> 'stopword'").select(*TERM, tx.tokens(F.col("term")).alias("words"))
    return rows.where(F.size("words") > 0).withColumn("surface", F.concat_ws(" ", "words")).withColumn("priority", F.coalesce("priority", F.lit(0)))


def spans(texts: DataFrame, vocabulary: DataFrame, text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """texts with `spans`: the terms found in each text that don't partly overlap better ones, in order."""
    terms = _words_of(vocabulary)
    rows = terms.limit(most_terms + 1).collect()
    if len(rows) > most_terms:
        return _spans_by_join(texts, terms, text)
    rank = [(-r["priority"], -len(r["surface"]), r["surface"], r["kind"], r["attribute"] or "", r["value"] or "") for r in rows]
    told = [(r["term"], r["kind"], r["attribute"], r["value"], r["implies_attribute"], r["implies_value"]) for r in rows]
    exact: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        if r["mode"] == "exact":
            exact.setdefault(r["surface"], []).append(i)
    shared = texts.sparkSession.sparkContext.broadcast((Automaton([(r["words"], i) for i, r in enumerate(rows) if r["mode"] != "exact"]), exact, rank, told))

    @F.pandas_udf(SPAN)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, whole, order, fields = shared.value
        for batch in batches:
            out = []
            for words in batch:
                words = [] if words is None else list(words)
                hits = [*automaton.found(words), *((0, len(words), t) for t in whole.get(" ".join(words), ()))]
                best = sorted(_chosen(hits, order), key=lambda h: (h[0], -h[1], order[h[2]]))
                out.append([(*fields[t], a, b) for a, b, t in best])
            yield pd.Series(out)

    return texts.withColumn("spans", found(tx.tokens(F.col(text))))


def _spans_by_join(texts: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """The same for a vocabulary of any size: runs of words as long as some term meet the terms in an equi join; one text's hits are put together and chosen in its row."""
    lengths = [r[0] for r in terms.where("mode <> 'exact'").select(F.size("words")).distinct().collect()]  # the lengths of terms, not the terms
    words = tx.tokens(F.col(text))
    named = texts.select(F.col(text).alias("whole")).distinct().withColumn("w", words if text == "whole" else tx.tokens(F.col("whole")))
    at = F.explode(F.sequence(F.lit(0), F.size("w")))
    runs = named.select("whole", "w", at.alias("at")).select("whole", "w", "at", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where(F.col("at") + F.col("n") <= F.size("w"))
    runs = runs.select("whole", F.col("at").alias("start"), (F.col("at") + F.col("n")).cast("int").alias("end"), F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("n"))).alias("surface"))
    hits = runs.join(terms.where("mode <> 'exact'"), "surface")
    whole = named.select("whole", F.lit(0).alias("start"), F.size("w").alias("end"), F.concat_ws(" ", "w").alias("surface")).join(terms.where("mode = 'exact'"), "surface")
    both = hits.unionByName(whole)
    order = F.struct(-F.col("priority"), F.col("start") - F.col("end"), -F.char_length("surface"), "start", "surface", "kind", F.coalesce("attribute", F.lit("")), F.coalesce("value", F.lit("")))
    fields = F.struct("term", "kind", "attribute", "value", "implies_attribute", "implies_value", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    shown = F.struct("start", -F.col("end"), -F.col("priority"), -F.char_length("surface"), "surface", "kind", F.coalesce("attribute", F.lit("")), F.coalesce("value", F.lit("")))
    lists = both.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), shown.alias("p"), fields.alias("f")))).alias("all"))

    def apart(x: Column, taken: Column) -> Column:
        return F.forall(taken, lambda s: ((s["f"]["start"] == x["f"]["start"]) & (s["f"]["end"] == x["f"]["end"])) | (x["f"]["end"] <= s["f"]["start"]) | (s["f"]["end"] <= x["f"]["start"]))

    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda taken, x: F.when(apart(x, taken), F.concat(taken, F.array(x))).otherwise(taken))
    in_order = F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(x["p"].alias("p"), x["f"].alias("f")))), lambda x: x["f"])
    lists = lists.select(F.col("whole").alias("whole_"), in_order.alias("spans"))
    rows = texts.join(lists, F.col(text) == F.col("whole_"), "left").drop("whole_")
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def _first_wins(entries: Column, start: Column) -> Column:
    """A map of (key, value) entries, where the first of a key counts."""
    return F.aggregate(entries, start, lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))


def profile(found: Column) -> Column:
    """struct(attributes, concepts, penalties) of spans: the first span of an attribute counts, what terms imply fills what is left."""
    none = F.create_map().cast("map<string,string>")
    said = F.filter(found, lambda s: (s["kind"] == "attribute") & s["attribute"].isNotNull() & s["value"].isNotNull())
    direct = _first_wins(F.transform(said, lambda s: F.struct(s["attribute"].alias("k"), s["value"].alias("v"))), none)
    implied = F.filter(found, lambda s: s["implies_attribute"].isNotNull() & s["implies_value"].isNotNull())
    attributes = _first_wins(F.transform(implied, lambda s: F.struct(s["implies_attribute"].alias("k"), s["implies_value"].alias("v"))), direct)
    concepts = F.transform(F.filter(found, lambda s: (s["kind"] == "concept") & s["value"].isNotNull()), lambda s: s["value"])
    penalties = F.transform(F.filter(found, lambda s: (s["kind"] == "penalty") & s["value"].isNotNull()), lambda s: F.concat(s["attribute"], F.lit(":"), s["value"]))
    return F.struct(attributes.alias("attributes"), F.array_sort(F.array_distinct(concepts)).alias("concepts"), F.array_sort(F.array_distinct(penalties)).alias("penalties"))


def constraints(found: Column, strengths: dict[str, str], other: str = "ranking") -> Column:
    """What a query asks for: array of (attribute, value, strength, source), by attribute. source is implied where no span says the value outright."""
    known = F.create_map(*(F.lit(x) for kv in strengths.items() for x in kv)) if strengths else F.create_map().cast("map<string,string>")

    def one(e: Column) -> Column:
        outright = F.exists(found, lambda s: (s["kind"] == "attribute") & (s["attribute"] == e["key"]) & (s["value"] == e["value"]) & s["implies_attribute"].isNull())
        hinted = F.exists(found, lambda s: (s["kind"] == "attribute") & (s["implies_attribute"] == e["key"]) & (s["implies_value"] == e["value"]))
        source = F.when(F.coalesce(hinted, F.lit(False)) & ~F.coalesce(outright, F.lit(False)), "implied").otherwise("explicit")
        return F.struct(e["key"].alias("attribute"), e["value"].alias("value"), F.when(source == "implied", F.lit(other)).otherwise(F.coalesce(F.try_element_at(known, e["key"]), F.lit(other))).alias("strength"), source.alias("source"))

    return F.transform(F.array_sort(F.map_entries(profile(found)["attributes"])), one)


def expansions(texts: DataFrame, vocabulary: DataFrame, text: str = "text", limit: int = 4) -> DataFrame:
    """texts with `said`: the text, then what an alias that is the whole text stands for, then that one's other aliases by name; `limit` in all."""
    rows = texts.withColumn("surface", F.concat_ws(" ", tx.tokens(F.col(text))))
    aliases = vocabulary.where("kind = 'alias' AND value IS NOT NULL").select(F.concat_ws(" ", tx.tokens(F.col("term"))).alias("surface"), "term", "value")
    meant = aliases.select("surface", "value").distinct()
    siblings = aliases.groupBy("value").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    ways = meant.join(siblings, "value").groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("value", "terms"))).alias("ways"))
    rows = rows.join(ways, "surface", "left").drop("surface")
    more = F.flatten(F.transform(F.coalesce("ways", F.array().cast("array<struct<value:string,terms:array<string>>>")), lambda w: F.concat(F.array(w["value"]), w["terms"])))
    said = F.filter(F.array_distinct(F.concat(F.array(F.trim(F.col(text))), more)), lambda x: x.isNotNull() & (x != ""))
    return rows.withColumn("said", F.slice(said, 1, limit)).drop("ways")


def gate(asked: Column, own_penalties: Column, product: Column, relaxed_pairs: list[tuple[str, str, str]] = (), missing: dict[str, str] | None = None, soft: tuple[str, ...] = (), shared: Column | None = None, nearby: tuple[str, ...] = ()) -> Column:
    """struct(allowed, tier, conflicts, relaxed, penalty) of a product's profile against a query's constraints.

    An attribute with another value is a conflict if the constraint is hard and explicit, unless the pair (attribute, asked, got) is relaxed or the attribute is `soft`;
    `missing` says by attribute what a missing value is: allow (if unsaid), relax or reject. Penalties the query has itself don't count. Tier 0: conflicts; 2: something was
    relaxed; 3: nothing is shared and a `nearby` attribute was asked; 1: all agrees.
    """
    pairs = F.array(*(F.lit(f"{a}:{v}_{g}") for a, v, g in relaxed_pairs)) if relaxed_pairs else F.array().cast("array<string>")
    lacking = F.create_map(*(F.lit(x) for kv in (missing or {}).items() for x in kv)) if missing else F.create_map().cast("map<string,string>")
    easy, close = F.array(*map(F.lit, soft)).cast("array<string>"), F.array(*map(F.lit, nearby)).cast("array<string>")

    def verdict(c: Column) -> Column:
        got, name = F.try_element_at(product["attributes"], c["attribute"]), c["attribute"]
        lacks = F.coalesce(F.try_element_at(lacking, name), F.lit("allow"))
        pair = F.concat(name, F.lit(":"), c["value"], F.lit("_"), got)
        hard, implied = c["strength"] == "hard", c["source"] == "implied"
        nothing = F.lit(None).cast("string")
        conflict = F.when(got.isNull(), F.when(~implied & (lacks == "reject") & hard, F.concat(name, F.lit(":requested_"), c["value"], F.lit("_got_missing")))).when(
            (got != c["value"]) & ~F.array_contains(pairs, pair) & ~F.array_contains(easy, name) & ~implied & hard, F.concat(name, F.lit(":requested_"), c["value"], F.lit("_got_"), got)
        )
        eased = (
            F.when(got.isNull(), F.when(implied | (lacks == "allow"), nothing).when(lacks == "relax", F.concat(name, F.lit(":missing_relaxed"))).when(~hard, F.concat(name, F.lit(":missing"))))
            .when(got == c["value"], nothing)
            .when(F.array_contains(pairs, pair), pair)
            .when(F.array_contains(easy, name), F.concat(name, F.lit(":soft_mismatch")))
            .when(implied, F.concat(name, F.lit(":implied_mismatch")))
            .when(~hard, F.concat(name, F.lit(":soft_mismatch")))
        )
        return F.struct(conflict.alias("conflict"), eased.alias("eased"))

    told = F.transform(asked, verdict)
    conflicts = F.filter(F.transform(told, lambda t: t["conflict"]), lambda x: x.isNotNull())
    eased = F.filter(F.transform(told, lambda t: t["eased"]), lambda x: x.isNotNull())
    unasked = F.array_except(product["penalties"], own_penalties)
    agrees = F.exists(asked, lambda c: F.coalesce(F.try_element_at(product["attributes"], c["attribute"]) == c["value"], F.lit(False)))
    apart = F.lit(False) if shared is None else ~(shared | agrees) & F.exists(asked, lambda c: F.array_contains(close, c["attribute"]))
    tier = F.when(F.size(conflicts) > 0, 0).when(F.size(eased) > 0, 2).when(apart, 3).when(F.size(unasked) > 0, 2).otherwise(1)
    relaxed = F.concat(eased, F.transform(unasked, lambda p: F.concat(F.lit("penalty:"), p)))
    return F.struct((F.size(conflicts) == 0).alias("allowed"), tier.alias("tier"), conflicts.alias("conflicts"), relaxed.alias("relaxed"), F.size(unasked).alias("penalty"))
