"""A word-level BPE vocabulary as plain tables, its pre-tokenisation, and rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import regex

# Fixed values of the vocabulary's file format: the byte-level alphabet's printable ranges, the word-end mark.
PRINTABLE = ((33, 126), (161, 172), (174, 255))
WORD_END = "</w>"
#: Chunks whose tokens a task remembers at most; beyond it starts again, so memory stays bounded.
REMEMBER = 300_000

#: What Python splits at though it is no white space.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
_CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def chunks(text: str) -> list[str]:
    """The pieces of a text between white space, as Unicode defines it."""
    return _CHUNK.findall(text) if any(x in text for x in ODD_SPACE) else text.split()


class Vocabulary:
    """The tables of one vocabulary file: symbols of bytes, mergeable pairs sorted by key, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces = np.array([None] * (1 + max([*ids.values(), *self.special.values()])), dtype=object)
        for piece, i in [*ids.items(), *self.special.items()]:
            self.pieces[i] = piece
        self.size = len(self.pieces)
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        letters = byte_alphabet()
        self.inner = np.array([ids[x] for x in letters], dtype=np.int64)
        self.last = np.array([ids[x + WORD_END] for x in letters], dtype=np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self._split = regex.compile(pattern)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def parts(self, text: str):
        """Yields (stretch of ordinary text, id of the special string that ends it or None)."""
        at = 0
        if self._special is not None:
            for m in self._special.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk: composed, lower-cased letter by letter, split by the file's pattern."""
        return self._split.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of every word, flat, and how many each has.

        All words are worked on at once: in each round every word applies its own lowest-ranked pair wherever it occurs,
        left to right without overlap; words that have none left leave the arrays.
        """
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat, ends = self.inner[raw], np.cumsum(lengths)
        flat[ends[lengths > 0] - 1] = self.last[raw[ends[lengths > 0] - 1]]
        owner = np.repeat(np.arange(n), lengths)
        done_flat, done_owner = [], []
        big = np.iinfo(np.int64).max
        while len(flat):
            key = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((owner[:-1] == owner[1:]) & (self.keys[at] == key), self.ranks[at], big)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, big], first)
            sizes = np.diff(np.r_[first, len(flat)])
            low = np.repeat(best, sizes)
            over = low == big
            if over.any():
                done_flat.append(flat[over])
                done_owner.append(owner[over])
            chosen = np.flatnonzero((rank == low[:-1]) & (rank < big))
            if len(chosen):
                fresh = np.r_[True, np.diff(chosen) != 1]
                run = chosen[np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))]
                chosen = chosen[(chosen - run) % 2 == 0]
                flat[chosen] = self.made[at[chosen]]
            keep = ~over
            keep[chosen + 1] = False
            flat, owner = flat[keep], owner[keep]
        if not done_flat:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        flat, owner = np.concatenate(done_flat), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=n)

    def count_chunks(self, fresh: list[str]) -> list[int]:
        """Tokens of each chunk."""
        split = [self.words(x) for x in fresh]
        counts = self.merge([w.encode() for x in split for w in x])[1]
        ends = np.cumsum([0, *map(len, split)])
        total = np.r_[0, np.cumsum(counts)]
        return (total[ends[1:]] - total[ends[:-1]]).tolist()

    def encode_chunks(self, fresh: list[str]) -> list[np.ndarray]:
        """The ids of each chunk, in order, special strings included."""
        split = [[(self.words(part), special) for part, special in self.parts(x)] for x in fresh]
        flat, counts = self.merge([w.encode() for x in split for ws, _ in x for w in ws])
        ends, at, out = np.r_[0, np.cumsum(counts)], 0, []
        for x in split:
            ids = []
            for ws, special in x:
                ids.append(flat[ends[at] : ends[at + len(ws)]])
                at += len(ws)
                if special is not None:
                    ids.append(np.array([special], np.int64))
            out.append(np.concatenate(ids))
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
