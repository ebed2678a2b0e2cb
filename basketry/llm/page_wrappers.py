"""Main text of web pages through wrappers inferred per host.

A page is a stream of tokens: tags, and texts marked by where they stand (in an article, in page furniture, in a link, elsewhere).
A wrapper is a union-free regular expression over such tokens: tags, text slots, optional groups and repeated groups.
Every page folds into a wrapper of its own (neighbouring equal runs become one repeated group). Wrappers of one host are
aligned one by one: tags that agree are matched; a text that differs becomes a slot; what only one side has becomes an optional
group, or one more turn of a repeated group. The host's wrapper then says which slots differ from page to page. A page is judged by
the slots it passes: of its articles and of what stands outside furniture and links, the slots that differ are main text and the steady ones are the template's,
in an article too, each by its own slot. Links and steady words that stand in one block with main text go with it. A page where nothing of this differs keeps its articles.

Pages of one shape are joined inside each task first. Shapes then meet by (host, part of the shape's hash) and last by host, so a host with a
third of all pages costs no more than its count of shapes, and its wrapper doesn't depend on which rows lie in which task. The wrappers go
back to the pages by a join on the host, where adaptive execution splits a hot one.

Defined results: null or empty html has the empty text; a page whose url has no host belongs to the host ""; repeated rows are
extracted each; other columns pass through; columns named text and n_chars are replaced; empty input gives empty output.
A page that its wrapper doesn't match is judged by its own token marks alone. Copies of a page's texts count once for what is steady.
"""

from __future__ import annotations

import difflib
import functools
import html as references
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Element names and the words that mark page furniture in class, id and role attributes.
RAW = ("script", "style", "title", "textarea", "iframe")
QUIET = ("noscript", "template", "svg", "select", "button", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br".split())
FURNITURE = frozenset("head nav header footer aside form menu dialog figure-nav".split())
ARTICLE = frozenset(("article", "main"))
CONTAINERS = frozenset("html head body nav header footer aside form menu dialog article main section div ul ol dl table details".split())
BAD_NAMES = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice gdpr popup modal newsletter subscribe signup sidebar side related recommended share sharing social comment comments replies reply respond disqus breadcrumb breadcrumbs menu nav navbar navigation header footer masthead pagination pager toolbar widget navigation search login hidden".split())
NEUTRAL_NAMES = frozenset("list box bar block section area wrap wrapper container inner outer slot unit panel links posts buttons site page top bottom left right item items icon icons label group row col".split())
GOOD_NAMES = frozenset("article content post entry story main maincontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?:/?[A-Za-z])[^>]*(?:>|\Z)", re.DOTALL)
_QUIET_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?![^\s/>]).*?(?:</\1(?![^\s/>])|\Z)|<(/?)({'|'.join(QUIET)})(?![^\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
#: Longest run of tokens tried as the unit of a repeated group; most characters of a tag's class that count.
UNIT, NAMED = 8, 40
#: Parts that the shapes of one host are merged in, by rounds; shapes that a task holds before it hands them on.
PARTS, HELD = (64,), 2_000
#: From so many pages with different texts on, a text that never changes is part of the template; in an article it takes more.
STEADY, INSIDE = 3, 4
#: Shapes of pages whose match a wrapper remembers.
SHAPES = 2_000


def ended(html: str) -> set[int]:
    """Places of the tags of QUIET elements that an end tag closes; a button, select or noscript can't stand in its like."""
    opened: dict[str, list[int]] = {}
    out = set()
    for m in _QUIET_TAG.finditer(html):
        if not (name := (m[3] or "").lower()) or m[4].endswith("/"):
            continue
        at = opened.setdefault(name, [])
        if not m[2]:
            if name in ("button", "select", "noscript"):
                at.clear()
            at.append(m.start())
        elif at:
            out.add(at.pop())
    return out


def names_furniture(names: list[str], inside: bool) -> bool:
    """Whether class, id or role names mark furniture: a word of the list, alone or as part of a name.

    Within an article only names that say nothing else count ("ad", "share-buttons", but not "side-effects" or "search-methods").
    """
    for name in names:
        parts = set(_PART.findall(name))
        if parts & BAD_NAMES and (not inside or parts <= BAD_NAMES | NEUTRAL_NAMES):
            return True
    return False


def tokens(html: str) -> list[tuple[str, str]]:
    """(key, text): key is a tag such as "<div.ad" or "</div", or for texts "#a" in articles, "#b" in furniture, "#l" in links, "#".

    Closed QUIET elements are furniture that gives no tokens; self-closed ones and those that nothing closes hold nothing.
    """
    out, stack, at = [], [], 0
    bad = good = links = quiet = 0
    closed = None
    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at and not quiet:
            text = html[at:stop]
            if not text.isspace():
                out.append(("#b" if bad else "#a" if good else "#l" if links else "#", references.unescape(text)))
            elif out:
                out.append((" ", " "))
        if not m:
            break
        at = m.end()
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if not closing and name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if name in QUIET:
            if not closing and not attributes.endswith("/"):
                closed = ended(html) if closed is None else closed
                if m.start() in closed:
                    stack.append((name, True, False))
                    bad, quiet = bad + 1, quiet + 1
            if not closing or not any(x[0] == name for x in stack):
                continue
        if name == "a":
            links = 0 if closing else 1
        if not closing:
            words = [x for _, *values in _ATTRIBUTE.findall(attributes) for x in values if x] if attributes else []
            names = [n for x in words for n in x.lower().split()]
            marks = {p for n in names for p in _PART.findall(n)}
            shown = "." + ".".join(sorted(marks))[:NAMED] if marks else ""
            if not quiet:
                out.append((f"<{name}{shown}", ""))
            if name in CONTAINERS or marks and name not in VOID and name not in ("p", "li"):
                state = (bool(name in FURNITURE or (name not in ("html", "body", "article", "main") and names_furniture(names, good > 0)) or _HIDDEN.search(attributes)), name in ARTICLE or bool(marks & GOOD_NAMES))
                stack.append((name, *state))
                bad, good = bad + state[0], good + state[1]
        else:
            if any(x[0] == name for x in stack):
                while True:
                    top, was_bad, was_good = stack.pop()
                    bad, good, quiet = bad - was_bad, good - was_good, quiet - (top in QUIET)
                    if top == name:
                        break
            if not quiet and name not in QUIET:
                out.append((f"</{name}", ""))
    return out


# A wrapper is a list of items: a tag key; a text [key, hashes of up to INSIDE pages, text hash or null], in a page also its places; {"+": items} and {"?": items}.


def key_of(item) -> str:
    if isinstance(item, str):
        return item
    if isinstance(item, list):
        return item[0]
    mark, inner = next(iter(item.items()))
    return f"({' '.join(map(key_of, inner))}){mark}"


def joined(a: list, b: list) -> list:
    """Two runs of items with equal keys as one."""
    out = []
    for x, y in zip(a, b):
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            out.append([x[0], x[1] if x[1] == y[1] else sorted({*x[1], *y[1]})[:INSIDE], x[2] if x[2] == y[2] else None, *(p + q for p, q in zip(x[3:], y[3:]))])
        else:
            mark = next(iter(x))
            out.append({mark: joined(x[mark], y[mark])})
    return out


def fold(items: list) -> list:
    """Neighbouring equal runs as repeated groups, shortest units first, until nothing changes."""
    while True:
        keys, out, seen, i = [key_of(x) for x in items], [], [], 0
        while i < len(items):
            for n in range(1, min(UNIT, (len(items) - i) // 2) + 1):
                unit, j = keys[i : i + n], i + n
                if unit[0] == keys[j] and unit == keys[j : j + n] and not (n == 1 and isinstance(items[i], dict)):
                    group = items[i:j]
                    while keys[j : j + n] == unit:
                        group = joined(group, items[j : j + n])
                        j += n
                    out.append({"+": group})
                    i = j
                    break
            else:
                last = out[-1] if out else None
                if isinstance(last, dict) and "+" in last and (n := len(last["+"])) and [key_of(x) for x in last["+"]] == keys[i : i + n]:
                    last["+"] = joined(last["+"], items[i : i + n])
                    i += n
                elif isinstance(last, dict) and key_of(last) == keys[i]:
                    out[-1] = joined([last], [items[i]])[0]
                    i += 1
                else:
                    out.append(items[i])
                    i += 1
        if len(out) == len(items):
            return out
        items = out


def page_wrapper(page: list[tuple[str, str]]) -> list:
    whole = [zlib.crc32("\n".join(t for k, t in page if k[0] == "#").encode("utf-8", "replace"))]
    return fold([k if k[0] == "<" else [k, whole, zlib.crc32(t.encode("utf-8", "replace"))] for k, t in page if k != " "])


def placed(page: list[tuple[str, str]]) -> list:
    """The folded page with the places of its texts."""
    return fold([k if k[0] == "<" else [k, [], None, [i]] for i, (k, _) in enumerate(page) if k != " "])


def unrolled(items: list) -> list:
    """Tags and texts in order, repeated groups going twice."""
    out = []
    for x in items:
        if isinstance(x, dict):
            mark, inner = next(iter(x.items()))
            out += unrolled(inner) * (2 if mark == "+" else 1)
        else:
            out.append(x)
    return out


def _group(items: list, mark: str):
    """items as the inside of a group, and whether they were one already."""
    if len(items) == 1 and isinstance(items[0], dict) and mark in items[0]:
        return items[0][mark], True
    return items, False


def align(a: list, b: list) -> list:
    """One wrapper that matches what either matches."""
    left, right = [key_of(x) for x in a], [key_of(x) for x in b]
    if left == right:
        return joined(a, b)
    out = []
    for what, i, j, k, n in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            out += joined(a[i:j], b[k:n])
            continue
        one, other = a[i:j], b[k:n]
        if one and other:
            for mark in "+?":
                (x, was_x), (y, was_y) = _group(one, mark), _group(other, mark)
                if (was_x or was_y) and [key_of(z) for z in x] == [key_of(z) for z in y]:
                    out.append({mark: joined(x, y)})
                    one = other = []
                    break
        for side in (one, other):
            if side:
                last = out[-1] if out else None
                if isinstance(last, dict) and "+" in last and [key_of(x) for x in last["+"]] == [key_of(x) for x in side]:
                    last["+"] = joined(last["+"], side)
                else:
                    inner, was = _group(side, "?")
                    out.append(side[0] if was else {"?": inner})
    return out


def merge(wrappers: list[list]) -> list:
    """Wrappers aligned one by one, in the order of their keys, so that reruns agree."""
    distinct: dict[str, list] = {}
    for w in wrappers:
        k = " ".join(map(key_of, w))
        distinct[k] = joined(distinct[k], w) if k in distinct else w
    ordered = [distinct[k] for k in sorted(distinct, key=lambda k: (len(k), k))]
    return functools.reduce(align, ordered)


class Extractor:
    """A wrapper as a program that matches token streams, and which of its slots differ from page to page.

    All ways through the wrapper are followed at once, so the time is the stream's length times the wrapper's at most. Pages that fold to
    the same shape are matched once.
    """

    def __init__(self, wrapper: list):
        self.code: list[tuple] = []
        self.slots: list[list] = []
        self._compile(wrapper)
        self.code.append(("end",))
        pages: dict[int, set[int]] = {}
        for x in self.slots:
            if x[2] is not None:
                pages.setdefault(x[2], set()).update(x[1])
        self.steady = [x[2] is not None and len(pages[x[2]]) >= (INSIDE if x[0] == "#a" else STEADY) for x in self.slots]
        #: If all of the host's texts outside articles, furniture and links are steady, they count as if they differed.
        self.plain = not any(x[0] == "#" and not s for x, s in zip(self.slots, self.steady))
        self.known: dict[str, list[int] | None] = {}

    def _compile(self, items: list) -> None:
        for x in items:
            if isinstance(x, str):
                self.code.append(("token", x, None))
            elif isinstance(x, list):
                self.code.append(("token", x[0], len(self.slots)))
                self.slots.append(x)
            else:
                mark, inner = next(iter(x.items()))
                at = len(self.code)
                if mark == "?":
                    self.code.append(("fork",))
                    self._compile(inner)
                    self.code[at] = ("fork", at + 1, len(self.code))
                else:
                    self._compile(inner)
                    self.code.append(("fork", at, len(self.code) + 1))

    def _ways(self, starts: list[tuple[int, tuple | None]]) -> dict[int, tuple | None]:
        """Places in the program that are reached without a token, the preferred way to each."""
        out: dict[int, tuple | None] = {}
        stack = starts[::-1]
        while stack:
            at, said = stack.pop()
            if at not in out:
                out[at] = said
                if self.code[at][0] == "fork":
                    stack += [(self.code[at][2], said), (self.code[at][1], said)]
        return out

    def match(self, keys: list[str]) -> list[int] | None:
        """The slot of each text of a token stream; None if the stream isn't one of the wrapper's."""
        ways = self._ways([(0, None)])
        for key in keys:
            after = []
            for at, said in ways.items():
                step = self.code[at]
                if step[0] == "token" and step[1] == key:
                    after.append((at + 1, said if step[2] is None else (step[2], said)))
            if not after:
                return None
            ways = self._ways(after)
        if (end := len(self.code) - 1) not in ways:
            return None
        out, said = [], ways[end]
        while said is not None:
            out.append(said[0])
            said = said[1]
        return out[::-1]

    def chosen(self, page: list[tuple[str, str]]) -> set[int]:
        """Places of the tokens that are main text."""
        shape = placed(page)
        stream = unrolled(shape)
        key = " ".join(map(key_of, shape))
        if key not in self.known:
            if len(self.known) >= SHAPES:
                self.known.clear()
            self.known[key] = self.match([key_of(x) for x in stream])
        slots = self.known[key]
        if slots is None:
            differs = {i for i, (k, _) in enumerate(page) if k[0] == "#"}
        else:
            differs = set()
            for x, slot in zip((x for x in stream if isinstance(x, list)), slots):
                if not self.steady[slot] or x[0] == "#" and self.plain:
                    differs.update(x[3])
        return main_places(page, differs)


def main_places(page: list[tuple[str, str]], differs: set[int]) -> set[int]:
    """Places of the main text of a page: of its articles and of what stands outside furniture and links, the texts that differ from page to page, each by its own slot; its articles where none does."""
    marked = {i for i, (k, _) in enumerate(page) if k == "#a"}
    free = {i for i in differs if page[i][0] == "#"}
    inside = marked & differs
    if not free and not inside:
        return marked
    return free | inside | beside(page, free, ("#", "#l")) | beside(page, inside, ("#a",))


def beside(page: list[tuple[str, str]], chosen: set[int], keys: tuple[str, ...]) -> set[int]:
    """Places of the texts of some keys that stand in one block with chosen words."""
    linked, block, words = set(), [], False
    for i, (key, text) in enumerate(page):
        if key[0] == "<" and key[1:].lstrip("/").partition(".")[0] not in INLINE or key == "<br":
            if words:
                linked.update(block)
            block, words = [], False
        elif key in keys:
            block.append(i)
            words = words or i in chosen and any(map(str.isalnum, text))
    return linked.union(block if words else ())


def blocks(page: list[tuple[str, str]], chosen: set[int]) -> str:
    """The chosen texts: one block between block-level tags, white space as one space, blocks joined by empty lines."""
    out, block = [], []

    def close() -> None:
        if x := " ".join("".join(block).split()):
            out.append(x)
        block.clear()

    for i, (key, text) in enumerate(page):
        if key[0] == "<":
            name = key[1:].lstrip("/").partition(".")[0]
            if name == "br":
                block.append(" ")
            elif name not in INLINE:
                close()
        elif i in chosen or key == " ":
            block.append(text)
    close()
    return "\n\n".join(out)


@functools.lru_cache(maxsize=256)
def _extractor(wrapper: str) -> Extractor:
    return Extractor(json.loads(wrapper))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one row per host, the wrapper as JSON."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            for host, html in zip(batch["host"], batch["html"]):
                if html:
                    w = page_wrapper(tokens(html))
                    k = (host, " ".join(map(key_of, w)))
                    held[k] = joined(held[k], w) if k in held else w
                    if len(held) >= HELD:
                        yield _shapes(held)
                        held = {}
        yield _shapes(held)

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "part": [int(group["part"].iloc[0])], "wrapper": [json.dumps(merge([json.loads(x) for x in sorted(group["wrapper"])]))]})

    rows = pages.select("host", "html").mapInPandas(own, "host string, part int, wrapper string")
    for parts in PARTS:
        rows = rows.groupBy("host", F.pmod("part", F.lit(parts)).alias("in_part")).applyInPandas(merged, "host string, part int, wrapper string")
    return rows.groupBy("host").applyInPandas(merged, "host string, part int, wrapper string").drop("part")


def _shapes(held: dict[tuple[str, str], list]) -> pd.DataFrame:
    rows = [(host, zlib.crc32(shape.encode("utf-8", "replace")) >> 1, json.dumps(w)) for (host, shape), w in sorted(held.items())]
    return pd.DataFrame(rows, columns=["host", "part", "wrapper"])


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars."""
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    host, known, wrapper = common.scratch(pages, "w_host", "w_known", "w_wrapper")
    rows = pages.select(*kept, host_of(F.col("url")).alias(host))
    found = common.cut(wrappers(rows.select(F.col(host).alias("host"), "html"))).select(F.col("host").alias(known), F.col("wrapper").alias(wrapper))
    rows = rows.join(found, F.col(host) == F.col(known), "left")

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages_html, known in batches:
            out = []
            for html, wrapper in zip(pages_html, known):
                page = tokens(html) if html else []
                out.append(blocks(page, _extractor(wrapper).chosen(page)) if page else "")
            yield pd.Series(out, dtype=object)

    rows = rows.select(*kept, main_text(F.col("html"), F.col(wrapper)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
