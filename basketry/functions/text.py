"""Text of product names, codes and stores: normal forms, tokens, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Final letters and their usual forms, noun endings, the letters that spelling doubles, words of store kinds.
FINALS, USUAL = "ךםןףץ", "כמנפצ"
ENDINGS = ("ות", "ימ", "ה", "ת")
MATRES = "יו"
WAREHOUSE = "(?i)warehouse|depot|מחסן|מרלוג|מרלו\"ג"
PICKUP = "(?i)pickup|pick-up|איסוף|נקודת"
ONLINE = "(?i)online|אונליין|אינטרנט|\\.co\\.il|www\\."
URL_ONLY = r"(?i)^\s*(https?://|www\.)\S+\s*$"
GTIN_LENGTHS = (8, 12, 13, 14)


def embed_input(text: Column) -> Column:
    """Lower case without quotation marks, one space between runs of letters and digits."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['׳`\"״]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(embed_input(text), " "), lambda t: t != "")


def stem(token: Column) -> Column:
    """The token with usual letter forms and without one noun ending, if enough of it is left."""
    t = F.translate(token, FINALS, USUAL)
    out = F.when(F.lit(False), t)
    for end in ENDINGS:
        rest = F.char_length(t) - len(end)
        least = 2 if len(end) >= 2 else 3
        out = out.when(t.endswith(end) & (rest >= least), F.left(t, rest))
    return out.otherwise(t)


def fold_matres(token: Column) -> Column:
    bare = F.translate(token, MATRES, "")
    return F.when((F.char_length(token) >= 5) & (F.char_length(bare) >= 3), bare).otherwise(token)


def match_key(token: Column) -> Column:
    return fold_matres(stem(token))


def singulars(token: Column) -> Column:
    """Singular forms that a plural may come from."""
    t = F.translate(token, FINALS, USUAL)
    s = stem(token)
    last = F.right(s, F.lit(1))
    closed = F.concat(F.left(s, F.char_length(s) - 1), F.translate(last, USUAL, FINALS))
    plural_m = t.endswith("ימ") & (F.char_length(t) >= 4)
    plural_f = t.endswith("ות") & (F.char_length(t) >= 4)
    return F.when(plural_m, F.array(closed)).when(plural_f, F.array(F.concat(s, F.lit("ה")), F.concat(s, F.lit("ת")))).otherwise(F.array().cast("array<string>"))


def all_tokens_in(query: Column, name: Column) -> Column:
    """Whether every token of the query stands in the name, up to endings and spelling."""
    keys = lambda x: F.transform(tokens(x), match_key)
    return F.size(F.array_except(keys(query), keys(name))) == 0


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two spaces before and one after."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def _dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) * 2 / total)


def name_similarity(a: Column, b: Column) -> Column:
    """The best of shared words, shared letter pairs, and one name containing the other."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))
    x, y = plain(a), plain(b)
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"[\s,.\-/\\|:+*×]+"), lambda w: F.char_length(w) >= 2))
    joined = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    pairs = lambda t: F.when(F.char_length(t) < 2, F.filter(F.array(t), lambda w: w != "")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))
    )
    short = F.when(F.char_length(x) <= F.char_length(y), joined(x)).otherwise(joined(y))
    long = F.when(F.char_length(x) <= F.char_length(y), joined(y)).otherwise(joined(x))
    inside = F.when((F.char_length(short) >= 4) & F.contains(long, short), F.char_length(short) / F.char_length(long)).otherwise(0.0)
    score = F.greatest(_dice(words(x), words(y)), _dice(pairs(joined(x)), pairs(joined(y))), inside)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(score)


def like_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def digits(code: Column) -> Column:
    return F.regexp_replace(code, r"[^0-9]", "")


def gtin(code: Column) -> Column:
    """Digits without leading zeros, if at least eight are left."""
    bare = F.regexp_replace(digits(code), "^0+", "")
    return F.when(F.char_length(bare) >= 8, bare).otherwise(digits(code))


def is_gtin(item_type: Column, code: Column) -> Column:
    all_digits = digits(code)
    bare = F.regexp_replace(all_digits, "^0+", "")
    length = F.when(F.char_length(all_digits).isin(*GTIN_LENGTHS), F.char_length(all_digits)).otherwise(F.char_length(bare))
    return F.coalesce((item_type == 1) & length.isin(*GTIN_LENGTHS) & ~bare.startswith("2"), F.lit(False))


def item_code(item_type: Column, code: Column) -> Column:
    return F.when(is_gtin(item_type, code), gtin(code)).otherwise(code)


def store_code(code: Column) -> Column:
    """A number padded to three digits; anything else as it is."""
    x = F.trim(code)
    plain = F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.when(x.rlike("^[0-9]+$"), F.lpad(plain, F.greatest(F.char_length(plain), F.lit(3)), F.lit("0"))).otherwise(x)


def store_kind(feed_type: Column, name: Column, address: Column) -> Column:
    text = F.coalesce(name, F.lit(""))
    return (
        F.when((feed_type == 2) & text.rlike(PICKUP), "pickup")
        .when(feed_type == 2, "online")
        .when(text.rlike(WAREHOUSE), "warehouse")
        .when(text.rlike(PICKUP), "pickup")
        .when(text.rlike(ONLINE) | F.coalesce(address.rlike(URL_ONLY), F.lit(False)), "online")
        .otherwise("branch")
    )


def scrubbed(text: Column) -> Column:
    """Without NUL characters and the common entities, white space squeezed."""
    x = F.replace(text, F.lit("\x00"), F.lit(""))
    x = F.regexp_replace(x, r"&#x0*[dD];|&#0*13;|&#x0*[aA];|&#0*10;|&nbsp;", " ")
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def percents(text: Column) -> Column:
    """The percentages that a name states, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def percents_conflict(a: Column, b: Column) -> Column:
    return (F.size(percents(a)) > 0) & (F.size(percents(b)) > 0) & ~F.arrays_overlap(percents(a), percents(b))


def head_anchored(query: Column, name: Column) -> Column:
    """Whether the query's first token is one of the name's first two."""
    head = F.get(F.transform(tokens(query), match_key), F.lit(0))
    return F.coalesce(F.array_contains(F.slice(F.transform(tokens(name), match_key), 1, 2), head), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(embed_input(text), 256), F.lit(32))


def number(text: Column) -> Column:
    """A number with either kind of comma: a lone one is decimal, others group thousands."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    commas = F.regexp_count(s, F.lit(","))
    plain = F.when((commas > 1) | ((commas == 1) & F.contains(s, F.lit("."))), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return F.when(plain != "", plain.try_cast("double"))
