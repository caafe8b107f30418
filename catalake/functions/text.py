"""Text functions: HTML fragments, search terms, and name similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed named references, in the order in which they are decoded.
NAMED = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&laquo;", "«"), ("&raquo;", "»")]
# Fixed words that say nothing about a name's identity.
STOP_WORDS = ["the", "a", "an", "and", "of", "to", "in", "for", "with", "year", "years", "old"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it: a name for a value inside an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_tags(html: Column, by: str = "") -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", by)


def clean(html: Column) -> Column:
    """Tags to spaces, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(strip_tags(html, " "), r"\s+", " "))


def decode_entities(html: Column) -> Column:
    """Numeric, then named references, one after the other, so that an escaped reference is decoded too."""
    decimal = bound(F.coalesce(html, F.lit("")), lambda t: _numeric(t, r"&#([0-9]{1,7});", 10))
    both = bound(decimal, lambda t: _numeric(t, r"&#[xX]([0-9a-fA-F]{1,6});", 16))
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), NAMED, both)


def _numeric(text: Column, pattern: str, base: int) -> Column:
    def fill(chars: Column) -> Column:
        return F.array_join(F.transform(F.split(text, pattern, -1), lambda g, i: F.concat(g, F.coalesce(F.get(chars, i), F.lit("")))), "")

    codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.contains(text, F.lit("&#")), bound(F.transform(codes, lambda c: _code_point(F.conv(c, base, 10).cast("long"))), fill)).otherwise(text)


def _code_point(n: Column) -> Column:
    """A code point as text, by way of its UTF-32 bytes."""
    valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def attribute(html: Column, name: str) -> Column:
    """The value of the first attribute of that name: double-quoted, single-quoted or bare."""
    def read(text: Column) -> Column:
        value = lambda quoted: F.nullif(F.regexp_extract(text, rf"(?i)\b{name}\s*=\s*{quoted}", 1), F.lit(""))
        return F.coalesce(value('"([^"]*)"'), value("'([^']*)'"), value("([^\\s\"'>]+)"), F.lit(""))

    return bound(F.coalesce(html, F.lit("")), read)


def first_of_srcset(srcset: Column) -> Column:
    return F.split(F.trim(F.split(F.coalesce(srcset, F.lit("")), ",")[0]), r"\s+")[0]


def escape_html(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], F.coalesce(text, F.lit("")))


def padded(text: Column, width: Column | int, left: bool = False) -> Column:
    """The text filled with spaces up to a width; a longer one stays whole."""
    width = F.greatest(F.char_length(text), F.lit(width) if isinstance(width, int) else width)
    return F.lpad(text, width, F.lit(" ")) if left else F.rpad(text, width, F.lit(" "))


def sanitize_name(name: Column) -> Column:
    """Decoded and cleaned, with letters, digits, spaces and -&().,/ only."""
    kept = F.regexp_replace(clean(decode_entities(name)), r"[^\p{L}\p{N}\s\-&().,/]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def search_norm(text: Column) -> Column:
    """Lower case, with runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(search_norm(text), " "), lambda t: t != "")


def similarity_tokens(text: Column) -> Column:
    """Distinct tokens without stop words; numbers stay."""
    return F.array_distinct(F.filter(tokens(text), lambda t: t.rlike("^[0-9]+$") | ~t.isin(STOP_WORDS)))


def matches_all(hay: Column, query: list[str]) -> Column:
    """Every query token is a substring; no token matches all."""
    return reduce(lambda a, t: a & F.contains(hay, F.lit(t)), query, F.lit(True))


def number_penalty(a: Column, b: Column) -> Column:
    """0.55 if both token lists have numbers and share none, else 1."""
    number = lambda ts: F.filter(ts, lambda t: t.rlike("^[0-9]+$"))
    return F.when((F.size(number(a)) > 0) & (F.size(number(b)) > 0) & ~F.arrays_overlap(number(a), number(b)), 0.55).otherwise(1.0)


def _tail_share(a: Column, b: Column) -> Column:
    rest = lambda ts: F.slice(ts, 2, F.greatest(F.size(ts) - 1, F.lit(0)))
    shared, most = F.size(F.array_intersect(rest(a), rest(b))), F.greatest(F.size(a), F.size(b)) - 1
    return F.when(most > 0, shared / most).otherwise(0.0)


def similarity(name_a: Column, name_b: Column, a: Column, b: Column) -> Column:
    """Score of two names with their similarity tokens: first token, shared tail, edit distance, number agreement."""
    na, nb = search_norm(name_a), search_norm(name_b)
    first = F.when((F.size(a) > 0) & (F.size(b) > 0) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0))), 1.0).otherwise(0.0)
    gate = F.when(first > 0, 1.0).otherwise(0.12)
    longest = F.greatest(F.length(na), F.length(nb))
    edit = F.when(longest > 0, 1 - F.levenshtein(na, nb) / longest).otherwise(0.0)
    score = number_penalty(a, b) * (3 * first + 2.2 * _tail_share(a, b) * gate + edit * F.when(first > 0, 1.0).otherwise(0.15))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def cheap_similarity(name_a: Column, name_b: Column, a: Column, b: Column) -> Column:
    """As similarity, with an equal ten-character start, which counts beside an equal first token only, instead of the edit distance."""
    na, nb = search_norm(name_a), search_norm(name_b)
    first = F.when((F.size(a) > 0) & (F.size(b) > 0) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0))), 1.0).otherwise(0.0)
    start = F.when((first > 0) & (F.length(na) > 0) & (F.substring(na, 1, 10) == F.substring(nb, 1, 10)), 0.2).otherwise(0.0)
    score = number_penalty(a, b) * (2.4 * first + 2.0 * _tail_share(a, b) * F.when(first > 0, 1.0).otherwise(0.12) + start)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def code_key(name: Column) -> Column:
    """The ddd.dddd code of a name that has the society's word."""
    return F.when(F.coalesce(name, F.lit("")).rlike(r"(?i)(?<![0-9A-Za-z_])smws(?![0-9A-Za-z_])"), F.regexp_extract(name, r"([0-9]{1,3}\.[0-9]{1,4})", 1)).otherwise("")
