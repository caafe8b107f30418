"""Identity functions: six-digit codes, synthetic keys and pair keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295


def six_digits(value: Column) -> Column:
    """The first run of exactly six digits that no letter, digit or underscore touches; else empty."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), "(?<![0-9A-Za-z_])([0-9]{6})(?![0-9A-Za-z_])", 1)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over UTF-16 units, as 8 hex digits."""
    units = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    count = (F.length(units) / 4).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    unit = F.transform(places, lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    step = F.aggregate(unit, F.lit(FNV_START).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(FNV_MASK).cast("long")))
    return F.lower(F.lpad(F.hex(step), 8, "0"))


def synthetic(store: Column, url: Column) -> Column:
    """u: and the hash of store and URL; empty without a URL."""
    url = F.trim(F.coalesce(url, F.lit("")))
    return F.when(url == "", F.lit("")).otherwise(F.concat(F.lit("u:"), fnv1a(F.concat(F.coalesce(store, F.lit("")), F.lit("|"), url))))


def stored_key(value: Column, store: Column, url: Column) -> Column:
    """Six digits, else a stored synthetic key, else a new one."""
    own = F.trim(F.coalesce(value, F.lit("")))
    return F.coalesce(F.nullif(six_digits(own), F.lit("")), F.when(own.startswith("u:"), own), synthetic(store, url))


def diff_key(value: Column, store: Column, url: Column) -> Column:
    """Six digits, else a new synthetic key, whatever is stored."""
    return F.coalesce(F.nullif(six_digits(value), F.lit("")), synthetic(store, url))


def raw_key(value: Column, store: Column, url: Column) -> Column:
    """The trimmed value, else a synthetic key."""
    return F.coalesce(F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit("")), synthetic(store, url))


def display(key: Column) -> Column:
    return F.when(key.startswith("u:"), F.lit("unknown")).otherwise(key)


def pair_key(a: Column, b: Column, ordered: bool = False) -> Column:
    """One key for a pair; empty if an end is missing or both are the same."""
    a, b = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    both = F.concat_ws("|", a, b) if ordered else F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return F.when((a == "") | (b == "") | (a == b), F.lit("")).otherwise(both)


def representative_order(key: Column) -> Column:
    """A total order of keys: real before synthetic, numbers by value, then by text. The least of a group represents it."""
    number = F.when(key.rlike("^[0-9]+$"), key.try_cast("decimal(38,0)"))
    return F.struct(key.startswith("u:").alias("synthetic"), number.isNull().alias("textual"), number.alias("number"), key.alias("text"))


def file_id(store: Column, category: Column, base_url: Column) -> Column:
    """The name of a snapshot file: safe store and category keys, and 8 hex digits of the source."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9._-]", "-")
    return F.concat(safe(F.concat_ws("__", store, category)), F.lit("__"), F.substring(F.sha1(base_url), 1, 8), F.lit(".json"))
