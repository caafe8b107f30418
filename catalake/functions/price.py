"""Price functions: strings of a catalogue to numbers and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def normalize(price: Column) -> Column:
    """The price string without any white space."""
    return F.regexp_replace(F.coalesce(price, F.lit("")), r"\s+", "")


def to_number(price: Column, empty: float | None = 0.0) -> Column:
    """The digits and points of a price as a number; ``empty`` without any, null if malformed."""
    kept = F.regexp_replace(F.coalesce(price, F.lit("")), "[^0-9.]", "")
    return F.coalesce(kept.try_cast("double"), F.when(kept == "", F.lit(empty).cast("double")))


def percent_off(old: Column, new: Column, no_drop: str = "null") -> Column:
    """Rounded percentage off. no_drop says what a price that isn't lower gives: null, zero, or null_if_zero (also where it rounds to 0)."""
    drop = (old > 0) & (new >= 0) & (new < old)
    pct = F.floor((old - new) / old * 100 + 0.5).cast("int")
    if no_drop == "zero":
        return F.when(drop, pct).otherwise(0)
    if no_drop == "null_if_zero":
        return F.when(drop & (pct > 0), pct)
    return F.when(drop, pct)


def percent_change(old: Column, new: Column) -> Column:
    """Signed rounded percentage; null unless both are numbers and old is above 0."""
    return F.when(old > 0, F.floor((new - old) / old * 100 + 0.5).cast("int"))


def from_minor_units(value: Column, units: Column) -> Column:
    """A whole number of minor units as a decimal string, by shifting digits."""
    digits = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), "^([0-9]+)$", 1)
    places = F.least(F.greatest(units.cast("int"), F.lit(0)), F.lit(6))
    padded = F.when(F.length(digits) <= places, F.lpad(digits, places + 1, "0")).otherwise(digits)
    cut = F.length(padded) - places
    shifted = F.concat(F.substring(padded, F.lit(1), cut), F.lit("."), F.substring(padded, cut + 1, places))
    return F.when(digits == "", F.lit("")).when(places == 0, digits).otherwise(shifted)


def to_text(amount: Column, grouped: bool = False) -> Column:
    """$1234.50, or $1,234.50 if grouped; empty for null."""
    def write(cents: Column) -> Column:
        whole = F.format_number(F.floor(cents / 100), 0) if grouped else F.floor(cents / 100).cast("string")
        return F.concat(F.lit("$"), whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))

    return F.coalesce(bound(F.round(amount * 100).cast("long"), write), F.lit(""))


def first_amount(text: Column) -> Column:
    """The first dollar amount in a text, without commas; empty if none."""
    return F.replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1), F.lit(","), F.lit(""))


def clamped(text: Column, default: int | None, least: int, most: int) -> Column:
    """The whole number that a text begins with, within bounds; ``default`` if it begins with none."""
    n = F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
    bounded = F.least(F.greatest(n.try_cast("double"), F.lit(least)), F.lit(most)).cast("long")
    return F.when(n != "", bounded).otherwise(F.lit(default).cast("long"))


def near(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.abs(a - b) <= tolerance


def event_score(kind: Column, pct: Column, cheapest: Column, stores: Column) -> Column:
    """The rank score of a change event. Fixed values of the score table."""
    p = F.coalesce(pct, F.lit(0))

    def tiers(big: int, mid: int, low: int, none: int) -> Column:
        return F.when(p >= 20, big + p).when(p >= 10, mid + p).when(p > 0, low + p).otherwise(none)

    down = F.when(cheapest, tiers(9000, 7000, 6000, 5900)).otherwise(tiers(4500, 1500, 1200, 1000))
    return (
        F.when(kind == "price_down", down).when((kind == "new") & (F.coalesce(stores, F.lit(0)) <= 1), 8000).when(kind == "new", 1100)
        .when(kind == "restored", 5000).when(kind == "removed", 3000).when(kind == "price_up", 2000 + F.least(F.greatest(p, F.lit(0)), F.lit(99))).otherwise(0)
    ).cast("long")
