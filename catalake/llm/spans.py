"""Digest columns of found spans, from an array of (kind, start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:long,end:long>>"


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the kind's place in ``kinds``, then by end."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; empty for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column, base: list[str], kinds: list[str]) -> list[Column]:
    """n_<kind> of each base kind, base_sha256 and spans."""
    is_base = F.filter(spans, lambda s: s["kind"].isin(*base))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return [*counts, F.sha2(joined(ordered(is_base, kinds)), 256).alias("base_sha256"), joined(ordered(spans, kinds)).alias("spans")]
