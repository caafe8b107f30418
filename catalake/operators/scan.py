"""Paged scans of all categories at once: how many pages there are, which of them count, and the merge of what they list.

A table of pages has category, page (from 1), url and the page's text, null where it
could not be fetched. Nothing here walks pages one by one: discovery probes one page of
every open category in a round, and stop rules are minima over (category, page) keys, so
a category with most of the pages is no single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .merge import merge


def discover(first: DataFrame, listed: DataFrame, guess: int = 20, step: int = 5, growth: int = 2, most: int | None = None) -> DataFrame:
    """category, last_page and probes (pages looked at) of every row of first.

    first has category, listed (page 1 lists something) and pages (the number its page
    links name, 0 without); listed has the pages (category, page) that list something.
    A category whose first page lists nothing has one page, and one with page links as many
    as they name. The others are searched: the page ``guess``, then further ones, ``step``
    apart at first and ``growth`` times as far each time, up to one that lists nothing;
    then the gap is halved. So the rounds, one join each, grow with the logarithm of the
    pages; with ``growth`` 1 they are the catalogue's even steps. ``most`` ends a search
    beyond that page, as a guard against endless listings; by default there is none.
    Where pages within a listing are missing, the result is the end that the search met.
    """
    known = checkpointed(listed.select("category", F.col("page").cast("long").alias("probe")).where("category is not null and probe is not null").distinct().withColumn("there", F.lit(True)))
    start = first.select("category", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce(F.col("pages").cast("long"), F.lit(0).cast("long")).alias("pages"))
    settled = ~F.col("listed") | (F.col("pages") >= 1)
    done = start.where(settled).select("category", F.when(F.col("listed"), F.col("pages")).otherwise(1).cast("long").alias("last_page"), F.lit(1).cast("long").alias("probes"))
    number = lambda x: F.lit(x).cast("long")
    open_ = start.where(~settled).select("category", number(1).alias("lo"), number(None).alias("hi"), number(step).alias("gap"), number(max(2, guess)).alias("probe"), number(1).alias("probes"))
    while not open_.isEmpty():
        met = open_.join(known, ["category", "probe"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
        ahead = F.col("hi").isNull() & F.col("there")
        moved = met.select("category", F.when(F.col("there"), F.col("probe")).otherwise(F.col("lo")).alias("lo"), F.when(~F.col("there"), F.col("probe")).otherwise(F.col("hi")).alias("hi"), F.when(ahead, F.col("gap") * growth).otherwise(F.col("gap")).alias("gap"), F.col("gap").alias("by"), (F.col("probes") + 1).alias("probes"))
        guarded = F.lit(False) if most is None else F.col("hi").isNull() & (F.col("lo") > most)
        moved = checkpointed(moved.withColumn("over", guarded | F.coalesce(F.col("hi") - F.col("lo") <= 1, F.lit(False))))
        done = done.unionByName(moved.where("over").select("category", F.col("lo").alias("last_page"), "probes"))
        half = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)
        open_ = moved.where("not over").select("category", "lo", "hi", "gap", F.coalesce(half, F.col("lo") + F.col("by")).alias("probe"), "probes")
    return done


#: Why a category's reading ended.
REASONS = ("last", "marked", "empty", "failed", "missing")


def stops(pages: DataFrame, empties: int = 2, totals: DataFrame | None = None) -> DataFrame:
    """category, stop (the first page that doesn't count), reason and complete, for every category.

    pages has category, page, n_items, marked (the page says that it lists nothing) and
    failed (it could not be read). Reading stops at the first marked page, at the
    ``empties``-th page in a row without items, at a failed one, at a missing one, or
    behind the last page by totals (category, last_page). A scan is complete if a marked
    or empty page or the known last one ended it; a missing page behind the table's end
    leaves that open, so it isn't. Of reasons at one page the first of REASONS counts.
    """
    rows = pages.select("category", F.col("page").cast("long").alias("page"), "n_items", "marked", "failed").where("category is not null and page >= 1")
    keyed = rows.groupBy("category", "page").agg(F.max("n_items").alias("n_items"), F.max("marked").alias("marked"), F.min("failed").alias("failed"))
    keyed = checkpointed(keyed.select("category", "page", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce("failed", F.lit(False)).alias("failed")))
    at = lambda rows, reason: rows.select("category", "page", F.lit(REASONS.index(reason)).alias("why"))
    without = keyed.where("n_items = 0 and not marked and not failed")
    runs = without.select("category", F.explode(F.sequence("page", F.col("page") + empties - 1)).alias("page")).groupBy("category", "page").count().where(F.col("count") == empties)
    # A page is missing behind each page without a next one, and at 1 where that isn't there.
    behind = keyed.select("category", (F.col("page") + 1).alias("page")).union(keyed.select("category").distinct().withColumn("page", F.lit(1).cast("long")))
    missing = behind.join(keyed.select("category", "page"), ["category", "page"], "left_anti")
    ends = at(keyed.where("marked"), "marked").union(at(runs, "empty")).union(at(keyed.where("failed and not marked"), "failed")).union(at(missing, "missing"))
    if totals is not None:
        ends = ends.union(at(totals.select("category", (F.col("last_page").cast("long") + 1).alias("page")).join(keyed.select("category").distinct(), "category", "left_semi"), "last"))
    first = ends.groupBy("category").agg(F.min(F.struct("page", "why")).alias("s"))
    reason = F.get(F.array(*map(F.lit, REASONS)), F.col("s.why"))
    return first.select("category", F.col("s.page").alias("stop"), reason.alias("reason"), reason.isin("marked", "empty", "last").alias("complete"))


def scan(prev: DataFrame, pages: DataFrame, parse: Callable[[DataFrame], DataFrame], marked: Callable[[Column], Column] = lambda html: F.lit(False), empties: int = 2, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged snapshots of all categories, a report of each category, and the pages that failed.

    prev has category and a snapshot's columns, pages has category, page, url and html, and
    parse turns url and html into listings with page_url and ord. The pages are parsed once;
    those before each category's stop count, and of one URL in a category the last listing
    does, by page and place. A category whose scan is incomplete is updated but loses
    nothing, and one without pages stays as it is. Failed pages (no text) are category,
    page, url and cause; so are pages that list nothing and don't say so where the listing
    goes on behind them.
    """
    table = checkpointed(pages.select("category", F.col("page").cast("long").alias("page"), "url", "html").where("category is not null and page >= 1"))
    found = parse(table.where("html is not null").select("url", "html"))
    found = checkpointed(found.select("page_url", "url", "name", "price", "sku", "img", "ord"))
    counts = found.groupBy(F.col("page_url").alias("url")).agg(F.count("*").alias("n_items"))
    state = table.select("category", "page", "url", F.coalesce(marked(F.col("html")), F.lit(False)).alias("marked"), F.col("html").isNull().alias("failed")).join(counts, "url", "left").fillna(0, ["n_items"])
    state = checkpointed(state)
    ends = checkpointed(stops(state, empties, totals))
    before = state.join(ends, "category").where("page < stop")
    rows = found.join(before.select("category", "page", F.col("url").alias("page_url")), "page_url")
    listed = rows.groupBy("category", "url").agg(F.max_by(F.struct("name", "price", "sku", "img"), F.struct("page", "ord")).alias("r")).select("category", "url", "r.*")
    merged = merge(prev, listed, complete=ends.select("category", "complete"), by=("category",))
    sums = before.groupBy("category").agg(F.count("*").alias("pages_read"), F.sum("n_items").alias("listed"))
    report = ends.join(sums, "category", "left").fillna(0, ["pages_read", "listed"])
    failures = state.where("failed").select("category", "page", "url", F.lit("no text").alias("cause"))
    silent = before.where("n_items = 0 and not marked and not failed").select("category", "page", "url", F.lit("no listing").alias("cause"))
    return merged, report, failures.unionByName(silent)
