"""Page discovery, stop rules and paged scans against loops over pages."""

import random

import pytest

from catalake.operators import scan


def loop(pages, listed, links, guess, step, growth, most=None):
    """Discovery for one category, probe by probe: (last page, probes)."""
    if not listed:
        return 1, 1
    if links >= 1:
        return links, 1
    lo, hi, gap, probe, probes = 1, None, step, max(2, guess), 1
    while True:
        probes += 1
        if probe in pages:
            lo = probe
            if hi is None:
                if most is not None and lo > most:
                    return lo, probes
                probe, gap = lo + gap, gap * growth
                continue
        else:
            hi = probe
        if hi - lo <= 1:
            return lo, probes
        probe = lo + (hi - lo) // 2


@pytest.mark.parametrize(("growth", "most"), [(1, None), (2, None), (3, 60)])
def test_discovery_against_a_loop(spark, growth, most):
    rng = random.Random(growth)
    cats = {}
    for i in range(60):
        n = rng.choice([1, 2, 19, 20, 21, 25, 26, 40, 137, 300])
        cats[f"c{i}"] = ({p for p in range(1, n + 1) if rng.random() > (0.1 if i % 5 == 0 else 0)}, i % 7 != 0, rng.choice([0, 0, 0, 12]))
    first = spark.createDataFrame([(c, listed, links) for c, (_, listed, links) in cats.items()] + [("null", None, None)], "category string, listed boolean, pages int")
    pages = spark.createDataFrame([(c, p) for c, (have, _, _) in cats.items() for p in have] + [(None, 3), ("c1", None), ("c1", 1)], "category string, page int")
    got = {r["category"]: (r["last_page"], r["probes"]) for r in scan.discover(first, pages, 20, 5, growth, most).collect()}
    assert got == {c: loop(*row, 20, 5, growth, most) for c, row in cats.items()} | {"null": (1, 1)}


def test_discovery_takes_few_rounds(spark):
    """A listing of 100,000 pages among short ones: probes grow with the logarithm."""
    pages = spark.range(1, 100_001).selectExpr("'long' AS category", "id AS page").union(spark.range(1, 4).selectExpr("'short'", "id"))
    first = spark.createDataFrame([("long", True, 0), ("short", True, 0)], "category string, listed boolean, pages int")
    got = {r["category"]: tuple(r)[1:] for r in scan.discover(first, pages).collect()}
    assert got["long"][0] == 100_000 and got["long"][1] <= 36 and got["short"] == (3, 6)


def reading(pages, empties, total):
    """The stop rule for one category, page by page: (stop, reason, complete)."""
    page, streak = 1, 0
    while True:
        if total is not None and page == total + 1:
            return page, "last", True
        row = pages.get(page)
        if row is None:
            return page, "missing", False
        n, marked, failed = row
        if marked:
            return page, "marked", True
        if failed:
            return page, "failed", False
        streak = streak + 1 if not n else 0
        if streak == empties:
            return page, "empty", True
        page += 1


@pytest.mark.parametrize("empties", [1, 2, 3])
def test_stop_rules_against_a_loop(spark, empties):
    rng = random.Random(empties)
    cats, totals = {}, {}
    for i in range(80):
        n = rng.randint(1, 12)
        cats[f"c{i}"] = {p: (rng.choice([0, 3, 5, 5]), rng.random() < 0.05, rng.random() < 0.05) for p in range(1, n + 1) if rng.random() > 0.04 or p == n}
        if i % 2:
            totals[f"c{i}"] = rng.randint(1, 14)
    rows = [(c, p, *row) for c, pages in cats.items() for p, row in pages.items()]
    frame = spark.createDataFrame(rows, "category string, page int, n_items int, marked boolean, failed boolean")
    known = spark.createDataFrame(list(totals.items()) + [("other", 3)], "category string, last_page int")
    for given, table in ((None, None), (totals, known)):
        got = {r["category"]: (r["stop"], r["reason"], r["complete"]) for r in scan.stops(frame, empties, table).collect()}
        assert got == {c: reading(pages, empties, (given or {}).get(c)) for c, pages in cats.items()}


def test_scan_keeps_what_it_cannot_tell(spark):
    """Marked ends, failures and their causes; a category that isn't scanned stays; the last listing of a URL counts; empty tables."""
    def parse(pages):
        return pages.selectExpr("url AS page_url", "posexplode(filter(split(html, ','), x -> x like 'http%')) AS (ord, url)").selectExpr("page_url", "url", "concat('n', page_url) AS name", "'$1' AS price", "'' AS sku", "'' AS img", "ord")

    pages = [("a", 1, "a1", "http://x/1,http://x/2"), ("a", 2, "a2", "nothing"), ("a", 3, "a3", "http://x/2,http://x/3"), ("a", 4, "a4", "END"), ("a", 5, "a5", "http://x/9"), ("b", 1, "b1", "http://y/1"), ("b", 2, "b2", None), ("b", 3, "b3", "http://y/2"), (None, 1, "z", "http://z/1"), ("d", None, "d", "http://d/1")]
    prev = [(c, u, "old", "$1", "", "", False) for c, u in (("a", "http://x/1"), ("a", "http://x/gone"), ("b", "http://y/gone"), ("c", "http://c/1"))]
    frames = spark.createDataFrame(prev, "category string, url string, name string, price string, sku string, img string, removed boolean"), spark.createDataFrame(pages, "category string, page int, url string, html string")
    merged, report, failures = scan.scan(*frames, parse, marked=lambda html: html == "END")
    got = {(r["category"], r["url"]): (r["name"], r["removed"], r["change"]) for r in merged.collect()}
    assert got == {
        ("a", "http://x/1"): ("na1", False, None), ("a", "http://x/2"): ("na3", False, "new"), ("a", "http://x/3"): ("na3", False, "new"), ("a", "http://x/gone"): ("old", True, "removed"),
        ("b", "http://y/1"): ("nb1", False, "new"), ("b", "http://y/gone"): ("old", False, None), ("c", "http://c/1"): ("old", False, None),
    }
    assert {tuple(r) for r in report.select("category", "stop", "reason", "complete", "pages_read", "listed").collect()} == {("a", 4, "marked", True, 3, 4), ("b", 2, "failed", False, 1, 1)}
    assert {tuple(r) for r in failures.collect()} == {("b", 2, "b2", "no text"), ("a", 2, "a2", "no listing")}
    none = [f.limit(0) for f in frames]
    assert [f.collect() for f in scan.scan(*none, parse)] == [[], [], []]
    assert {r["url"] for r in scan.scan(frames[0], none[1], parse)[0].collect()} == {u for _, u, *_ in prev}
