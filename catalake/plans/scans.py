"""Registered queries of paged scans, versions, kept indexes and edit logs, with their SQL.

Each store's or brand's rows are dealt into pages, so the page tables grow with lineitem and part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.seeded import random32
from ..operators import edits, index, linkage, scan
from ..session import broadcast_if_small, shared_folder
from ..sources import connectors as C
from ..sources.snapshots import listings
from ..sources.versions import KeptIndex, VersionStore
from .catalogue import L, _read, query
from .shops import _CENTS, _KEY, _PRICE, _WHOLE, _cut, _parts, _text

#: Listings of a page, here.
_SIZE = 24


@query(f"""WITH RECURSIVE c AS (
  SELECT 's' || l_suppkey AS category, (count(*) + {_SIZE} - 1) // {_SIZE} AS m FROM lineitem GROUP BY l_suppkey
), s AS (
  SELECT category, m, 1 AS lo, CAST(NULL AS BIGINT) AS hi, 5 AS gap, 20 AS probe, 1 AS probes FROM c WHERE category NOT LIKE '%3'
  UNION ALL
  SELECT category, m, CASE WHEN probe <= m THEN probe ELSE lo END, CASE WHEN probe > m THEN probe ELSE hi END, CASE WHEN hi IS NULL AND probe <= m THEN 2 * gap ELSE gap END,
    CASE WHEN hi IS NULL AND probe <= m THEN probe + gap ELSE (CASE WHEN probe <= m THEN probe ELSE lo END) + ((CASE WHEN probe > m THEN probe ELSE hi END) - (CASE WHEN probe <= m THEN probe ELSE lo END)) // 2 END, probes + 1
  FROM s WHERE hi IS NULL OR hi - lo > 1
)
SELECT category, CAST(m AS BIGINT) AS last_page, CAST(max(probes) AS BIGINT) AS probes FROM s WHERE hi - lo <= 1 GROUP BY 1, 2
UNION ALL SELECT category, CAST(m AS BIGINT), CAST(1 AS BIGINT) FROM c WHERE category LIKE '%3'""")
def category_page_counts(spark, sf_dir):
    """The last listing page of every store, found by probing all stores' pages at once; stores whose number ends in 3 have page links."""
    rows = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("category"), "l_orderkey", "l_partkey", "l_linenumber")
    # Places within a store come from counts of parts of it, so that a large store is no single task.
    part = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_linenumber"), F.lit(64))
    sizes = rows.groupBy("category", part.alias("part")).count()
    before = F.sum("count").over(Window.partitionBy("category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("category", F.coalesce(before, F.lit(0)).alias("begin"), F.col("count").alias("n"))
    span = F.sequence(F.floor(F.col("begin") / _SIZE), F.floor((F.col("begin") + F.col("n") - 1) / _SIZE))
    listed = offsets.select("category", F.explode(span).alias("at")).select("category", (F.col("at") + 1).alias("page")).distinct()
    last = listed.groupBy("category").agg(F.max("page").alias("m"))
    link = F.when(F.col("category").endswith("3"), F.concat(F.lit('<a class="page-numbers" href="/c/page/2/">2</a><a href="/c/page/'), F.col("m").cast("string"), F.lit('/">last</a>'))).otherwise("<p>more</p>")
    first = last.select("category", F.lit(True).alias("listed"), F.when(F.col("category").endswith("3") & (F.col("m") == 1), 1).otherwise(C.last_page(link)).alias("pages"))
    return scan.discover(first, listed)


def _shelf(spark, sf_dir):
    """Parts of each brand with their place in it, and the page that lists them: ten a page, one page without listings after the second, and the page behind two such ones for every 17th part."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    base = F.floor((F.row_number().over(w) - 1) / 10) + 1
    parts = _parts(spark, sf_dir).withColumn("late", F.col("p_partkey") % 17 == 0)
    placed = parts.where("not late").withColumn("base", base).withColumn("page", F.col("base") + (F.col("base") > 2).cast("int"))
    last = placed.groupBy("p_brand").agg(F.max("page").alias("last"))
    late = parts.where("late").join(last, "p_brand").withColumn("page", F.col("last") + 3)
    return placed.select("p_brand", "p_partkey", "p_name", "key", "amount", "page"), late.select("p_brand", "p_partkey", "p_name", "key", "amount", "page"), last


def _scanned(spark, sf_dir):
    placed, late, last = _shelf(spark, sf_dir)
    block = _text('<div class="tmb x"><h3 class="t-entry-title"><a href="/p/', "{key}", '">', "{p_name}", '</a></h3><span class="price"><bdi>$', "{amount}", "</bdi></span></div>")
    rows = placed.unionByName(late).groupBy(F.col("p_brand").alias("category"), "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))), lambda x: x["b"]), "").alias("html"))
    none = last.select(F.col("p_brand").alias("category"), F.explode(F.array(F.lit(3), F.col("last") + 1, F.col("last") + 2)).alias("page"), F.lit("<p>nothing</p>").alias("html"))
    pages = rows.unionByName(none.join(rows, ["category", "page"], "left_anti").distinct())
    # The second page of brands that end in 5 could not be fetched.
    broken = F.col("category").endswith("5") & (F.col("page") == 2)
    pages = pages.select("category", "page", F.concat_ws("/", F.lit("http://shop"), "category", "page").alias("url"), F.when(~broken, F.col("html")).alias("html"))
    url = lambda kind: F.concat(F.lit(f"https://sierraspringsliquor.ca/{kind}/"), "key")
    row = lambda kind, price: [F.col("p_brand").alias("category"), F.col("p_name").alias("name"), price.alias("price"), F.lit("").alias("sku"), url(kind).alias("url"), F.lit("").alias("img"), F.lit(False).alias("removed")]
    parts = _parts(spark, sf_dir)
    prev = parts.where("p_partkey % 3 = 0").select(*row("p", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$"), "amount")).otherwise("$1.00"))).unionByName(parts.where("p_partkey % 4 = 0").select(*row("old", F.lit("$2.00"))))
    return scan.scan(prev, pages, lambda p: C.parse_pages(p, "sierrasprings"))


_SHELF = f"""shelf AS (
  SELECT *, b + CAST(b > 2 AS INTEGER) AS page FROM (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 10 + 1 AS b FROM part WHERE p_partkey % 17 <> 0)
), scanned AS (
  SELECT p_brand AS category, 'https://sierraspringsliquor.ca/p/' || {_WHOLE} AS url, p_name AS name, {_PRICE} AS price FROM shelf WHERE p_brand NOT LIKE '%5' OR page < 2
), prev AS (
  SELECT p_brand AS category, 'https://sierraspringsliquor.ca/p/' || {_WHOLE} AS url, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN {_PRICE} ELSE '$1.00' END AS price FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_brand, 'https://sierraspringsliquor.ca/old/' || {_WHOLE}, p_name, '$2.00' FROM part WHERE p_partkey % 4 = 0
)"""


@query(f"""WITH {_SHELF}
SELECT category, url, coalesce(s.name, p.name) AS name, coalesce(s.price, p.price) AS price, s.url IS NULL AND category NOT LIKE '%5' AS removed,
  CASE WHEN s.url IS NULL THEN CASE WHEN category NOT LIKE '%5' THEN 'removed' END WHEN p.url IS NULL THEN 'new' WHEN s.price <> p.price THEN 'updated' END AS change
FROM scanned s FULL JOIN prev p USING (category, url)""")
def paged_scan_merge(spark, sf_dir):
    """From page rows to the merged snapshots of all brands: pages behind the stop don't count, and an unfetched page keeps what the scan can't tell."""
    merged, _, _ = _scanned(spark, sf_dir)
    return merged.select("category", "url", "name", "price", "removed", "change")


@query(f"""WITH {_SHELF}, l AS (SELECT p_brand, max(page) AS last, count(*) AS n, count(*) FILTER (WHERE page < 2) AS n1 FROM shelf GROUP BY 1)
SELECT p_brand AS category, CAST(CASE WHEN p_brand LIKE '%5' THEN 2 WHEN last = 2 THEN 4 ELSE last + 2 END AS BIGINT) AS stop, CASE WHEN p_brand LIKE '%5' THEN 'failed' ELSE 'empty' END AS reason, p_brand NOT LIKE '%5' AS complete,
  CAST(CASE WHEN p_brand LIKE '%5' THEN 1 ELSE last + 1 END AS BIGINT) AS pages_read, CAST(CASE WHEN p_brand LIKE '%5' THEN n1 ELSE n END AS BIGINT) AS listed FROM l""")
def paged_scan_report(spark, sf_dir):
    """Where and why the reading of each brand's pages ended."""
    return _scanned(spark, sf_dir)[1]


@query(f"""SELECT 'https://www.bcliquorstores.com/product/' || {_KEY} AS url, p_name AS name, {_PRICE} AS price, {_KEY} AS sku, p_brand AS category
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE place <= greatest((n - 5 + 23) // 24, 1) * 24""")
def search_scan_pages(spark, sf_dir):
    """All pages of a search by the number of hits that the first one names (here five too few); pages behind them don't count."""
    w = Window.partitionBy("p_brand")
    place = F.row_number().over(w.orderBy("p_partkey"))
    parts = _parts(spark, sf_dir, _cut).withColumn("page", F.floor((place - 1) / _SIZE) + 1).withColumn("n", F.count("*").over(w))
    hit = F.struct(F.struct(F.col("key").alias("sku"), F.col("p_name").alias("name"), F.col("amount").alias("currentPrice")).alias("_source"))
    total = F.when(F.col("category").endswith("1"), F.to_json(F.struct(F.struct((F.col("n") - 5).alias("value")).alias("total")))).otherwise(F.to_json(F.struct((F.col("n") - 5).alias("total"))))
    made = parts.groupBy(F.col("p_brand").alias("category"), "page", "n").agg(F.to_json(F.sort_array(F.collect_list(hit))).alias("hits"))
    body = F.concat(F.lit('{"hits":'), F.regexp_replace(total, r"\}$", ""), F.lit(',"hits":'), "hits", F.lit("}}"))
    bodies = made.select("category", "page", F.concat_ws("/", F.lit("http://api"), "category", "page").alias("url"), body.alias("body"))
    within = bodies.join(C.hit_pages(bodies, _SIZE), "category").where("page <= last_page")
    rows = C.parse_bcl(within.select("url", "body"))
    return rows.join(within.select(F.col("url").alias("page_url"), "category"), "page_url").select("url", "name", "price", "sku", "category")


# -- versions -----------------------------------------------------------------------------------------------

#: Days up to which the versions have the listings, and the brands of the first one.
_DAYS = ("1997-01-01", "1999-01-01", "2000-01-01")
_COLUMNS = ("name", "price", "sku", "url", "store_label", "removed", "price_num", "ts")


def _at(rows, day: str, version: int):
    """A version's rows: each brand's listings up to a day; the first version lacks brands that end in 2, later ones those that end in 4, and a brand that ends in 3 never changes."""
    still = F.when(F.col("category").endswith("3"), F.lit(_DAYS[0])).otherwise(F.lit(day)).cast("timestamp")
    lacks = "2" if version == 1 else "4"
    # No row is later than the day, which is known before the listings are joined.
    return rows.where((F.col("ts") < F.lit(day).cast("timestamp")) & (F.col("ts") < still) & ~F.col("category").endswith(lacks)).select(*_COLUMNS, F.col("category").alias("db_file"))


def _store(spark, sf_dir, versions: int) -> VersionStore:
    """The first versions of the listings, each with the files that differ from the one before."""
    store, rows = VersionStore(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"), listings(spark, sf_dir)
    for n, day in enumerate(_DAYS[:versions], 1):
        # A scan is stored, so that the comparison and the commit don't join the listings each for itself.
        scan = _at(rows, day, n)
        scan.write.parquet(f"{store.root}-scans/{n}")
        now = spark.read.schema(scan.schema).parquet(f"{store.root}-scans/{n}")
        different = broadcast_if_small(store.changed(n - 1, now))
        store.commit(now.join(different.where("status <> 'deleted'"), "db_file", "left_semi"), different.where("status = 'deleted'"), n - 1)
    return store


def _versions_sql() -> str:
    cut = lambda day, lacks: f"SELECT * FROM listings WHERE ts < CASE WHEN category LIKE '%3' THEN DATE '{_DAYS[0]}' ELSE DATE '{day}' END AND category NOT LIKE '%{lacks}'"
    return f"{L}, v1 AS ({cut(_DAYS[0], 2)}), v2 AS ({cut(_DAYS[1], 4)}), v3 AS ({cut(_DAYS[2], 4)})"


def _files_sql(old: str, new: str) -> str:
    differ = f"(SELECT category, count(*) AS n FROM (SELECT category, url FROM {old} UNION ALL SELECT category, url FROM {new}) GROUP BY category, url)"
    return f"""SELECT coalesce(o.category, n.category) AS db_file, CASE WHEN o.category IS NULL THEN 'added' WHEN n.category IS NULL THEN 'deleted' ELSE 'changed' END AS status
  FROM (SELECT DISTINCT category FROM {old}) o FULL JOIN (SELECT DISTINCT category FROM {new}) n USING (category)
  WHERE o.category IS NULL OR n.category IS NULL OR coalesce(o.category, n.category) IN (SELECT category FROM {differ} WHERE n % 2 = 1)"""


@query(f"""WITH {_versions_sql()}
SELECT 'root' AS step, category AS db_file, 'added' AS status FROM v1 GROUP BY category
UNION ALL SELECT 'versions', * FROM ({_files_sql("v1", "v2")})
UNION ALL SELECT 'uncommitted', * FROM ({_files_sql("v2", "v3")})""")
def version_store_changes(spark, sf_dir):
    """Changed files of the first version, between two versions, and of rows that aren't committed against the newest version."""
    store = _store(spark, sf_dir, 2)
    step = lambda name, rows: rows.select(F.lit(name).alias("step"), "db_file", "status")
    later = _at(listings(spark, sf_dir), _DAYS[2], 3)
    return step("root", store.changed(None, 1)).union(step("versions", store.changed(1, 2))).union(step("uncommitted", store.changed(2, later)))


@query(f"""WITH {_versions_sql()}, asked AS (SELECT DISTINCT p_brand AS db_file FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT db_file, db_file IN (SELECT category FROM v1) AS at_first, db_file IN (SELECT category FROM v2) AS at_second FROM asked""")
def version_store_exists(spark, sf_dir):
    """Which of some files two versions have."""
    store, part = _store(spark, sf_dir, 2), _read(spark, sf_dir, "part")
    asked = part.select(F.col("p_brand").alias("db_file")).union(part.select("p_type")).distinct()
    first = store.exists(asked, 1).withColumnRenamed("exists", "at_first")
    return store.exists(first, 2).withColumnRenamed("exists", "at_second")


@query(f"""WITH {_versions_sql()} SELECT 1 AS version, category AS db_file, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM v1 GROUP BY 2
UNION ALL SELECT 2, category, count(*), CAST(sum(cents) AS BIGINT) FROM v2 GROUP BY 2""")
def version_store_reads(spark, sf_dir):
    """Each version as it was, read after the next one was written."""
    store = _store(spark, sf_dir, 2)
    rows = store.read(1).withColumn("version", F.lit(1)).unionByName(store.read(2).withColumn("version", F.lit(2)))
    return rows.groupBy("version", "db_file").agg(F.count("*").alias("n"), F.sum(F.round(F.col("price_num") * 100).cast("long")).alias("cents"))


@query(f"WITH {_versions_sql()} SELECT sku, store_label, price_num FROM v3 WHERE NOT removed AND price_num > 0 QUALIFY row_number() OVER (PARTITION BY sku ORDER BY price_num, ts, url) = 1")
def kept_index_cheapest(spark, sf_dir):
    """The cheapest offers at the third version, from an index that was kept over the versions before."""
    store = _store(spark, sf_dir, 3)
    kept = KeptIndex(store, "cheapest", index.cheapest)
    for version in (1, 2):
        kept.load(version)
    return kept.load(3)


# -- edits and samples ----------------------------------------------------------------------------------------

_LOG = """log AS (
  SELECT user_id % 20 AS log, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'clear_submitted' WHEN event_id % 11 = 0 THEN 'clear' WHEN event_id % 5 = 0 THEN 'submit' ELSE 'add' END AS action,
    CASE WHEN event_id % 3 = 0 THEN 'ignore' ELSE 'link' END AS kind, 'k' || (user_id % 7) AS a, 'k' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 9) AS b FROM events
)"""


def _log(spark, sf_dir):
    e, i = _read(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(i % 97 == 0, "clear_submitted").when(i % 11 == 0, "clear").when(i % 5 == 0, "submit").otherwise("add")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long") % 9
    return e.select((F.col("user_id") % 20).alias("log"), i.alias("seq"), action.alias("action"), F.when(i % 3 == 0, "ignore").otherwise("link").alias("kind"), F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")).alias("a"), F.concat(F.lit("k"), k.cast("string")).alias("b"))


def _state_sql(at: str) -> str:
    return f"""SELECT log, status, kind, a, b, seq FROM (
  SELECT *, CASE WHEN ended IS NULL THEN 'pending' WHEN ended.action = 'submit' AND coalesce(ended.seq > wiped, true) THEN 'submitted' END AS status, CASE WHEN kind = 'link' OR a < b THEN a || '|' || b ELSE b || '|' || a END AS key
  FROM (SELECT l.*, (SELECT arg_min(c, c.seq) FROM log c WHERE c.log = l.log AND c.seq > l.seq AND c.seq <= {at} AND c.action IN ('submit', 'clear')) AS ended, (SELECT max(c.seq) FROM log c WHERE c.log = l.log AND c.seq <= {at} AND c.action = 'clear_submitted') AS wiped
    FROM log l WHERE l.seq <= {at} AND l.action = 'add' AND a <> b))
WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log, kind, key ORDER BY status = 'pending', seq) = 1"""


@query(f"WITH {_LOG} SELECT 'end' AS place, * FROM ({_state_sql('9223372036854775807')}) UNION ALL SELECT 'early', * FROM ({_state_sql('400')})")
def edit_log_state(spark, sf_dir):
    """Pending and submitted edits at the end of the log and after place 400."""
    log = _log(spark, sf_dir)
    return edits.state(log).withColumn("place", F.lit("end")).unionByName(edits.state(log, 400).withColumn("place", F.lit("early")))


def _draw_sql(seed: int, n: str) -> str:
    """The generator with whole numbers and remainders."""
    m = "4294967296"
    return f"""(SELECT CAST(xor(x2, x2 >> 14) AS BIGINT) FROM (SELECT xor(CAST((x1 + (CAST(xor(x1, x1 >> 7) AS HUGEINT) * (x1 | 61)) % {m}) % {m} AS BIGINT), x1) AS x2
      FROM (SELECT CAST((CAST(xor(t, t >> 15) AS HUGEINT) * (t | 1)) % {m} AS BIGINT) AS x1 FROM (SELECT CAST(({seed} + CAST({n} AS HUGEINT) * 1831565813) % {m} AS BIGINT) AS t))))"""


@query(f"SELECT 'k' || p_partkey AS sku, {_draw_sql(7, 'p_partkey')} AS draw FROM part ORDER BY draw, sku LIMIT 5000")
def seeded_sample(spark, sf_dir):
    """The report's sample of 5,000 items by their seeded draws."""
    items = _read(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("sku"), "p_partkey")
    return linkage.sampled(items, 5000, 7, "p_partkey").select("sku", random32(7, F.col("p_partkey")).alias("draw"))
