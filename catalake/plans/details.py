"""Registered queries of item pages, key and text variants, page addresses and the difference report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import sku as S
from ..functions import text as X
from ..functions import url as U
from ..functions.codes import SOCIETY_CODES
from ..operators import diff, index, linkage, report, search, series
from ..sources import snapshots as snap
from ..sources.snapshots import listings
from .catalogue import _FNV, _LINKS, _LINKS_WHOLE, VERSIONS, L, _links, _read, _versions, query

# -- item pages ---------------------------------------------------------------------------------------------


@query(f"""WITH {L}, last AS (SELECT * FROM listings QUALIFY row_number() OVER (PARTITION BY sku, store_label ORDER BY ts DESC, NOT removed DESC, url DESC) = 1)
SELECT sku, CAST(row_number() OVER (PARTITION BY sku ORDER BY removed, store_label) AS INTEGER) AS place, store_label, removed, url FROM last""")
def store_links(spark, sf_dir):
    return index.store_links(listings(spark, sf_dir))


@query(f"""WITH {L}, g AS (SELECT sku, coalesce(arg_min(store_label, (price_num, ts, url)) FILTER (WHERE NOT removed), arg_min(store_label, (ts, url))) AS store,
  coalesce(arg_min(url, (price_num, ts, url)) FILTER (WHERE NOT removed), arg_min(url, (ts, url))) AS sample FROM listings GROUP BY 1),
u AS (SELECT sku, store_label, coalesce(arg_min(url, (ts, url)) FILTER (WHERE NOT removed), arg_min(url, (ts, url))) AS url FROM listings GROUP BY 1, 2)
SELECT g.sku, coalesce(u.url, sample, '') AS url FROM g LEFT JOIN u ON u.sku = g.sku AND u.store_label = store""")
def display_url(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return index.display_url(index.catalogue(rows), index.first_url(rows, ["sku", "store_label"]))


_SHOTS = """i AS (SELECT user_id AS sku, event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'img' || event_id ELSE ' ' END AS img, event_type = 'error' OR user_id % 4 = 0 AS removed,
  CASE WHEN user_id % 3 = 0 THEN value END AS price, ts, event_id AS url FROM events)"""


def _shots(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    img = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("img"), F.col("event_id").cast("string"))).otherwise(" ")
    gone = (F.col("event_type") == "error") | (F.col("user_id") % 4 == 0)
    return e.select(F.col("user_id").alias("sku"), F.col("event_type").alias("name"), img.alias("img"), gone.alias("removed"), F.when(F.col("user_id") % 3 == 0, F.col("value")).alias("price_num"), "ts", F.col("event_id").alias("url"))


@query(f"""WITH {_SHOTS}, c AS (SELECT sku, name, count(*) AS n, count(*) FILTER (WHERE NOT removed) AS nl, arg_min((epoch_us(ts), url), (ts, url)) AS f, arg_min((epoch_us(ts), url), (ts, url)) FILTER (WHERE NOT removed) AS fl FROM i GROUP BY 1, 2),
m AS (SELECT sku, CASE WHEN max(nl) > 0 THEN arg_max(name, (nl, -coalesce(fl, f)[1])) ELSE arg_max(name, (n, -f[1])) END AS best, max(nl) > 0 AS live FROM c GROUP BY 1),
b AS (SELECT i.*, best, live FROM i JOIN m ON i.sku = m.sku WHERE NOT live OR NOT removed)
SELECT sku, coalesce(arg_min(img, (price, ts, url)) FILTER (WHERE img <> ' ' AND price IS NOT NULL), arg_min(img, (ts, url)) FILTER (WHERE img <> ' ' AND name = best), arg_min(img, (ts, url)) FILTER (WHERE img <> ' '), '') AS img FROM b GROUP BY 1""")
def page_thumbnail(spark, sf_dir):
    rows = _shots(spark, sf_dir)
    return index.thumbnail(rows, index.name_mode(rows))


@query("""WITH v AS (SELECT user_id AS sku, ts, min(value) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS lp, min(value) FILTER (WHERE event_type IN ('error', 'purchase')) AS rp FROM events GROUP BY 1, 2),
d AS (SELECT sku, ts::DATE AS day, arg_max(struct_pack(l := lp, r := rp), ts) AS e, arg_max(lp, ts) FILTER (WHERE lp IS NOT NULL) AS price FROM v GROUP BY 1, 2)
SELECT sku, CAST(day AS VARCHAR) AS day, price FROM d WHERE e.l IS NULL AND e.r IS NOT NULL AND price IS NOT NULL""")
def last_live_of_day(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("sku"), "ts", F.col("value").alias("price_num"), F.col("event_type").isin("error", "purchase").alias("removed"))
    return series.last_live_of_day(rows, ["sku"]).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {L}, {_LINKS}, g AS (SELECT sku, count(DISTINCT store_label) FILTER (WHERE NOT removed) AS c FROM listings GROUP BY 1)
SELECT sku, round(2.0 * c + 1.2 + 1.0, 6) AS score FROM g WHERE sku NOT IN (SELECT from_sku FROM links UNION SELECT to_sku FROM links) AND sku <> '000002' ORDER BY score DESC, sku LIMIT 50""")
def unmapped_suggestions(spark, sf_dir):
    mapped = linkage.mapped_keys(_links(spark, sf_dir))
    return index.top_suggestions(index.catalogue(listings(spark, sf_dir)), 50, mapped, "000002").select("sku", "score")


@query(f"WITH {L}, {_LINKS}, s AS (SELECT sku, list(DISTINCT store_label) AS stores FROM listings WHERE NOT removed GROUP BY 1) SELECT from_sku AS a, to_sku AS b, list_has_any(x.stores, y.stores) AS overlap FROM links JOIN s x ON x.sku = from_sku JOIN s y ON y.sku = to_sku")
def store_overlap_whole(spark, sf_dir):
    return linkage.store_overlap(_links(spark, sf_dir).toDF("a", "b"), index.availability(listings(spark, sf_dir)).select("sku", "stores"))


@query(f"WITH {_LINKS_WHOLE} SELECT from_sku, max(to_sku) AS to_sku FROM links GROUP BY 1")
def directed_links(spark, sf_dir):
    return linkage.directed(_links(spark, sf_dir, snap.part_key), "to_sku")


@query(f"WITH {L} SELECT sku, store_label, url, price FROM listings QUALIFY row_number() OVER (PARTITION BY sku, store_label ORDER BY ts, url) = 1")
def first_wins(spark, sf_dir):
    rows = listings(spark, sf_dir).select("sku", "store_label", "price", F.struct("ts", "url").alias("at"))
    return snap.first_wins(rows, ["sku", "store_label"], "at").select("sku", "store_label", "at.url", "price")


# -- keys, prices, texts and addresses ------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS six, p_brand || '|http://x.example/' || p_partkey AS s FROM part),
k AS (SELECT p_partkey, p_partkey % 4 AS m, six, 'u:' || lower(lpad(printf('%x', ({_FNV})::BIGINT), 8, '0')) AS made FROM p)
SELECT p_partkey, CASE m WHEN 0 THEN six WHEN 1 THEN 'u:' || six || 'ab' ELSE made END AS stored, CASE m WHEN 0 THEN six ELSE made END AS compared,
  CASE m WHEN 0 THEN 'code ' || six WHEN 1 THEN 'u:' || six || 'ab' WHEN 2 THEN 'x' ELSE made END AS raw, CASE m WHEN 0 THEN six ELSE 'unknown' END AS shown FROM k""")
def key_variants(spark, sf_dir):
    six, m = F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.col("p_partkey") % 4
    value = F.when(m == 0, F.concat(F.lit(" code "), six)).when(m == 1, F.concat(F.lit("u:"), six, F.lit("ab"))).when(m == 2, " x ").otherwise("")
    args = value, F.col("p_brand"), F.concat(F.lit("http://x.example/"), F.col("p_partkey").cast("string"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", S.stored_key(*args).alias("stored"), S.diff_key(*args).alias("compared"), S.raw_key(*args).alias("raw"))
    return rows.withColumn("shown", S.display(F.col("stored")))


@query("""WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders), t AS (SELECT *, '$' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS plain FROM c)
SELECT o_orderkey, plain, '$' || format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS grouped, plain[2:] AS first, CASE WHEN o_orderkey % 2 = 0 THEN cents / 100 END AS loose,
  greatest(1000, least(99999, cents // 100)) AS clamped FROM t""")
def price_texts(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", (F.round(F.col("o_totalprice") * 100) / 100).alias("amount"))
    grouped = P.to_text(F.col("amount"), True)
    said = F.concat(F.lit("was "), grouped, F.lit(" now $1.00"))
    loose = P.to_number(F.when(F.col("o_orderkey") % 2 == 0, P.to_text(F.col("amount"))), None)
    whole = F.concat(F.lit(" "), F.floor("amount").cast("string"), F.lit("px"))
    return orders.select("o_orderkey", P.to_text(F.col("amount")).alias("plain"), grouped.alias("grouped"), P.first_amount(said).alias("first"), loose.alias("loose"), P.clamped(whole, 7, 1000, 99999).alias("clamped"))


@query("SELECT p_partkey, CASE WHEN length(p_brand) < 9 THEN rpad(p_brand, 9, ' ') ELSE p_brand END || '|' AS right_filled, '|' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 3 THEN lpad(CAST(p_partkey AS VARCHAR), 3, ' ') ELSE CAST(p_partkey AS VARCHAR) END AS left_filled FROM part")
def padded_text(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(X.padded(F.col("p_brand"), 9), F.lit("|")).alias("right_filled"), F.concat(F.lit("|"), X.padded(F.col("p_partkey").cast("string"), 3, left=True)).alias("left_filled"))


@query("""SELECT page_id, 'https://s' || page_id || '.example/wp-json/wc/store/v1/products?order=desc&orderby=date' || CASE WHEN page_id % 2 = 0 THEN '&stock_status=instock' ELSE '' END
  || CASE WHEN page_id % 3 = 0 THEN '&min_price=' || page_id || '&max_price=' || (page_id + 10) ELSE '' END AS api,
  'https://s' || page_id || '.example/c/?a=1&page=' || greatest(1, page_id % 4) AS by_parameter, 'https://s' || page_id || '.example/c/?a=1&pg=' || greatest(1, page_id % 4) || '&z=2' AS in_place FROM pages""")
def category_addresses(spark, sf_dir):
    page = F.col("page_id").cast("string")
    site = F.concat(F.lit("https://S"), page, F.lit(".example"))
    stock = F.when(F.col("page_id") % 2 == 0, "&_sfm__stock_status=InStock").otherwise("")
    span = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("&_sfm__regular_price="), page, F.lit("%2B"), (F.col("page_id") + 10).cast("string"))).otherwise("")
    at, low = (F.col("page_id") % 4).cast("int"), F.lower(site)
    api = U.store_api(F.concat(site, F.lit(":8080/c/?q=1"), stock, span))
    return _read(spark, sf_dir, "pages").select("page_id", api.alias("api"), U.page_by_parameter(F.concat(low, F.lit("/c?a=1#x")), at).alias("by_parameter"), U.page_by_parameter(F.concat(low, F.lit("/c/?a=1&pg=9&z=2")), at, "pg").alias("in_place"))


_CODES = ", ".join("('{}', '{}')".format(*line.replace("'", "''").split(" ", 1)) for line in SOCIETY_CODES.strip().splitlines())


@query(f"""WITH c(code, label) AS (VALUES {_CODES}), n AS (SELECT code, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM c),
i AS (SELECT 'k' || p_partkey AS sku, p_name || ' ' || (p_partkey % 165 + 1) || '.' || p_size AS name FROM part)
SELECT sku, name, code, label FROM i JOIN n ON code = regexp_extract(name, '([0-9]+)[.][0-9]+$', 1) WHERE starts_with(norm, 'glen')""")
def society_prefix_items(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", F.concat((F.col("p_partkey") % 165 + 1).cast("string"), F.lit("."), F.col("p_size").cast("string")))
    items = _read(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("sku"), name.alias("name"))
    coded = items.withColumn("code", F.regexp_extract("name", r"([0-9]{1,3})\.[0-9]{1,4}", 1))
    return coded.join(F.broadcast(search.expand_prefix(search.society_codes(spark), "Glen", "label")), "code").select("sku", "name", "code", "label")


@query(f"""WITH c(code, label) AS (VALUES {_CODES}), n AS (SELECT code, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM c),
i AS (SELECT 'k' || p_partkey AS sku, p_name || ' ' || CASE WHEN p_size % 2 = 0 THEN code || '.' || p_size ELSE label END AS name FROM part JOIN n ON code = CAST(p_partkey % 165 + 1 AS VARCHAR)),
r AS (SELECT sku, name, CASE WHEN contains(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), 'glen') THEN 0 WHEN regexp_extract(name, '([0-9]{{1,3}})[.][0-9]{{1,4}}', 1) IN (SELECT code FROM n WHERE starts_with(norm, 'glen')) THEN 1 END AS priority FROM i)
SELECT sku, name, priority FROM r WHERE priority IS NOT NULL""")
def search_with_codes(spark, sf_dir):
    codes = search.society_codes(spark)
    named = F.when(F.col("p_size") % 2 == 0, F.concat_ws(".", "code", F.col("p_size").cast("string"))).otherwise(F.col("label"))
    items = _read(spark, sf_dir, "part").withColumn("code", (F.col("p_partkey") % 165 + 1).cast("string")).join(F.broadcast(codes), "code")
    items = items.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("sku"), F.concat_ws(" ", "p_name", named).alias("name")).withColumn("search_text", F.col("name"))
    return search.search_with_codes(items, codes, "Glen").select("sku", "name", "priority")


# -- the difference report ------------------------------------------------------------------------------------

_OFF = "CAST(floor((o - w) / o * 100 + 0.5) AS INTEGER)"


@query(f"""WITH {VERSIONS}, j AS (SELECT coalesce(p.sku, n.sku) AS sku, coalesce(p.store_label, n.store_label) AS store_label, p.price AS old_price, n.price AS new_price, p.removed AS r0, n.removed AS r1, coalesce(n.name, p.name) AS name, coalesce(n.category, p.category) AS category, 'http://' || coalesce(p.sku, n.sku) AS url
  FROM prev p FULL JOIN now n ON p.sku = n.sku AND p.store_label = n.store_label),
d AS (SELECT *, CASE WHEN r0 IS NULL AND NOT r1 THEN 'new' WHEN r0 AND NOT r1 THEN 'restored' WHEN NOT r0 AND coalesce(r1, true) THEN 'removed' WHEN NOT r0 AND NOT r1 AND old_price <> new_price THEN 'updated' END AS change FROM j),
x AS (SELECT *, store_label || ' | ' || category AS label, CAST(replace(old_price, '$', '') AS DOUBLE) AS o, CAST(replace(new_price, '$', '') AS DOUBLE) AS w, list_position(['new', 'restored', 'removed', 'updated'], change) - 1 AS section FROM d WHERE change IS NOT NULL),
z AS (SELECT greatest(max(length(label)), 16) AS width FROM x),
h AS (SELECT section, '' AS label, '' AS name, '' AS url, 0 AS half, ['NEW', 'RESTORED', 'REMOVED', 'PRICE CHANGES'][section + 1] || ' (' || count(*) || ')' AS line FROM x GROUP BY section)
SELECT CAST(section AS INTEGER) AS section, label, name, url, half, line FROM h UNION ALL
SELECT CAST(section AS INTEGER), label, name, url, 1, ['+', 'R', '-', '~'][section + 1] || ' ' || rpad(label, CAST(width AS INTEGER), ' ') || ' | ' || name || ' ' || sku || '  '
  || CASE section WHEN 3 THEN old_price || ' -> ' || new_price || CASE WHEN w < o AND {_OFF} > 0 THEN ' [' || {_OFF} || '% Off]' ELSE '' END WHEN 2 THEN old_price ELSE new_price END FROM x, z UNION ALL
SELECT CAST(section AS INTEGER), label, name, url, 2, '  ' || url FROM x""")
def diff_report(spark, sf_dir):
    prev, now = _versions(spark, sf_dir)
    changes = diff.by_url(prev, now, ["sku", "store_label"], also=["category"]).withColumn("url", F.concat(F.lit("http://"), "sku"))
    return report.diff_lines(changes)
