"""Merges, differences, components, rules, connectors, files and streams on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from catalake.operators import diff, feed, index, linkage, merge, rules, search, series
from catalake.operators.components import connected_components
from catalake.plans import catalogue
from catalake.sources import connectors as C
from catalake.sources import snapshots
from catalake.streaming import incremental

ROW = "name string, price string, sku string, url string, img string, removed boolean"


def row(url, price="$10", sku="", name="N", img="", removed=False):
    return (name, price, sku, url, img, removed)


CASES = {
    "new": ([], [row("u1")], {"u1": (False, "new")}),
    "same": ([row("u1")], [row("u1")], {"u1": (False, None)}),
    "white space": ([row("u1", "$10")], [row("u1", "$ 10")], {"u1": (False, None)}),
    "updated": ([row("u1", "$10")], [row("u1", "$8")], {"u1": (False, "updated")}),
    "removed": ([row("u1")], [], {"u1": (True, "removed")}),
    "restored": ([row("u1", sku="111111", img="a", removed=True)], [row("u1")], {"u1": (False, "restored")}),
    "moved": ([row("u1", sku="111111")], [row("u2", sku="111111")], {"u2": (False, "moved")}),
    "moved and cheaper": ([row("u1", "$10", "111111")], [row("u2", "$9", "111111")], {"u2": (False, "updated")}),
    "removed at another address": ([row("u1", sku="111111", removed=True)], [row("u2", sku="111111")], {"u1": (True, None), "u2": (False, "new")}),
    "both addresses": ([row("u1", sku="111111")], [row("u1", sku="111111"), row("u2", sku="111111")], {"u1": (False, None), "u2": (False, "new")}),
    "data image": ([row("u1", img="a")], [row("u1", img="data:x")], {"u1": (False, None)}),
    "stays removed": ([row("u1", removed=True)], [], {"u1": (True, None)}),
    "renamed": ([row("u1", name="N")], [row("u1", name="M")], {"u1": (False, None)}),
}


@pytest.mark.parametrize("name", CASES)
def test_merge_cases(spark, name):
    prev, scan, want = CASES[name]
    got = merge.merge(spark.createDataFrame(prev, ROW), spark.createDataFrame(scan, ROW)).collect()
    assert {r["url"]: (r["removed"], r["change"]) for r in got} == want and len(got) == len(want)
    by = {r["url"]: r for r in got}
    if name == "restored":
        assert (by["u1"]["sku"], by["u1"]["img"]) == ("111111", "a")
    if name == "renamed":
        assert by["u1"]["name"] == "M"
    if name == "data image":
        assert by["u1"]["img"] == "a"


def test_merge_of_an_incomplete_scan_removes_nothing(spark):
    got = merge.merge(spark.createDataFrame([row("u1"), row("u2")], ROW), spark.createDataFrame([row("u2", "$9")], ROW), complete=False).collect()
    assert {r["url"]: (r["removed"], r["change"]) for r in got} == {"u1": (False, None), "u2": (False, "updated")}


def test_differences(spark):
    schema = "sku string, url string, name string, price string, removed boolean, ts int"
    a = spark.createDataFrame([("1", "a", "n", "$5", False, 1), ("2", "b", "n", "$5", False, 1), ("3", "c", "n", "$5", True, 1), ("4", "d", "n", "$5", False, 1)], schema)
    b = spark.createDataFrame([("1", "a", "n", "$4", False, 2), ("3", "c", "n", "$5", False, 2), ("4", "d", "n", "$5", True, 2), ("4", "e", "n", "$6", False, 1), ("5", "f", "n", "$1", False, 2)], schema)
    assert {r["sku"]: r["change"] for r in diff.by_key(a, b, ["sku"]).collect()} == {"1": "price_down", "2": "removed", "3": "restored", "4": "price_up", "5": "new"}
    assert {r["url"]: r["change"] for r in diff.by_url(a, b).collect()} == {"a": "updated", "b": "removed", "c": "restored", "d": "removed", "e": "new", "f": "new"}
    assert diff.by_key(a, a, ["sku"]).count() == 0 and diff.by_url(a, a).count() == 0
    assert {(r["sku"], r["change"], r["pct"]) for r in diff.drops(a, b, ["sku"]).collect()} == {("1", "drop", 20), ("3", "new", None), ("5", "new", None)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (7, 7), (3, 9), (None, 4)] + [(100 + i, 101 + i) for i in range(70)]
    random.seed(2)
    random.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 7} | {100 + i: 100 for i in range(71)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_representatives(spark):
    links = spark.createDataFrame([("u:aa", "200000"), ("200000", "100000"), ("u:b", "u:a")], "from_sku string, to_sku string")
    got = {r["sku"]: r["canonical"] for r in linkage.canonical_map(links).collect()}
    assert got == {"u:aa": "100000", "200000": "100000", "100000": "100000", "u:b": "u:a", "u:a": "u:a"}


def test_removal_gaps(spark):
    rows = [("k", d, live, gone) for d, live, gone in [(1, 10.0, None), (2, 10.0, None), (3, None, 9.0), (4, None, 9.0), (5, 8.0, None), (7, None, 8.0)]]
    points = spark.createDataFrame(rows, "k string, day int, live_price double, removed_price double")
    got = [r["price"] for r in series.with_gaps(points, ["k"]).orderBy("day").collect()]
    assert got == [10, 10, 9, None, 8, 8]


def test_rules(spark):
    old = spark.createDataFrame([("a", "b")], "from_sku string, to_sku string")
    new = spark.createDataFrame([("a", "b"), ("c", "d"), ("c", "d"), ("e", "e"), ("", "x")], "from_sku string, to_sku string")
    once = rules.insert_absent(old, new, "from_sku", "to_sku", True)
    assert sorted(map(tuple, once.collect())) == [("a", "b"), ("c", "d")]
    assert sorted(map(tuple, rules.insert_absent(once, new, "from_sku", "to_sku", True).collect())) == [("a", "b"), ("c", "d")]
    body = '<!-- shop-edits:BEGIN -->\n{"schema":"shop-edits-v1","links":[{"fromSku":"1","toSku":"2"},{"fromSku":"3","toSku":"3"}],"ignores":[]}\n<!-- shop-edits:END -->'
    parsed = rules.parse_edits(spark.createDataFrame([(f"text {body} more",), (body.replace("v1", "v9"),), (body.replace("shop-edits:", "other:"),), ("nothing",), (None,)], "body string"), "shop-edits", "shop-edits-v1")
    assert sorted(map(tuple, rules.edited_links(parsed).collect())) == [("1", "2")]


def woo(link, title, price, extra=""):
    return f'<li class="product type-product {extra}"><a href="{link}" class="woocommerce-LoopProduct-link"><h2 class="woocommerce-loop-product__title">{title}</h2><img data-src="/i.jpg" src="data:image/gif;base64,x"></a><span class="price"><span class="woocommerce-Price-amount"><bdi>$9.00</bdi></span> {price}</span><a data-product_sku="123456"></a></li>'


def test_page_connectors(spark):
    amount = '<ins><span class="woocommerce-Price-amount"><bdi><span class="sym">$</span>24.05</bdi></span></ins>'
    pages = {
        "sierrasprings": '<div class="tmb x"><h3 class="t-entry-title h"><a href="/p/one">One &amp; <b>only</b></a></h3><span class="price">' + amount + '</span><a data-product_sku="111111"></a></div>',
        "kegncork": '<li class="product"><h4 class="card-title"><a href="https://k/x">Keg</a></h4><span data-product-price-without-tax class="p"> 12.50 </span></li>',
        "maltsandgrains": woo("/product/a", "Malt", amount, "product_cat-gin") + woo("/product/b", "Gone", amount, "outofstock"),
        "gull": woo("/g", "Gull", amount + '<span class="woocommerce-Price-amount"><bdi>$0.10</bdi></span><i class="in-stock"></i>') + woo("/h", "Out", amount + '<i class="outofstock"></i>'),
        "kwm": '<div class="product-wrap"><div><a class="product-link" href="/products/123456-x"></a></div><h6> Ken </h6><div class="product-price"><div><span class="strike">$50.00</span> $40.00</div></div></div><div class="product-wrap">OUT OF STOCK</div>',
        "craftcellars": "<ul>" + '<li><a href="/products/c?v=1">Craft</a> Regular price $9.00 Sale price $8.00</li>' * 2 + "</ul>",
        "strath": '<article class="instock"><a href="/s"></a><h2 class="product-title">Strath</h2><h3 class="product-subtitle">12</h3><div class="whiskyfolk-price">$1.00</div><ins>now $1,030.00</ins> SKU: 654321</article>',
    }
    want = {
        "sierrasprings": ("https://sierraspringsliquor.ca/p/one", "One & only", "$24.05", "111111"), "kegncork": ("https://k/x", "Keg", "$12.50", ""), "maltsandgrains": ("https://maltsandgrains.store/product/a", "Malt", "$24.05", "123456"),
        "gull": ("https://gullliquorstore.com/g", "Gull", "$24.05", "123456"), "kwm": ("https://kensingtonwinemarket.com/products/123456-x", "Ken", "$40.00", "123456"), "craftcellars": ("https://craftcellars.ca/products/c", "Craft", "$8.00", ""),
        "strath": ("https://www.strathliquor.com/s", "Strath - 12", "$1030.00", "654321"),
    }
    for store, html in pages.items():
        table = spark.createDataFrame([("http://page", html), ("http://none", None)], "url string, html string")
        got = [(r["url"], r["name"], r["price"], r["sku"]) for r in C.parse_pages(table, store).collect()]
        assert got == [want[store]], store
    malts = C.parse_pages(spark.createDataFrame([("p", pages["maltsandgrains"])], "url string, html string"), "maltsandgrains")
    assert malts.first()["img"] == "https://maltsandgrains.store/i.jpg" and C.exclude_categories(malts).count() == 0


def test_json_connectors(spark):
    body = lambda x: spark.createDataFrame([("u", json.dumps(x)), ("v", "broken"), ("w", None)], "url string, body string")
    hits = [{"_source": {"sku": "123456", "name": "A", "currentPrice": 10, "regularPrice": "12", "status": "In stock"}}, {"_source": {"sku": "1", "name": "B", "availability": "Out of stock"}}, {"_source": {"sku": "2", "name": "C", "regularPrice": 5, "availableUnits": 0}}]
    assert [(r["name"], r["price"], r["sku"]) for r in C.parse_bcl(body({"hits": {"total": 3, "hits": hits}})).collect()] == [("A", "$10.00", "123456")]
    bsw = [{"title": "T", "handle": "/h", "price_cents": 1250}, {"name": "N", "url": "http://n", "price": 123400}, {"name": "M", "url": "http://m", "variants": [{"price": "9.5"}]}, {"handle": "x"}]
    assert [(r["name"], r["url"], r["price"]) for r in C.parse_bsw(body({"results": [{"hits": bsw}]})).orderBy("ord").collect()] == [("T", "https://www.bswliquor.com/products/h", "$12.50"), ("N", "http://n", "$1234.00"), ("M", "http://m", "$9.50")]
    legacy = [{"slug": "s", "name": "L", "priceFrom": 3, "variants": [{"quantity": 0, "price": 1}, {"quantity": 2, "shortName": "750"}]}, {"slug": "t", "variants": []}]
    assert [(r["name"], r["price"]) for r in C.parse_legacy(body({"data": {"products": {"items": legacy}}}), "rum").collect()] == [("L | 750", "$3.00")]
    api = [{"id": 1, "name": "W &#8211; <em>x</em>", "permalink": "http://w", "sku": "123456", "prices": {"sale_price": "", "regular_price": "11035", "currency_minor_unit": 2}, "categories": [{"slug": "Rum"}], "images": [{"src": "//i"}]}]
    got = C.parse_store_api(body(api), "rum").collect()
    assert [(r["name"], r["price"], r["sku"], r["img"]) for r in got] == [("W – x", "$110.35", "123456", "https://i")]
    assert C.parse_store_api(body(api), "gin").count() == 0


def listed(spark, html, store):
    rows = C.parse_pages(spark.createDataFrame([("p", html)], "url string, html string"), store).orderBy("ord").collect()
    return [(r["url"].rsplit("/", 1)[1], r["name"], r["price"], r["img"]) for r in rows]


def test_cards_where_a_page_has_few_list_items(spark):
    card = lambda k, inner="": f'<div class="card x"><div class="in"><img src="/{k}.jpg"><a href="/products/{k}?v=1"><span>Name {k}</span><b>new</b></a></div>{inner}<div>Regular price $9.00</div><p>Sale price $8.0{k}</p></div>'
    want = lambda *ks: [(str(k), f"Name {k}", f"$8.0{k}", f"https://craftcellars.ca/{k}.jpg") for k in ks]
    items = "".join(f'<li><a href="/products/{k}">Item {k}</a> $7.00</li>' for k in range(5))
    few = items.replace("<li>", "<p>").replace("</li>", "</p>")
    assert listed(spark, card(1) + card(2) + "<div>$1.00</div>", "craftcellars") == want(1, 2)
    # A nested card is a listing of its own; cards that never end are read up to the next one.
    assert [r[:3] for r in listed(spark, f'<div class="card-wrapper">{card(1)}{card(2)}</div>', "craftcellars")] == [r[:3] for r in want(1, 2)]
    assert [r[0] for r in listed(spark, '<div class="card"><a href="/products/1">One</a><div class="card"><a href="/products/2">Two</a>', "craftcellars")] == ["1", "2"]
    # Five list items go before cards, and only four of them don't.
    assert [r[1] for r in listed(spark, items + card(9), "craftcellars")] == [f"Item {k}" for k in range(5)]
    assert [r[1] for r in listed(spark, items[: items.rindex("<li>")] + card(9), "craftcellars")] == ["Name 9"]
    # Only the grid counts where it lists something, by depth and not up to its first end tag.
    assert listed(spark, f'<div id="ProductGridContainer"><div></div>{card(1)}{card(2)}</div>{card(3)}', "craftcellars") == want(1, 2)
    assert listed(spark, f'<div id="product-grid"><div>none</div></div>{card(3)}', "craftcellars") == want(3)
    assert listed(spark, few, "craftcellars") == []
    heading = '<div class="card"><a href="/products/1"></a><h3><a href="/products/1">Head</a></h3></div><div class="card"><span data-x="1" href="/products/2"></span></div>'
    assert [r[:2] for r in listed(spark, heading, "craftcellars")] == [("1", "Head")]


def test_balanced_in_linear_work(spark):
    text = "<div>" * 20_000 + "x" * 100_000 + "</div>" * 20_001 + "tail"
    rows = spark.createDataFrame([(text,), ("a</div>b",), ("<div>a</div>",), ("",), (None,), ("<divide>a</DIV>",)], "t string")
    got = [r[0] for r in rows.select(C.balanced(F.col("t"), "div")).collect()]
    assert got == [text[: -len("</div>tail")], "a", None, None, None, "<divide>a"]


def test_stock_marks(spark):
    blocks = {
        "gull": [('<i class="in-stock">', True), ('<i class="InStock">', True), ("<p> 12  in stock </p>", True), ("12 in stock", False), ('<i class="in-stock outofstock">', False), ("", False)],
        "strath": [('<a class="instock">', True), ("10+ Bottles  Available", True), ("bottles remaining", True), ("Only 3 bottle left", True), ("instock Currently\nUnavailable", False), ("x", False)],
        "kwm": [("x", True), ("Out of stock", False)],
        "maltsandgrains": [('<li class="product"><i class="outofstock">', True), ('<li class="product outofstock">', False), ("<b> Out Of Stock </b>", False), ('<li class="a"><i class="ast-shop-product-out-of-stock">', False)],
        "sierrasprings": [("outofstock", True)],
    }
    for store, cases in blocks.items():
        rows = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "i int, t string")
        assert [r[0] for r in rows.orderBy("i").select(C.STOCK.get(store, C.Stock()).there(F.col("t"))).collect()] == [there for _, there in cases], store


def test_result_images(spark):
    shapes = [
        ({"image": "//c/a.jpg"}, "https://c/a.jpg"), ({"image": "", "imageURL": "http://c/b.jpg"}, "http://c/b.jpg"), ({"imageUrl": "/u.jpg", "imageURL": "/v.jpg"}, "https://www.bswliquor.com/u.jpg"),
        ({"featuredImage": {"src": " ", "original_src": "/c.jpg", "small": "/d.jpg"}}, "https://www.bswliquor.com/c.jpg"), ({"image": {"alt": "x"}, "thumbnailUrl": "/e.jpg"}, "https://www.bswliquor.com/e.jpg"),
        ({"images": ["", {"width": 3}, {"secure_url": "http://c/f.jpg"}, "/g.jpg"]}, "http://c/f.jpg"), ({"images": [], "media": ["/h.jpg"]}, "https://www.bswliquor.com/h.jpg"), ({"images": "none", "media": [{"large": "/i.jpg"}]}, "https://www.bswliquor.com/i.jpg"), ({}, ""),
    ]
    hits = [{"title": "T", "handle": str(i), "SKU": "123456", "price": "$1.00"} | shape for i, (shape, _) in enumerate(shapes)]
    bodies = spark.createDataFrame([("u", json.dumps({"results": [{"hits": hits}]}))], "url string, body string")
    got = C.parse_bsw(bodies).orderBy("ord").collect()
    assert [r["img"] for r in got] == [img for _, img in shapes] and {r["sku"] for r in got} == {"123456"}


def test_collection_numbers(spark):
    texts = ["?f=collection_ids%3A123456", "collection_ids : 234567", '"collection_ids":345678', '{"collection_id" : 456789}', "collection_id = 567890", "collectionId='678901'", '"collectionId": "789012"', '<i data-collection-id="890123">', "collection_id=12345", 'collectionId:111111 "collection_ids": 222222', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(C.collection_id(F.col("t"))).collect()] == [123456, 234567, 345678, 456789, 567890, 678901, 789012, 890123, None, 222222, None]


def test_page_helpers(spark):
    html = spark.createDataFrame([('<a href="/x/page/7/"><a href="?paged=12">',), ('<a href="/x/page/1/">',), ('"collection_id" : 1234567',)], "h string")
    assert [tuple(r) for r in html.select(C.last_page(F.col("h")), C.collection_id(F.col("h"))).collect()] == [(12, None), (0, None), (0, 1234567)]
    assert set(C.stores(["Gull", "legacy-liquor"])) == {"gull", "legacyliquor"}
    with pytest.raises(ValueError):
        C.stores(["nobody"])


def test_snapshot_files(spark, tmp_path):
    items = [{"name": "A", "price": "$1", "url": "http://a", "image": "i"}, {"name": "B", "url": "ftp://b"}, {"name": "A2", "url": "http://a", "removed": True}]
    (tmp_path / "one.json").write_text(json.dumps({"version": 6, "store": "s", "storeLabel": "S", "items": items}))
    (tmp_path / "bad.json").write_text("{")
    got = snapshots.read_files(spark, str(tmp_path)).collect()
    assert [(r["name"], r["url"], r["removed"], r["store_label"]) for r in got] == [("A2", "http://a", True, "S")]


def test_changed_files(spark):
    a = spark.createDataFrame([("f", "1"), ("g", "1"), ("g", "1")], "db_file string, x string")
    b = spark.createDataFrame([("f", "1"), ("g", "1"), ("h", "2")], "db_file string, x string")
    assert {tuple(r) for r in snapshots.changed_files(a, b, ["x"]).collect()} == {("g", "changed"), ("h", "added")}


def test_streamed_scans(spark, tmp_path):
    scans, out = tmp_path / "scans", str(tmp_path / "out")
    schema = "name string, price string, sku string, url string, img string, removed boolean"
    for rows in ([row("u1"), row("u2")], [row("u2", "$9"), row("u3")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(scans))
        q = incremental.merge_stream(spark, spark.readStream.schema(schema).parquet(str(scans)), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r["url"]: (r["price"], r["removed"]) for r in spark.read.parquet(f"{out}/version=1").collect()}
    assert got == {"u1": ("$10", True), "u2": ("$9", False), "u3": ("$10", False)}


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from windows").first()[0] == events.count()


def test_catalogue_prefers_live_offers(spark):
    rows = spark.createDataFrame([("1", "S", "n", "$1", 1.0, "u1", True, 1), ("1", "T", "", "$9", 9.0, "u2", False, 2)], "sku string, store_label string, name string, price string, price_num double, url string, removed boolean, ts int")
    r = index.catalogue(rows).first()
    assert (r["cheapest_price"], r["stores"], r["stores_ever"], r["name"]) == ("$9", ["T"], ["S", "T"], "n")


def test_whole_caps(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    pairs = catalogue.QUERIES["token_block_pairs_whole"](spark, sf).groupBy("a").count()
    assert pairs.agg(F.max("count")).first()[0] > 25
    for name in ("part", "supplier"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1).drop("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate").crossJoin(spark.range(300))
    rows = rows.selectExpr("*", "id as l_orderkey", "1L as l_partkey", "1L as l_suppkey", "cast(date_add(date'1995-01-01', cast(id as int)) as timestamp) as l_shipdate")
    rows.drop("id").write.parquet(str(tmp_path / "lineitem.parquet"))
    days = [r["day"] for r in catalogue.QUERIES["series_last_days_whole"](spark, str(tmp_path)).collect()]
    assert (len(days), min(days), max(days)) == (260, "1995-02-10", "1995-10-27")


def test_whole_rows(spark, tmp_path):
    sf, queries = "/root/testdata/sf0.001", catalogue.QUERIES
    spark.createDataFrame([(1, "<h1>Salt &amp; Rye</h1>"), (2, "<h1>Gin</h1>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {tuple(r) for r in queries["name_sanitize_whole"](spark, str(tmp_path)).collect()} == {(1, "Salt & Rye"), (2, "Gin")}
    asked = {r["a"] for r in queries["similarity_topk_whole"](spark, sf).select("a").distinct().collect()}
    assert asked == {f"k{i}" for i in range(0, 200, 20)}


def test_changes_with_the_current_row(spark):
    changes = spark.createDataFrame(
        [("S", "1", "new", "u1"), ("S", "1", "new", "u1"), ("S", "2", "drop", "u2"), ("S", "3", "drop", None), ("T", "1", "new", "t1"), (None, "9", "new", "n9"), ("S", None, "new", "x")],
        "store_label string, sku string, change string, url string",
    )
    rows = spark.createDataFrame(
        [("S", "1", 1, False, "old", "a"), ("S", "1", 2, False, "now", None), ("S", "2", 1, False, "live", "b"), ("S", "2", 2, True, "gone", "b"), (None, "9", 1, False, "found", "c"), ("S", "1", 2, True, "zz", "tie")],
        "store_label string, sku string, ts int, removed boolean, url string, name string",
    )
    got = feed.with_current(changes, rows, ["store_label", "sku"], ["url", "name"])
    assert got.columns == ["store_label", "sku", "change", "url", "name", "is_current"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("S", "1", "new", "now", None, True)] * 2  # repeated changes stay, a null of the current row too, and of equal times the live row counts
        + [("S", "2", "drop", "u2", None, False), ("S", "3", "drop", None, None, False), ("T", "1", "new", "t1", None, False), (None, "9", "new", "found", "c", True), ("S", None, "new", "x", None, False)],
        key=str,
    )
    assert feed.with_current(changes.limit(0), rows, ["store_label", "sku"], ["url"]).count() == 0
    assert feed.with_current(changes, rows.limit(0), ["store_label", "sku"], ["name"]).where("is_current or name is not null").count() == 0


def test_search_takes_tokens_before_codes(spark):
    codes = spark.createDataFrame([("12", "Glen One"), ("12", "Glen One again"), ("7", "Glenother"), ("8", "Ardglen"), (None, "Glen Null"), ("", "Glen Empty")], "code string, label string")
    names = ["Glen 12.5", "Cask 12.5", "Cask 7.100", "Cask 8.1", "my glen", "plain", None, "Cask 112.5", "Cask 12.5"]
    items = spark.createDataFrame([(i, n, n) for i, n in enumerate(names)], "sku int, name string, search_text string")
    found = search.search_with_codes(items, codes, " GLEN ")
    assert found.columns == ["sku", "name", "search_text", "priority"]
    assert {(r["sku"], r["priority"]) for r in found.collect()} == {(0, 0), (4, 0), (1, 1), (8, 1), (2, 1)} and found.count() == 5
    assert search.search_with_codes(items, codes, "g").where("priority = 1").count() == 0  # too short a prefix for codes
    assert search.search_with_codes(items, codes, " - ").count() == 0 and search.search_with_codes(items.limit(0), codes, "glen").count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # the items are read once
