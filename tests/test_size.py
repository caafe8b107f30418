"""Work that must not grow faster than its input, and results where keys, names and days are shared by many."""

import itertools
import random
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from catalake import session
from catalake.operators import components, linkage, series
from catalake.plans import catalogue, details, scans, shops  # noqa: F401

from test_catalogue import plain


def test_links_meet_by_ranges(spark, tmp_path):
    parts = [(k, f"Brand#{k % 3}", k % 2) for k in [*range(0, 1300, 7), 299, 300, 599, 600, 900, 2100]]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").dropDuplicates().write.parquet(str(tmp_path / "part.parquet"))
    links = catalogue._links(spark, str(tmp_path))
    known = sorted(set(parts))
    want = sorted((f"{a[0]:06d}", f"{b[0]:06d}") for a, b in itertools.permutations(known, 2) if a[1:] == b[1:] and a[0] < b[0] <= a[0] + 300)
    assert sorted(map(tuple, links.collect())) == want
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert any("Join" in line and "range_" in line for line in plan.splitlines())


def test_components_work_their_edges_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def looked(rows):
        for row in rows:
            seen.add(1)
            yield row

    edges = spark.createDataFrame(spark.sparkContext.parallelize([(1, 2), (2, 3), (5, 5), (7, 8)], 2).mapPartitions(looked), "src long, dst long")
    found = components.connected_components(edges)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7)]
    assert seen.value == 4


def test_a_stored_frame_leaves_no_shuffle(spark):
    folders = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def kept():
        return {f.name for d in folders for f in d.glob("*/shuffle_*")}

    before = kept()
    frame = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    stored = session.checkpointed(frame)
    until = time.time() + 20  # executors remove files a moment later
    while kept() - before and time.time() < until:
        time.sleep(0.1)
    assert not kept() - before
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, frame.collect())) == [(k, 100) for k in range(10)]
    assert spark.conf.get(session.CLEANUP, None) in (None, "false")


def test_components_shuffle_twice_a_round(spark, monkeypatch):
    def shuffling_stages():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        every = spark._jvm.java.util.ArrayList()
        stages = store.stageList(every, False, False, gateway.new_array(spark._jvm.double, 0), every)
        return {stages.apply(i).stageId() for i in range(stages.size()) if stages.apply(i).shuffleWriteBytes()}

    stored = []
    monkeypatch.setattr(components, "checkpointed", lambda frame: stored.append(1) or session.checkpointed(frame))
    before = shuffling_stages()
    found = components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 60 + k) for k in range(9)], "src long, dst long")).collect()
    assert sorted(map(tuple, found)) == [(k, 0) for k in range(41)] + [(k, 50) for k in (50, *range(60, 69))]
    rounds = len(stored) - 1
    assert len(shuffling_stages() - before) <= 2 * rounds + 3  # the edges made distinct, the nodes of stars and of loops


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((40, 15), (40, 60), (60, 45)):
        edges = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]
        want = {x: x for e in edges for x in e}
        for _ in range(n):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        got = components.connected_components(spark.createDataFrame(edges + edges[:5], "src string, dst string")).collect()
        assert len(got) == len(want) and dict(map(tuple, got)) == want


def test_large_group_is_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(linkage, "EXPANDED", 5)
    mapping = spark.createDataFrame([(f"{i:02d}", "00") for i in range(40)] + [("x", "y"), ("y", "y")], "sku string, canonical string")
    keys = mapping.select("sku").union(spark.createDataFrame([("alone",)], "sku string"))
    got = linkage.expanded(keys, mapping).withColumn("task", F.spark_partition_id()).collect()
    group = [f"{i:02d}" for i in range(40)]
    want = [*itertools.product(group, group), *itertools.product("xy", "xy"), ("alone", "alone")]
    assert sorted((r["sku"], r["member"]) for r in got) == sorted(want)
    assert len({r["task"] for r in got if r["sku"] in group}) > 1


def test_dense_series_are_not_shuffled(spark):
    points = [("g", "a", "d1", 1.0), ("g", "b", "d2", None), ("g", "b", "d3", 3.0), ("h", "a", "d1", 4.0)]
    out = series.dense(spark.createDataFrame(points, "g string, s string, day string, price double"), "g", "s")
    want = [("g", "a", "d1", 1.0), ("g", "a", "d2", None), ("g", "a", "d3", None), ("g", "b", "d1", None), ("g", "b", "d2", None), ("g", "b", "d3", 3.0), ("h", "a", "d1", 4.0)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    top = out._jdf.queryExecution().optimizedPlan().toString()
    assert top.index("Generate explode") < top.index("Join")


def test_equal_names_are_scored_once(spark, monkeypatch):
    scored = []
    beside = linkage._beside
    monkeypatch.setattr(linkage, "_beside", lambda mine, right, small, on: scored.append(mine.count() * right.count()) or beside(mine, right, small, on))
    names = ["red ring", "red bolt", "blue ring 12", "red ring 12"]
    items = [(f"{'u:' if i % 9 == 0 else 'k'}{i:03d}", names[i % 4]) for i in range(120)]
    table = spark.createDataFrame(items, "sku string, name string")
    pinned = table.where("substring(sku, -1) in ('0', '3')")
    for k in (3, 200):
        scored.clear()
        got = {tuple(r) for r in linkage.similar_to(pinned, table, k).collect()}
        assert max(scored) <= 64
        both = pinned.toDF("a", "na").crossJoin(table.toDF("b", "nb")).where("a <> b")
        unknown = F.col("a").startswith("u:") | F.col("b").startswith("u:")
        args = [F.col("na"), F.col("nb"), linkage.X.similarity_tokens(F.col("na")), linkage.X.similarity_tokens(F.col("nb"))]
        rows = both.select("a", "b", F.round(linkage.X.similarity(*args) * F.when(unknown, 1.12).otherwise(1.0), 6).alias("s")).where("s > 0").collect()
        want = {(a, r["b"], r["s"]) for a, g in itertools.groupby(sorted(rows, key=lambda r: (r["a"], -r["s"], r["b"])), lambda r: r["a"]) for r in itertools.islice(g, k)}
        assert got == want


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """The smallest tables with half of their parts beyond six digits, where ten numbers share their first six."""
    folder, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        shift = {"part": " REPLACE (p_partkey + 999900 AS p_partkey)", "lineitem": " REPLACE (l_partkey + 999900 AS l_partkey)"}.get(p.stem, "")
        con.execute(f"COPY (SELECT *{shift} FROM '{p}') TO '{folder}/{p.stem}.parquet'")
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{folder}/{p.stem}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", [
    "diff_report", "directed_links", "merge_moves", "name_mode", "paged_scan_merge", "paged_scan_report", "search_scan_pages", "shop_article_pages", "shop_card_blocks", "shop_card_pages",
    "shop_enrichment", "shop_list_pages", "shop_matched_pages", "shop_search_hits", "shop_stacked_pages", "shop_stock_pages", "shop_store_api",
])
def test_keys_of_more_than_six_digits(spark, long_keys, name):
    folder, con = long_keys
    out = catalogue.QUERIES[name](spark, str(folder))
    result = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert want and sorted(tuple(plain(r[c]) for c in columns) for r in out.collect()) == want


def test_prices_become_numbers_before_rows_meet(spark):
    rows = spark.createDataFrame([("a", "u", "$9", False, 1), ("b", "u", "$3", False, 1)], "sku string, url string, price string, removed boolean, ts long")
    now = rows.withColumn("price", F.lit("$4.50"))
    out = catalogue.diff.drops(rows, now, ["sku"])
    assert [(r["sku"], r["change"], r["pct"]) for r in out.collect()] == [("a", "drop", 50)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[:plan.index("Union")]


def test_rows_are_carried_once_to_their_key(spark):
    rows = spark.createDataFrame([("a", "u", 1, False, "x"), ("a", "v", 1, True, "y"), ("b", "u", 2, True, "z")], "sku string, url string, ts long, removed boolean, name string")
    last = catalogue.index.latest(rows, ["sku"])
    assert sorted(map(tuple, last.collect())) == [("a", "u", 1, False, "x"), ("b", "u", 2, True, "z")]
    assert "max_by" not in last._jdf.queryExecution().optimizedPlan().toString()


def test_ties_of_names_go_to_the_greatest(spark):
    rows = spark.createDataFrame([(f"{k}", v, False, 0, "u") for k in range(40) for v in "caebd"], "sku string, name string, removed boolean, ts long, url string").withColumn("ts", F.timestamp_seconds("ts"))
    assert {r["name"] for r in catalogue.index.name_mode(rows).collect()} == {"e"}


def test_links_of_long_keys_are_not_their_own_ends(spark, tmp_path):
    spark.createDataFrame([(1000001, "B", 1), (1000002, "B", 1), (1000003, "B", 1)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, details.directed_links(spark, str(tmp_path)).select("from_sku", "to_sku").collect()))
    sql = catalogue.SQL["directed_links"].replace(" part a", f" '{tmp_path}/part.parquet/*.parquet' a").replace(" part b", f" '{tmp_path}/part.parquet/*.parquet' b")
    assert got == [("1000001", "1000003"), ("1000002", "1000003")] == sorted(duckdb.execute(sql).fetchall())


def test_a_version_works_its_listings_out_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def looked(rows):
        for row in rows:
            seen.add(1)
            yield row

    days = ["1996-01-01", "1998-01-01", "1999-06-01", "2001-01-01"]
    made = [("n", "$1.00", f"{k % 7}", f"u{k}", "s", False, float(k), days[k % 4], f"b{k % 5}") for k in range(60)]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(made, 2).mapPartitions(looked), "name string, price string, sku string, url string, store_label string, removed boolean, price_num double, ts string, category string")
    monkeypatch.setattr(scans, "listings", lambda *_: rows.withColumn("ts", F.col("ts").cast("timestamp")))
    monkeypatch.setattr(scans, "shared_folder", lambda _: str(tmp_path))
    store = scans._store(spark, "", 3)
    assert seen.value == 3 * len(made)
    for version, lacks, day in ((1, "b2", "1997-01-01"), (2, "b4", "1999-01-01"), (3, "b4", "2000-01-01")):
        want = {r[3] for r in made if r[8] != lacks and r[7] < ("1997-01-01" if r[8] == "b3" else day)}
        assert {r["url"] for r in store.read(version).collect()} == want


@pytest.mark.parametrize("name", ["ignored_anti", "rules_insert_absent", "rules_overlay_union"])
def test_rules_of_parts_that_share_six_digits(spark, tmp_path, name):
    path = str(tmp_path / "part.parquet")
    spark.createDataFrame([(k, "B", 1) for k in (7, 9, *range(999990, 1000040, 3), *range(1000200, 1000212))], "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(path)
    out = catalogue.QUERIES[name](spark, str(tmp_path))
    want = duckdb.execute(f"WITH part AS (SELECT * FROM '{path}/*.parquet'), {catalogue.SQL[name].removeprefix('WITH ')}").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert any(a == b for a, b in want)


def test_pages_have_each_address_once(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    parts = [(k, "A" if k % 2 else "B", f"name {k}", k / 100) for k in (7, 9, 100000, *range(999990, 1000040), 10000001, 10000002, 10000013)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_retailprice double").coalesce(1).write.parquet(path)
    out = shops.shop_wrapped_pages(spark, str(tmp_path))
    want = duckdb.sql(catalogue.SQL["shop_wrapped_pages"].replace("FROM part", f"FROM '{path}/*.parquet'")).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert len({r[0] for r in want}) < len(want)


@pytest.mark.parametrize("few", [0, 2, 64])
def test_dense_series_of_any_length(spark, monkeypatch, few):
    monkeypatch.setattr(series, "FEW", few)
    points = [("g", "a", "d1", 1.0), ("g", "a", "d2", 2.0), ("g", "a", "d3", None), ("g", "b", "d4", 4.0), ("g", "b", "d4", 5.0), ("g", "c", None, 6.0), ("g", None, "d5", 7.0), ("h", "a", "d1", 8.0), (None, "a", "d6", 9.0)]
    frame = spark.createDataFrame(points, "g string, s string, day string, price double")
    got = sorted(map(tuple, series.dense(frame, "g", "s").collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE gp (g VARCHAR, s VARCHAR, day VARCHAR, price DOUBLE)")
    con.executemany("INSERT INTO gp VALUES (?, ?, ?, ?)", points)
    want = con.execute("SELECT d.g, s.s, d.day, gp.price FROM (SELECT DISTINCT g, day FROM gp) d JOIN (SELECT DISTINCT g, s FROM gp) s ON d.g = s.g LEFT JOIN gp ON gp.g = d.g AND gp.s = s.s AND gp.day = d.day").fetchall()
    assert got == sorted(want, key=repr) and len(got) == 26


def test_days_are_spread_out_without_a_row_for_each_before(spark):
    points = [("g", f"s{k}", f"d{k}", float(k)) for k in range(5)]
    plan = series.dense(spark.createDataFrame(points, "g string, s string, day string, price double"), "g", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(days#" in plan and "transform(" not in plan
