from pyspark.sql import functions as F

from catalake.operators import linkage, rules
from catalake.sources import sinks

ROW = "name string, price string, sku string, url string, img string, removed boolean, store_label string, db_file string"


def table(spark):
    return spark.createDataFrame([("Éclair", "$1", "123456", "http://a", "data:x", False, "S", "f"), ("apple", "$2", "", "http://b", "i", None, "S", "g"), ("Banana", "$3", "", "http://c", None, True, "T", "g")], ROW)


def test_snapshot_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_snapshot(table(spark), path)
    sinks.write_snapshot(table(spark).where("db_file = 'f'").withColumn("price", F.lit("$9")), path)
    got = {r["url"]: r for r in spark.read.parquet(path).collect()}
    assert {u: r["price"] for u, r in got.items()} == {"http://a": "$9", "http://b": "$2", "http://c": "$3"}
    assert got["http://a"]["img"] == "" and got["http://b"]["removed"] is False


def test_orders_and_index(spark, tmp_path):
    assert [r["name"] for r in sinks.by_name(table(spark)).collect()] == ["apple", "Banana", "Éclair"]
    assert [r["name"] for r in sinks.reading_order(table(spark)).collect()][-1] == "Éclair"
    sinks.write_index(table(spark), str(tmp_path))
    assert spark.read.json(str(tmp_path / "header")).select("count", "countLive").first() == (3, 2)
    assert spark.read.json(str(tmp_path / "items")).count() == 3


def test_rules_and_no_change(spark, tmp_path):
    links = spark.createDataFrame([("a", "b")], "from_sku string, to_sku string")
    path = str(tmp_path / "r")
    sinks.append_rules(links, path)
    sinks.append_rules(links, path)
    assert sinks.read_rules(spark, [str(tmp_path / "none"), path], "from_sku string, to_sku string").count() == 1
    assert sinks.read_rules(spark, [str(tmp_path / "none")], "from_sku string, to_sku string").count() == 0
    left, sent = rules.submit(links, links.limit(0), "from_sku", "to_sku", True)
    assert (left.count(), sent.count()) == (0, 1)
    assert tuple(rules.pending_counts(links, links.limit(0)).first()) == (1, 0)
    same = table(spark).withColumn("change", F.lit(None).cast("string")).withColumn("old_price", F.lit(None).cast("string"))
    assert not sinks.write_if_changed(same, str(tmp_path / "m")) and sinks.write_if_changed(same.withColumn("change", F.lit("new")), str(tmp_path / "m"))


def test_alert_and_caps(spark):
    html, subject, send = sinks.alert_html(table(spark), table(spark).limit(0))
    assert send and subject == "3 new, 0 sales" and "<h2>New (3)</h2>" in html and not sinks.alert_html(table(spark).limit(0), table(spark).limit(0))[2]
    pairs = spark.createDataFrame([("A", f"s{k}", float(k)) for k in range(9)] + [("B", "s8", 99.0)], "anchor string, sku string, score double")
    got = [tuple(r) for r in linkage.capped_pairs(pairs).select("anchor", "sku").collect()]
    assert len(got) == 7 and ("B", "s8") in got and ("A", "s7") in got and ("A", "s8") not in got


def test_alert_as_files(spark, tmp_path):
    """All rows in order below their headings, and nothing to send without rows."""
    rows = table(spark)
    sinks.write_alert(rows, rows.limit(1), str(tmp_path / "a"))
    head = spark.read.json(str(tmp_path / "a" / "head")).first()
    assert (head["subject"], head["n_new"], head["n_sales"], head["send"]) == ("3 new, 1 sales", 3, 1, True)
    lines = [line for p in sorted((tmp_path / "a" / "body").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == "<h2>New (3)</h2>" and lines[4] == "<h2>Sales (1)</h2>" and len(lines) == 6 and all(x.startswith("<li><a href=") for x in (*lines[1:4], lines[5]))
    html = sinks.alert_html(rows, rows.limit(0))[0]
    assert "".join(lines[:1]) + "<ul>" + "".join(lines[1:4]) + "</ul>" in html
    sinks.write_alert(rows.limit(0), rows.limit(0), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b" / "head")).first()["send"] is False
