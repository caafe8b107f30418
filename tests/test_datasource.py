"""The snapshot data source against the native reader, in batch and as a stream."""

import json

import pytest

from catalake.sources import datasource, snapshots

FILES = {
    "a__x__1.json": {"version": 6, "store": "a.com", "storeLabel": "A", "category": "x", "categoryLabel": "X", "source": "http://a", "updatedAt": "2024", "count": 3, "items": [
        {"name": "One", "price": "$1", "sku": "111111", "url": "http://a/1", "img": "i", "removed": False}, {"name": "Two", "price": None, "url": "http://a/2", "image": "j", "removed": True},
        {"name": "One again", "price": "$2", "url": "http://a/1", "thumb": "t"}, {"name": "no address", "url": "ftp://a/3"}, {"name": "é日", "sku": "", "url": "https://a/4", "img": "", "image": "k", "removed": "yes"}]},
    "b__x__2.json": {"store": "b.com", "category": "x", "items": [{"name": "B", "url": "http://b/1", "price": "$3"}]},
    "c__y__3.json": {"store": "c.com", "category": "y", "items": []},
}


def write(folder, files):
    folder.mkdir(parents=True)
    for name, body in files.items():
        (folder / name).write_text(json.dumps(body))


def values(rows, names):
    return sorted(tuple(r[c] for c in names) for r in rows.collect())


SHARED = ["store", "store_label", "category", "category_label", "source", "updated_at", "ord", "name", "price", "sku", "url", "img", "removed"]


def test_batch_equals_the_native_reader(spark, tmp_path):
    write(tmp_path / "db", FILES)
    (tmp_path / "db" / "d__z__4.json").write_text('{"store": "d.com", "items": [{"name"')
    datasource.register(spark)
    rows = spark.read.format("snapshots").load(str(tmp_path / "db"))
    want = snapshots.read_files(spark, str(tmp_path / "db"))
    text = lambda rs: sorted(map(str, values(rs, SHARED)))
    assert text(rows) == text(want) and rows.count() == 4
    assert {r["db_file"].rsplit("/", 1)[1] for r in rows.collect()} == {"a__x__1.json", "b__x__2.json"}


@pytest.mark.parametrize("wanted", ["db_file,url", "url, removed, version"])
def test_columns_and_filters(spark, tmp_path, wanted):
    write(tmp_path / "version=1", FILES)
    write(tmp_path / "version=2", {"b__x__2.json": FILES["b__x__2.json"]})
    datasource.register(spark)
    rows = spark.read.format("snapshots").option("columns", wanted).load(str(tmp_path))
    assert rows.columns == [c.strip() for c in wanted.split(",")] and rows.count() == 5
    full = spark.read.format("snapshots").load(str(tmp_path))
    assert full.where("version = 2").count() == 1 and full.where("version in (1, 2) and store = 'b.com'").count() == 2
    assert full.where("version = 1 and version = 2").count() == 0 and full.where("category = 'x' and removed").count() == 2 and full.where("store = 'nobody'").count() == 0
    # Filters on files are taken by the source, the others stay.
    reader = datasource.SnapshotReader(datasource.SnapshotFiles(str(tmp_path), datasource.COLUMNS))
    kept = list(reader.pushFilters([datasource.EqualTo(("version",), 2), datasource.In(("store",), ("b.com", "c.com")), datasource.EqualTo(("name",), "B")]))
    assert [f.attribute for f in kept] == [("name",)] and [(p.version, p.headers) for p in reader.partitions()] == [(2, {"store": {"b.com", "c.com"}})]


def test_stream_reads_each_version_once(spark, tmp_path):
    """Two runs with one checkpoint: the second has the versions that came in between, and all rows are those of the batch reader."""
    source, out = tmp_path / "versions", tmp_path / "out"
    write(source / "version=1", FILES)
    datasource.register(spark)

    def run():
        query = spark.readStream.format("snapshots").load(str(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
        query.awaitTermination(90)

    run()
    assert spark.read.parquet(str(out)).count() == 4
    write(source / "version=2", {"b__x__2.json": FILES["b__x__2.json"]})
    write(source / "version=3", {"a__x__1.json": FILES["a__x__1.json"]})
    run()
    names = ["version", "url", "name"]
    assert values(spark.read.parquet(str(out)), names) == values(spark.read.format("snapshots").load(str(source)), names)
    assert spark.read.parquet(str(out)).groupBy("version").count().count() == 3
