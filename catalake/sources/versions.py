"""Versions of snapshot files in a folder that driver and executors share.

A commit writes the rows of some files to a folder of its own, then a manifest (one row a
file: where its rows are, how many, and their fingerprint), and is a version once its
commit record exists. The record's name is the version's number and it is put in place by
a rename that never overwrites, so of two writers one gets the number and the other takes
the next one upon the new head. A reader sees whole versions only, and what an interrupted
writer leaves is never read. Versions are compared by their manifests, without their rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "db_file string, folder string, n long, mark decimal(38,0)"
COMMIT = "version long, parent long, ts double, manifest string, rows string, note string"


class Conflict(RuntimeError):
    """Another writer changed a file that this one changes too."""


def fingerprints(rows: DataFrame) -> DataFrame:
    """db_file, n and mark of rows with a db_file: a mark depends on the rows, not on their order."""
    columns = sorted(c for c in rows.columns if c != "db_file")
    return rows.groupBy("db_file").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("decimal(38,0)").alias("mark"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """db_file and status (added, changed, deleted) of the files whose fingerprints differ: one aggregation."""
    both = old.select("db_file", F.lit(0).alias("side"), F.struct("n", "mark").alias("x")).union(new.select("db_file", F.lit(1).alias("side"), F.struct("n", "mark").alias("x")))
    met = both.groupBy("db_file").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("o"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("n"))
    return met.where(~F.col("o").eqNullSafe(F.col("n"))).select("db_file", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("changed").alias("status"))


class VersionStore:
    """The versions under ``root``; version 0 is the empty one before the first."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the shared file system -------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, name: str) -> list[str]:
        path = self._path(name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _create_once(self, name: str, text: str) -> bool:
        """Puts a file in place, whole, unless there is one of that name; whether it did. It is as atomic as the store's rename without overwriting."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target, temporary = self._path(name), self._path(f"staged/{uuid.uuid4().hex}")
        fs = target.getFileSystem(conf)
        fs.mkdirs(target.getParent())
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(temporary, target, plain)
        except Py4JJavaError as error:
            fs.delete(temporary, False)
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    # -- reading ----------------------------------------------------------------------------------------------

    def head(self) -> int:
        """The newest version, 0 without any."""
        return max((int(n[:-5]) for n in self._files("commits") if n.endswith(".json")), default=0)

    def log(self) -> DataFrame:
        """version, parent, ts, manifest, rows (their schema) and note of every version."""
        if not self.head():
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.root}/commits")

    def _commit(self, version: int):
        row = self.spark.read.schema(COMMIT).json(f"{self.root}/commits/{version:012d}.json").first()
        if row is None or row["version"] != version:
            raise ValueError(f"there is no version {version}")
        return row

    def manifest(self, version: int | None = None) -> DataFrame:
        """db_file, folder, n and mark of a version's files."""
        version = self.head() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._commit(version)['manifest']}")

    def read(self, version: int | None = None, files: DataFrame | None = None) -> DataFrame:
        """The rows of a version, or of those of its files that are among files (db_file); only the folders that hold them are listed, and only their partitions read."""
        version = self.head() if version is None else version
        if not version:
            raise ValueError("version 0 has no rows and no schema")
        held = self.manifest(version)
        if files is not None:
            held = held.join(files.select("db_file"), "db_file", "left_semi")
        commit = self._commit(version)
        schema = T.StructType.fromJson(json.loads(commit["rows"]))
        # A folder for each commit that still has files: a name each reaches the driver, as a scan's paths do.
        folders = [r["folder"] for r in held.where("n > 0").select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        kinds = T.StructType([*[f for f in schema.fields if f.name != "db_file"], T.StructField("folder", T.StringType()), T.StructField("db_file", T.StringType())])
        rows = self.spark.read.schema(kinds).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/folder={f}" for f in folders])
        return rows.join(held.select("folder", "db_file"), ["folder", "db_file"], "left_semi").select(*schema.names)

    def files(self, version: int | None = None) -> DataFrame:
        return self.manifest(version).select("db_file")

    def exists(self, asked: DataFrame, version: int | None = None) -> DataFrame:
        """asked (db_file and any more) with exists: whether the version has that file. A null file doesn't exist."""
        have = self.files(version).select("db_file", F.lit(True).alias("exists"))
        return asked.join(have, "db_file", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))

    def changed(self, old: int | None, new: int | DataFrame) -> DataFrame:
        """db_file and status of what differs between two versions. Without an old one every file of the new one is added; new may be rows that aren't committed yet."""
        mine = fingerprints(new) if isinstance(new, DataFrame) else self.manifest(new)
        return compared(self.manifest(old or 0), mine)

    # -- writing ----------------------------------------------------------------------------------------------

    def commit(self, rows: DataFrame, deleted: DataFrame | None = None, parent: int | None = None, note: str = "", before_record: Callable[[], None] = lambda: None) -> int:
        """The next version: rows (with a db_file) replace the files they have, and the files of deleted (db_file) go.

        With a parent, which the rows were made from, the commit conflicts if a later version
        changed one of the same files; other files' changes since then are kept. Rows without
        a db_file belong to no file and are an error. ``before_record`` runs when all but the
        record is written.
        """
        folder = uuid.uuid4().hex
        columns = [c for c in rows.columns if c != "db_file"]
        checked = rows.withColumn("db_file", F.when(F.col("db_file").isNull(), F.raise_error(F.lit("a row has no db_file"))).otherwise(F.col("db_file").cast("string")))
        checked.select(*columns, "db_file").hint("rebalance", "db_file").write.partitionBy("db_file").parquet(f"{self.root}/data/folder={folder}")
        schema = T.StructType([*[f for f in rows.schema.fields if f.name != "db_file"], T.StructField("db_file", T.StringType())])
        if any(n.startswith("db_file=") for n in self._files(f"data/folder={folder}")):
            kept = self.spark.read.schema(schema).parquet(f"{self.root}/data/folder={folder}")
            mine = fingerprints(kept).select("db_file", F.lit(folder).alias("folder"), "n", "mark")
        else:
            mine = self.spark.createDataFrame([], MANIFEST)
        name = uuid.uuid4().hex
        mine.write.parquet(f"{self.root}/manifests/own-{name}")
        mine = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/own-{name}")
        touched = mine.select("db_file") if deleted is None else mine.select("db_file").union(deleted.select("db_file")).distinct()
        while True:
            head = self.head()
            if parent is not None and head != parent:
                clash = self.changed(parent, head).join(touched, "db_file", "left_semi").first()
                if clash:
                    raise Conflict(f"{clash['db_file']} was {clash['status']} since version {parent}")
            manifest = f"{head + 1}-{uuid.uuid4().hex}"
            whole = self.manifest(head).join(touched, "db_file", "left_anti").select("db_file", "folder", "n", "mark").unionByName(mine)
            whole.write.parquet(f"{self.root}/manifests/{manifest}")
            before_record()
            record = {"version": head + 1, "parent": head, "ts": time.time(), "manifest": manifest, "rows": json.dumps(schema.jsonValue()), "note": note}
            if self._create_once(f"commits/{head + 1:012d}.json", json.dumps(record)):
                return head + 1


class KeptIndex:
    """An index by key over a store's rows, kept for each version and made from an earlier version's.

    build turns rows into one row a key, from that key's rows alone. A version's index is
    the earlier one without the keys whose rows differ, and these built anew; which keys
    differ is read from the changed files only.
    """

    def __init__(self, store: VersionStore, name: str, build: Callable[[DataFrame], DataFrame], key: str = "sku"):
        self.store, self.name, self.build, self.key = store, name, build, key

    def _kept(self) -> list[int]:
        folder = f"index/{self.name}"
        return sorted(int(n) for n in self.store._files(folder) if n.isdigit() and "_SUCCESS" in self.store._files(f"{folder}/{n}"))

    def changed_keys(self, old: int, new: int) -> DataFrame:
        """Keys whose rows differ between two versions."""
        files = self.store.changed(old, new)
        # Rows of the older version count against those of the newer one: one sum a key is shuffled, not one for each side.
        side = lambda v, n: self.store.read(v, files).select(self.key, F.lit(n).cast("long").alias("n"), (n * F.xxhash64(*sorted(self.store.read(v).columns)).cast("decimal(20,0)")).cast("decimal(38,0)").alias("mark"))
        sums = side(old, -1).union(side(new, 1)).groupBy(self.key).agg(F.sum("mark").alias("mark"), F.sum("n").alias("n"))
        return sums.where("mark <> 0 or n <> 0").select(self.key)

    def load(self, version: int | None = None) -> DataFrame:
        """The index of a version (the newest by default), made and kept if it isn't there yet."""
        store = self.store
        version = store.head() if version is None else version
        path, kept = f"{store.root}/index/{self.name}", self._kept()
        if version not in kept:
            before = [v for v in kept if v < version]
            if before:
                keys = self.changed_keys(before[-1], version)
                old = store.spark.read.parquet(f"{path}/{before[-1]}").join(keys, self.key, "left_anti")
                made = old.unionByName(self.build(store.read(version).join(keys, self.key, "left_semi")))
            else:
                made = self.build(store.read(version))
            made.write.mode("overwrite").parquet(f"{path}/{version}")
        return store.spark.read.parquet(f"{path}/{version}")
