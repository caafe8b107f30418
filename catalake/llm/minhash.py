"""Near-duplicates by b-bit MinHash, with links confirmed on full shingle sets.

A document's sketch keeps the low ``BITS`` bits of each of ``BANDS * ROWS`` minima,
packed into 64-bit words; bands of full minima give candidates. The similarity of a
candidate pair is estimated from the count of differing bits of two sketches,
corrected for bits that agree by chance; pairs far below the threshold go, and
the others are confirmed on their full sets.

Documents with equal sets are one node from the start. A bucket never emits all its
pairs. In each of ``ROUNDS`` rounds a bucket names one hub, each node goes to the most
similar hub of its buckets, and the links found are joined into components, so a round
makes at most one row a node. Then only pairs of different components that share a
bucket are compared, in tasks that hold a part of a bucket, so no link that would join
two components is lost beyond the bands' miss rate: (1 - s**ROWS)**BANDS, below 5e-8
for s = 0.8.

Defined results: words are runs of other characters than 0x20 and 0x09-0x0D, with
A-Z lower-cased. Fewer words than a shingle are one shingle; null and empty texts
have no set and link with nothing. Rows that repeat a doc_id are linked. Rows
without a doc_id link with nothing and are kept. Ties go to the smaller doc_id, of any
ordered type. An empty table gives no row. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import among, checkpointed
from . import kernels as K

BANDS, ROWS, BITS = 32, 4, 8
HASHES = BANDS * ROWS
LANES = HASHES * BITS // 64
#: Candidates are confirmed if their estimate is at most this much below the threshold: five standard errors at 0.8.
SLACK = 0.19
PERCENT = 80
#: Rounds in which buckets name a hub.
ROUNDS = 2
#: Nodes that are checked against one copy of their hub; nodes of a bucket, and shingles of their sets, that a task holds at once.
SPOKES, BUCKET_PART, HELD_SHINGLES = 500, 8192, 4_000_000

_A = (K.splitmix(np.arange(HASHES, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)).astype(np.uint32)
_B = K.splitmix(np.arange(HASHES, dtype=np.uint64) + np.uint64(7777)).astype(np.uint32)
_BLOCK = 2048


def shingle_sets(chunk: K.Chunk, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    lower = K.Chunk(K.LOWER[chunk.data], chunk.bounds, chunk.first)
    words = K.Words(lower)
    hashes = K.word_hashes(lower.data, words)
    keys, at = K.windows(hashes, words, size)
    cut = np.searchsorted(at, words.first)
    out = []
    with np.errstate(over="ignore"):
        for i in range(len(chunk)):
            n = words.counts[i]
            if n >= size:
                out.append(np.unique(keys[cut[i] : cut[i + 1]]))
            elif n:
                own = hashes[words.first[i] : words.first[i + 1]]
                whole = np.uint64(n)
                for h in own:
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + h
                out.append(K.splitmix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of HASHES permutations."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), _BLOCK):
        part = low[k : k + _BLOCK]
        np.minimum(best, (_A[:, None] * part[None, :] + _B[:, None]).min(1), out=best)
    return best


def packed(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch words and band keys of some documents' minima (one row each)."""
    mixed = K.splitmix(best.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    sketch = (mixed & np.uint64((1 << BITS) - 1)).astype(np.uint8).reshape(len(best), LANES, 8).view(np.uint64)[:, :, 0]
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(best), BANDS)).copy()
        rows = best.reshape(len(best), BANDS, ROWS)
        for r in range(ROWS):
            key = K.splitmix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r].astype(np.uint64))
    return sketch, key


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set1 and set2 (128 bits of the set), sketch and bands of every row; the last four are null without a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                sets = shingle_sets(chunk, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    one = np.array([K.splitmix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    two = np.array([K.splitmix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                none = n == 0
                best = np.array([minima(s) for s in sets], np.uint32).reshape(len(sets), HASHES)
                words, keys = packed(best)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (words, keys)]
                mask = pa.array(none)
                cols = [pa.array(one), pa.array(two), *lists]
                cols = [pa.compute.if_else(mask, pa.nulls(len(n), c.type), c) for c in cols]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(n), *cols], names=["doc_id", "n_shingles", "set1", "set2", "sketch", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_shingles long, set1 long, set2 long, sketch array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed sketches by bit counts.

    Equal minima agree in all bits and others in half of them by chance, so the share
    of differing bits is half the share of differing minima.
    """
    differing = reduce(add, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(LANES)])
    return 1 - differing / F.lit(LANES * 32.0)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return common > 0 and 100 * common >= percent * (both - common)


def _texts(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted with the text of its node (all of them, where rows repeat an id); nodes has every node of it. Other documents' texts are not shuffled."""
    texts = docs.select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return among(texts, "node", nodes).join(wanted, "node")


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a node and its hub whose full shingle sets reach the threshold. Each node has one hub at most.

    A node's text travels once. A hub's text comes once for every SPOKES of its nodes, so
    the nodes of a large group are checked in many tasks.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("cuts"))
    salted = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), "cuts").cast("int").alias("salt"))
    spokes = salted.select(F.col("a").alias("node"), F.col("b").alias("hub"), "salt", F.lit(1).alias("side"))
    held = hubs.select(F.col("b").alias("node"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"), F.lit(0).alias("side"))
    rows = _texts(docs, spokes.unionByName(held), pairs.select("a").union(pairs.select("b"))).repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            hubs, salts, sides = (batch.column(c).to_pylist() for c in ("hub", "salt", "side"))
            keep, i = [], 0
            for chunk in K.chunks(batch.column("text")):
                for one in shingle_sets(chunk, shingle):
                    if (hubs[i], salts[i]) != place:
                        place, held = (hubs[i], salts[i]), []
                    if sides[i] == 0:
                        # Rows that repeat an id may differ in text: each of them may link.
                        held.append(one)
                    elif any(_linked(x, one, percent) for x in held):
                        keep.append(i)
                    i += 1
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("node", "hub")], names=["a", "b"])

    id_type = pairs.schema["a"].dataType.simpleString()
    return rows.select("hub", "salt", "side", "node", "text").mapInArrow(run, f"a {id_type}, b {id_type}")


class _Part:
    """The held nodes of one part of a bucket, and which components its links have joined."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.arrays: tuple | None = None
        self.parent: dict = {}

    def root(self, x):
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def stacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Component number, sketch and bands of the held nodes."""
        if self.arrays is None:
            self.numbers = {c: k for k, c in enumerate(dict.fromkeys(r[1] for r in self.rows))}
            self.arrays = (np.array([self.numbers[r[1]] for r in self.rows]), np.stack([r[2] for r in self.rows]), np.stack([r[3] for r in self.rows]))
        return self.arrays

    def likely(self, key: int, component, main: bool, sketch: np.ndarray, bands: np.ndarray, least: float) -> np.ndarray:
        """Held nodes of other components that a right node may link with and meets in this bucket first."""
        numbers, sketches_, bands_ = self.stacked()
        differing = np.bitwise_count(sketches_ ^ sketch).sum(1, dtype=np.int64)
        at = np.flatnonzero((1 - differing / (LANES * 32.0) >= least) & (numbers != self.numbers.get(component, -1)))
        if not main:  # the main component is never held; of the others, each pair is met twice
            at = at[[self.rows[k][1] < component for k in at.tolist()]] if len(at) else at
        if len(at):
            same = bands_[at] == bands
            at = at[bands[same.argmax(1)] == key]
        return at


def _parts(batch: pa.RecordBatch) -> tuple[list, ...]:
    n = batch.num_rows
    sketch = np.asarray(batch.column("sketch").flatten()).view(np.uint64).reshape(n, LANES)
    bands = np.asarray(batch.column("bands").flatten()).reshape(n, BANDS)
    return (*(batch.column(c).to_pylist() for c in ("key", "part", "side", "node", "component", "main", "n")), sketch, bands)


BUCKET = "key long, part int, side int, node {id}, component {id}, main boolean, n long, sketch array<long>, bands array<long>"


def likely_in_buckets(rows: DataFrame, least: float) -> DataFrame:
    """The rows of bucket parts that have a likely partner of another component there, by sketch: no table of pairs is made."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = rows.schema["node"].dataType.simpleString()
    dealt = rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, found, schema = None, _Part(), set(), None

        def left() -> pa.RecordBatch:
            cols = [[place[0]] * len(found), [place[1]] * len(found), [0] * len(found)]
            mine = [held.rows[k] for k in sorted(found)]
            cols += [[r[0] for r in mine], [r[1] for r in mine], [False] * len(mine), [r[4] for r in mine], [r[2].view(np.int64) for r in mine], [r[3] for r in mine]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            keys, part, side, node, component, main, n, sketch, bands = _parts(batch)
            keep = []
            for i in range(batch.num_rows):
                if (keys[i], part[i]) != place:
                    if found:
                        yield left()
                    place, held, found = (keys[i], part[i]), _Part(), set()
                if side[i] == 0:
                    held.rows.append((node[i], component[i], sketch[i].copy(), bands[i].copy(), n[i]))
                elif held.rows:
                    at = held.likely(keys[i], component[i], main[i], sketch[i], bands[i], least)
                    if len(at):
                        keep.append(i)
                        found.update(at.tolist())
            if keep:
                yield batch.take(pa.array(keep, pa.int64()))
        if found:
            yield left()

    return dealt.mapInArrow(run, BUCKET.format(id=id_type))


def confirm_in_buckets(rows: DataFrame, docs: DataFrame, shingle: int, percent: int, least: float) -> DataFrame:
    """Links (a, b) that join components, between the held and the other nodes of each bucket part, on full sets.

    A part's held nodes have at most about HELD_SHINGLES shingles together. A link is
    given only where it joins components that the part's links so far don't, so there are
    fewer links than nodes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = rows.schema["node"].dataType.simpleString()
    size = rows.where("side = 0").groupBy("key", "part").agg(F.ceil(F.sum("n") / HELD_SHINGLES).cast("int").alias("cuts"))
    cut = rows.join(size, ["key", "part"])
    mine = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("node"), "cuts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = _texts(docs, cut.withColumn("cut", F.explode(mine)).drop("cuts"), rows.select("node")).repartition(parts, "key", "part", "cut").sortWithinPartitions("key", "part", "cut", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, _Part()
        for batch in batches:
            keys, part, side, node, component, main, n, sketch, bands = _parts(batch)
            cuts = batch.column("cut").to_pylist()
            out_a, out_b, i = [], [], -1
            for chunk in K.chunks(batch.column("text")):
                for one in shingle_sets(chunk, shingle):
                    i += 1
                    if (keys[i], part[i], cuts[i]) != place:
                        place, held = (keys[i], part[i], cuts[i]), _Part()
                    if side[i] == 0:
                        held.rows.append((node[i], component[i], sketch[i].copy(), bands[i].copy(), one))
                        continue
                    if not held.rows:
                        continue
                    for k in held.likely(keys[i], component[i], main[i], sketch[i], bands[i], least).tolist():
                        x, y = held.root(held.rows[k][1]), held.root(component[i])
                        if x != y and _linked(held.rows[k][4], one, percent):
                            held.parent[x] = y
                            out_a.append(held.rows[k][0])
                            out_b.append(node[i])
            kind = batch.schema.field("node").type
            yield pa.RecordBatch.from_arrays([pa.array(out_a, kind), pa.array(out_b, kind)], names=["a", "b"])

    columns = ["key", "part", "cut", "side", "node", "component", "main", "n", "sketch", "bands", "text"]
    return dealt.select(*columns).mapInArrow(run, f"a {id_type}, b {id_type}")


def _joined(links: DataFrame | None, more: DataFrame) -> DataFrame:
    """Components after more links: the first ones are stars, so joining them takes few rounds."""
    more = more.toDF("src", "dst")
    return checkpointed(connected_components(more if links is None else links.toDF("src", "dst").union(more)))


def components(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every row."""
    docs = docs.select("doc_id", "text")
    all_rows = checkpointed(sketches(docs, shingle))
    have = all_rows.where("n_shingles > 0 and doc_id is not null")
    # The rows of a class have one set, so they have one sketch.
    classes = have.groupBy("set1", "set2").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n_shingles", "sketch", "bands"), "doc_id").alias("of"))
    nodes = checkpointed(classes.select("set1", "set2", "node", F.col("of.n_shingles").alias("n"), "of.sketch", "of.bands"))
    members = have.select("set1", "set2", "doc_id", "n_shingles").join(nodes.select("set1", "set2", "node"), ["set1", "set2"]).select("doc_id", "n_shingles", "node")
    nodes = nodes.select("node", "n", "sketch", "bands")

    # One shuffle of all bands: a bucket with one node goes where it is read.
    bucket = Window.partitionBy("key")
    rows = nodes.select("node", F.explode("bands").alias("key")).withColumn("low", F.min("node").over(bucket)).withColumn("high", F.max("node").over(bucket))
    shared = checkpointed(rows.where("low <> high").select("key", "node").distinct())
    least = percent / 100 - SLACK
    sketch = nodes.select("node", "sketch")

    def now(found: DataFrame | None) -> DataFrame:
        """The nodes of each bucket with their components."""
        if found is None:
            return shared.withColumn("component", F.col("node"))
        return shared.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))

    found = None
    for k in range(ROUNDS):
        placed = now(found)
        # A node's order is the same in all buckets, so the buckets of a group of copies agree on few hubs.
        hubs = placed.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(k))).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        hubs = hubs.where("low <> high").select("key", F.col("hub.node").alias("b"), F.col("hub.component").alias("of"))
        meet = placed.join(hubs, "key").where("component <> of").select(F.col("node").alias("a"), "b").distinct()
        scored = meet.join(sketch.toDF("a", "sketch_a"), "a").join(sketch.toDF("b", "sketch_b"), "b").withColumn("e", estimate(F.col("sketch_a"), F.col("sketch_b")))
        best = scored.where(F.col("e") >= least).groupBy("a").agg(F.max_by("b", F.struct("e", "b")).alias("b"))
        links = checkpointed(confirm(checkpointed(best), docs, shingle, percent))
        if links.isEmpty():
            break
        found = _joined(found, links)

    # Pairs of different components that share a bucket are all that can still join components.
    placed = now(found)
    per = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    # Of each bucket, the component with most nodes is only met by the others' nodes: its own pairs are never formed.
    mixed = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("k"), F.sum("n").alias("all"), F.max("n").alias("most")).where("k > 1")
    mixed = mixed.select("key", "largest", F.ceil((F.col("all") - F.col("most")) / BUCKET_PART).cast("int").alias("cuts"))
    apart = placed.join(mixed, "key").withColumn("main", F.col("component") == F.col("largest"))
    # Nodes of other components are held, in parts of a bounded size; all of a bucket's nodes pass each part.
    held = apart.where("not main").select("key", "node", "component", "main", F.pmod(F.xxhash64("node"), "cuts").cast("int").alias("part"), F.lit(0).alias("side"))
    passing = apart.select("key", "node", "component", "main", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), F.lit(1).alias("side"))
    sides = held.unionByName(passing).join(nodes, "node").select("key", "part", "side", "node", "component", "main", "n", "sketch", "bands")
    more = confirm_in_buckets(checkpointed(likely_in_buckets(sides, least)), docs, shingle, percent, least).toDF("src", "dst")

    # Rows that repeat an id are one document, whichever sets they have.
    repeated = members.groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("dst")).where("src <> dst").select("src", "dst")
    more = checkpointed(more.union(repeated))
    if not more.isEmpty():
        found = _joined(found, more)
    final = members.select("doc_id", "n_shingles", F.col("node").alias("component_id"))
    if found is not None:
        final = members.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    rest = all_rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return final.unionByName(rest)


def mark_kept(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """components with kept: one document of each group, the one with the smallest id."""
    return components(docs, shingle, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs without rows of which a near-duplicate with a smaller id stays; all columns stay. Of rows that repeat an id, those that are kept all stay."""
    gone = checkpointed(components(docs, shingle, percent).where("doc_id <> component_id").select("doc_id").distinct())
    rest = among(docs, "doc_id", gone).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return among(docs, "doc_id", gone, "left_anti").union(rest)
