"""Packing by cutting-stock column generation.

Every text becomes token ids and an end id. Ids beyond full sequences are cut off
in whole sequences of ``CAPACITY`` ids; the rest of each document is one piece.
Pieces are put into classes by length, and a linear program chooses how often each
pattern (a multiset of classes that fits one sequence) is used: its columns are
priced by a dynamic program for the unbounded knapsack. Patterns are rounded down,
the few pieces left over are packed by first fit on the histogram, and pieces get
their slot from their rank within their class. Only the histogram (at most
``CLASSES`` rows) and the patterns reach the driver, so neither grows with the
documents. Gaps that classes leave are below one class width a piece.

Defined results: a null or empty text is the end id alone. Repeated rows (same
doc_id) are packed as separate pieces, and rows without a doc_id like others. Pieces of
one length go by doc_id and start. An empty table gives an empty result. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .fitting import in_task

CAPACITY = 4096
END_ID = 2
#: Lengths are rounded up to classes of CAPACITY / CLASSES ids.
CLASSES = 256
#: Ranks within a class are counted in about one part per so many pieces.
PART_ROWS = 100_000
#: Bound of a worker's table of encoded units, which is then begun anew.
WORDS = 480_000

#: Fixed: the normaliser and the pre-tokenizer whose units ``UnitEncoder`` can find from bytes.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WHITE, LETTER, DIGIT, SIGN, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[K.WHITE] = WHITE
#: Units that are encoded in one call of the library.
CALL_UNITS = 500
#: Bytes of the texts that are encoded together, where no text is longer.
ENCODED_BYTES = 1 << 18


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, in one twice as long if it has less than size."""
    return array if size <= len(array) else np.concatenate((array, np.zeros(max(size - len(array), len(array)), array.dtype)))


class Table:
    """Token ids by 64-bit hash, in open addressing on arrays, so that whole batches are looked up at once."""

    def __init__(self, bits: int = 16):
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.shift = np.uint64(64 - bits)
        self.start, self.size, self.hashes = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint64)
        self.ids = np.zeros(4 << bits, np.uint32)
        self.count = self.held = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.rows[slot], -1)
        going = np.flatnonzero((key != hashes) & (key != 0))
        while len(going):
            slot[going] = (slot[going] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[going]]
            hit = key == hashes[going]
            out[going[hit]] = self.rows[slot[going[hit]]]
            going = going[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new hashes and their ids, one after the other."""
        n, self.count = self.count, self.count + len(hashes)
        rows = slice(n, self.count)
        self.start, self.size, self.hashes = (_room(x, self.count) for x in (self.start, self.size, self.hashes))
        self.ids = _room(self.ids, self.held + len(ids))
        self.start[rows], self.size[rows], self.hashes[rows] = self.held + np.cumsum(size) - size, size, hashes
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        if 2 * self.count > len(self.keys):
            bits = (2 * self.count).bit_length()
            self.keys, self.rows, self.shift = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits)
            n = 0
        going = np.arange(n, self.count)
        slot = (self.hashes[going] >> self.shift).astype(np.int64)
        while len(going):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = self.hashes[going[free]]
            won = self.keys[slot] == self.hashes[going]
            self.rows[slot[won]] = going[won]
            going, slot = going[~won], (slot[~won] + 1) & (len(self.keys) - 1)


class UnitEncoder:
    """Token ids of the texts of a chunk, from a table of the units that the pre-tokenizer would cut.

    White space parts a text into words that are encoded alone. Words of ASCII and
    Latin-1 letters, digits and signs are cut into runs of lower-case letters, single
    digits and runs of signs; any other word (and one with an apostrophe before a letter
    or with ``<|``) is one unit as it stands. Each distinct unit is encoded by the library
    once while the table holds it. With another normaliser or pre-tokenizer, every word is
    such a unit, which is exact where words are encoded alone. Units are told apart by a
    64-bit hash.
    """

    END = "</w>"

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer

        # A task has one core, which the library's own threads would exceed.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        made = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        first = (made(self.lib.pre_tokenizer).get("pretokenizers") or [{}])[0]
        self.known = (
            getattr(self.lib.model, "end_of_word_suffix", None) == self.END and made(self.lib.normalizer).get("normalizers") == NORMALIZERS
            and first.get("pattern") == {"Regex": SPLIT} and all("<|" in t.content for t in self.lib.get_added_tokens_decoder().values())
        )
        self.ends = np.zeros(self.lib.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.lib.get_vocab().items() if self.known and t.endswith(self.END)]] = True
        self.table = Table()

    def _alone(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(units, add_special_tokens=False)]

    def _together(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units without odd characters: many in one call, told apart by the end mark of each one's last token."""
        out: list[np.ndarray] = []
        parts = [units[k : k + CALL_UNITS] for k in range(0, len(units), CALL_UNITS)]
        for part, e in zip(parts, self.lib.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cut[:-1]) if len(cut) == len(part) and cut[-1] == len(ids) else self._alone(part)
        return out

    def _learn(self, hashes: np.ndarray, units: list[str], odd: np.ndarray) -> None:
        ids: list = [None] * len(units)
        for places, encode in ((np.flatnonzero(odd), self._alone), (np.flatnonzero(~odd), self._together)):
            for k, found in zip(places.tolist(), encode([units[k] for k in places.tolist()]), strict=True):
                ids[k] = found
        self.table.add(hashes, np.array([len(x) for x in ids], np.int64), np.concatenate(ids))

    def _units(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with lower-case units, start and end of each unit, and whether it is odd."""
        data, n = chunk.data, len(chunk.data)
        kind = CLASS[data]
        lower = K.LOWER[data]
        if not self.known:
            kind[kind != WHITE] = ODD
        else:
            # Letters of two bytes from U+00C0 to U+00FF, but for the two signs among them.
            at = np.flatnonzero(data[:-1] == 0xC3)
            after = data[at + 1]
            at = at[(after != 0x97) & (after != 0xB7)]
            kind[at] = kind[at + 1] = LETTER
            upper = at[data[at + 1] <= 0x9E]
            lower[upper + 1] += 0x20
            at = np.flatnonzero(data[:-1] == ord("'"))
            kind[at[kind[at + 1] == LETTER]] = ODD
            at = np.flatnonzero(data[:-1] == ord("<"))
            kind[at[data[at + 1] == ord("|")]] = ODD
        if (kind == ODD).any():
            words = K.Words(chunk)
            count = np.zeros(n + 1, np.int64)
            np.cumsum(kind == ODD, out=count[1:])
            odd = np.flatnonzero(count[words.end] > count[words.start])
            step = np.zeros(n + 1, np.int8)
            step[words.start[odd]] += 1
            np.subtract.at(step, words.end[odd], 1)
            inside = np.cumsum(step[:-1], dtype=np.int8) > 0
            kind[inside] = ODD
            lower = np.where(inside, data, lower)
        edge = np.zeros(n + 1, bool)
        edge[chunk.bounds] = True
        edge[0] = True
        begins = kind != WHITE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | edge[1:n]
        start = np.flatnonzero(begins)
        stop = np.ones(n, bool)
        stop[:-1] = begins[1:] | (kind[1:] == WHITE) | edge[1:n]
        end = np.flatnonzero(stop & (kind != WHITE)) + 1
        return lower, start, end, kind[start] == ODD

    def encode(self, chunk: K.Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and how many each has."""
        if not len(chunk.data):
            return np.full(len(chunk), end_id, np.uint32), np.ones(len(chunk), np.int64)
        if self.table.count > WORDS:
            self.table = Table()
        lower, start, end, odd = self._units(chunk)
        hashes = np.maximum(K.word_hashes(lower, SimpleNamespace(start=start, end=end)), np.uint64(1))
        rows = self.table.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at, raw = missing[at], lower.tobytes()
            self._learn(new, [raw[i:j].decode("utf-8", "replace") for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)], odd[at])
            rows[missing] = self.table.find(hashes[missing])
        size = self.table.size[rows].astype(np.int64)
        before = np.cumsum(size) - size
        first = np.searchsorted(start, chunk.bounds)
        total = int(size.sum())
        each = np.diff(np.concatenate((before, [total]))[first]) + 1
        ids = np.full(total + len(chunk), end_id, np.uint32)
        unit = np.repeat(np.arange(len(size)), size)
        place = np.arange(total)
        text = np.searchsorted(first, np.arange(len(size)), "right") - 1
        ids[place + text[unit]] = self.table.ids[place + (self.table.start[rows] - before)[unit]]
        return ids, each


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for chunk in K.chunks(batch.column("text"), ENCODED_BYTES):
                ids, total = enc.encode(chunk, end_id)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, total[row] - start)
                bounds = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(chunk.first + row)), pa.array(start), pa.array(length), data, pa.array(total[row])], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long")


def _price(duals: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """The pattern of largest value: dynamic program over the used width, classes 1 to ``classes`` wide."""
    best, choice = np.zeros(classes + 1), np.zeros(classes + 1, np.int64)
    for w in range(1, classes + 1):
        values = duals[:w] + best[w - 1 :: -1][:w]
        k = int(values.argmax())
        if values[k] > best[w - 1] + 1e-12:
            best[w], choice[w] = values[k], k + 1
        else:
            best[w], choice[w] = best[w - 1], 0
    pattern, w = np.zeros(classes, np.int64), classes
    while w > 0:
        if choice[w]:
            pattern[choice[w] - 1] += 1
            w -= choice[w]
        else:
            w -= 1
    return best[classes], pattern


def solve_patterns(counts: np.ndarray, iterations: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses them. counts[i]: pieces of class i, which is i + 1 wide; a sequence is len(counts) wide.

    Any column's values are feasible when the iterations end, so their bound costs padding only.
    """
    classes = len(counts)
    here = np.flatnonzero(counts)
    if not len(here):
        return []
    columns = []
    for i in here:
        p = np.zeros(classes, np.int64)
        p[i] = classes // (i + 1)
        columns.append(p)
    basis = np.array(columns, float).T[here]
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ counts[here]
    for step in range(iterations):
        duals = np.zeros(classes)
        duals[here] = np.maximum(inverse.sum(0), 0)
        value, pattern = _price(duals, classes)
        if value <= 1 + 1e-7:
            break
        column = inverse @ pattern[here]
        ratio = np.full(len(x), np.inf)
        up = column > 1e-9
        ratio[up] = x[up] / column[up]
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        x -= ratio[leave] * column
        x[leave] = ratio[leave]
        np.maximum(x, 0, out=x)
        pivot = inverse[leave] / column[leave]
        inverse -= np.outer(column, pivot)
        inverse[leave] = pivot
        columns[leave] = pattern
        if step % 200 == 199:
            inverse = np.linalg.inv(np.array(columns, float).T[here])
    return list(zip(columns, x, strict=True))


def plan_sequences(counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole repeat counts that hold each piece once."""
    classes, left, plan = len(counts), counts.astype(np.int64).copy(), []
    for pattern, x in solve_patterns(counts):
        used = pattern > 0
        n = min(int(x + 1e-6), int((left[used] // pattern[used]).min())) if used.any() else 0
        if n:
            plan.append((pattern, n))
            left -= n * pattern
    while left.any():  # first fit, largest first, on what rounding left: a bounded number of pieces a pattern
        pattern, room = np.zeros(classes, np.int64), classes
        for i in range(classes - 1, -1, -1):
            take = min(int(left[i]), room // (i + 1))
            pattern[i] = take
            room -= take * (i + 1)
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, n))
        left -= n * pattern
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """pieces with sequence_id and offset. pieces needs doc_id, start, length (1 to capacity) and is read several times: give a stored table.

    Other columns stay, whatever their names; columns called sequence_id and offset are replaced.
    Ranks follow length, doc_id, start and then the piece's other columns, so that pieces that tie are equal.
    The plan is solved in one executor task from the classes' counts.
    """
    spark = pieces.sparkSession
    width = capacity // classes
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # Full sequences stand alone; the others get a class and a part of the class.
    kind = F.when(F.col("length") == capacity, F.lit(classes)).otherwise(F.ceil(F.col("length") / width)).cast("int")
    total = pieces.count()
    parts = max(16, -(-total // PART_ROWS))
    rows = pieces.select(F.struct(*[pieces[c] for c in columns]).alias("piece"), kind.alias("class"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).alias("part"))
    sizes = rows.groupBy("class", "part").count()
    sizes = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = sizes.select("class", "part", F.coalesce("before", F.lit(0)).alias("before"))
    in_class = Window.partitionBy("class", "part").orderBy(F.desc("piece.length"), "piece.doc_id", "piece.start", F.xxhash64(*[F.col("piece")[c] for c in columns if not isinstance(pieces.schema[c].dataType, T.MapType)]))
    ranked = rows.withColumn("rank", F.row_number().over(in_class) - 1).join(sizes, ["class", "part"])
    ranked = ranked.select("piece", "class", (F.col("rank") + F.col("before")).alias("rank"))

    counts = np.zeros(classes, np.int64)
    for row in rows.groupBy("class").count().collect():  # at most one row a class
        counts[row["class"] - 1] = row["count"]
    slots, first = [], 0
    taken = np.zeros(classes, np.int64)
    for pattern, n in in_task(spark, plan_sequences, counts):
        for i in np.flatnonzero(pattern):
            slots.append((int(i) + 1, int(taken[i]), int(taken[i] + n * pattern[i]), int(pattern[i]), first))
            taken[i] += n * pattern[i]
        first += n
    # Each class's runs of ranks, as sorted arrays in one row per class: at most CLASSES rows.
    by_class: dict[int, list] = {}
    for c, lo, hi, each, seq in slots:
        by_class.setdefault(c, []).append((lo, hi, each, seq))
    table = spark.createDataFrame([(c, sorted(v)) for c, v in by_class.items()], "class int, runs array<struct<lo:long,hi:long,each:long,seq:long>>")
    placed = ranked.join(F.broadcast(table), "class").withColumn("run", F.expr("filter(runs, r -> rank >= r.lo and rank < r.hi)[0]"))
    placed = placed.select("piece", "rank", F.expr("run.seq + (rank - run.lo) div run.each").alias("sequence_id"))
    in_order = Window.partitionBy("sequence_id").orderBy(F.desc("piece.length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("piece.length").over(in_order), F.lit(0)))
    return placed.select(*[F.col("piece")[c].alias(c) for c in columns], "sequence_id", "offset")
