"""Scores of texts by an interpolated n-gram model: deleted interpolation, counted and looked up in one exchange.

A text's tokens are its words (runs without white space, A-Z lower-cased) and one end.
Maximum-likelihood estimates of each order are mixed with the order below, down to a
uniform one over the known words and one unknown; the weight of an order depends on how
often its context was seen (buckets by powers of two), and is learned by expectation-
maximisation on the counts of training documents that the estimates leave out. The
estimates that score have all training documents.

Texts are gathered into chunks of bounded bytes. A chunk asks for each n-gram of its
texts once: it sends the n-gram's hash, in the bucket of that hash, with its own counts,
so the request is the count as well. A bucket sums the counts over chunks and answers
each chunk in the order of its request. So a frequent n-gram costs one entry a chunk, no
key is hot, and no table of n-grams meets the documents row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import kernels as K

#: Bytes of text in a chunk (a longer text is a chunk of its own), and bytes of all texts for each bucket of n-grams.
CHUNK, BUCKET = 12 << 20, 16 << 20
#: One training document in so many is left out of the estimates that the weights are learned on.
LEFT_OUT = 16
#: Rounds of expectation-maximisation at most, and the change of a weight that ends them.
ROUNDS, CLOSE = 40, 1e-4
#: No weight is above this, so that an n-gram never seen has a probability.
MOST_WEIGHT = 0.9999
#: Context frequencies are told apart by their bit length.
LENGTHS = 64
_START, _END = np.uint64(0x1B5A_71D3_9E02_44C1), np.uint64(0x6F1D_93E7_0A5B_2C83)
_COUNTED, _OUT, _HELD = 0, 1, 2
_LOW = (1 << 48) - 1


def held_out(doc_id: Column) -> Column:
    """Documents never learned from; one without an id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def chunked(docs: DataFrame) -> DataFrame:
    """Stored chunks: chunk, left_out (its documents are for the weights), n_docs, n_counted (those that count), bytes, docs (doc_id, fold and text, compressed)."""
    # The fold comes from other bits of the id than held_out, which takes a crc32.
    fold = F.when(held_out(docs["doc_id"]), _HELD).when(F.pmod(F.xxhash64(docs["doc_id"]), F.lit(LEFT_OUT)) == 0, _OUT).otherwise(_COUNTED)
    rows = docs.select(docs["doc_id"], fold.cast("byte").alias("fold"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.Table]] = {False: [], True: []}
        size, made, task = {False: 0, True: 0}, 0, TaskContext.get().partitionId()

        def flush(out: bool) -> pa.RecordBatch:
            nonlocal made
            table = pa.concat_tables(held[out])
            counted = pc.sum(pc.equal(table["fold"], _COUNTED)).as_py() or 0
            row = [[(task << 32) + made], [out], [table.num_rows], [counted], [size[out]], [_packed(table)]]
            made += 1
            held[out], size[out] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "left_out", "n_docs", "n_counted", "bytes", "docs"])

        for batch in batches:
            for out in (False, True):
                part = pa.Table.from_batches([batch]).filter(pc.equal(batch["fold"], _OUT) if out else pc.not_equal(batch["fold"], _OUT))
                ends = np.cumsum(pc.binary_length(part["text"]).to_numpy().astype(np.int64))
                at = 0
                while at < part.num_rows:
                    before = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, before + CHUNK - size[out], "right")))
                    held[out].append(part.slice(at, to - at))
                    size[out] += int(ends[to - 1]) - before
                    at = to
                    if size[out] >= CHUNK or at < part.num_rows:
                        yield flush(out)
        for out in (False, True):
            if held[out]:
                yield flush(out)

    return checkpointed(rows.mapInArrow(run, "chunk long, left_out boolean, n_docs long, n_counted long, bytes long, docs binary"))


@dataclass
class Grams:
    """n-grams of some texts: ``keys[k - 1]`` has a 64-bit key for each token and the k - 1 before it; ``sizes`` are tokens a text."""

    keys: list[np.ndarray]
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.ChunkedArray, order: int) -> Grams:
        keys: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(order)]
        sizes = [np.zeros(0, np.int64)]
        for piece in texts.chunks:
            for chunk in K.chunks(piece):
                data = K.LOWER[chunk.data]
                words = K.Words(K.Chunk(data, chunk.bounds, 0))
                n = words.counts + 1
                at = np.concatenate(([0], np.cumsum(n + order - 1)))
                line = np.full(at[-1], _START)
                doc = words.doc()
                line[at[doc] + order - 1 + np.arange(len(words)) - words.first[doc]] = K.word_hashes(data, words)
                line[at[1:] - 1] = _END
                token = np.arange(int(n.sum())) + (order - 1) * (np.repeat(np.arange(len(n)), n) + 1)
                with np.errstate(over="ignore"):
                    run = np.zeros(len(token), np.uint64)
                    for k in range(order):
                        run = line[token] if k == 0 else run + K.splitmix(line[token - k] + np.uint64(k))
                        keys[k].append(K.splitmix(run + np.uint64((k + 1) * 0x9E37)))
                sizes.append(n)
        return cls([np.concatenate(k) for k in keys], np.concatenate(sizes))

    def firsts(self) -> np.ndarray:
        """Places of the texts' first tokens."""
        return np.cumsum(self.sizes) - self.sizes


def _bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted keys begins; bucket b has those whose share of the range of keys is in its own, the b-th of equal ones."""
    least = -(-(np.arange(buckets + 1, dtype=object) << 64) // buckets)
    return np.concatenate([np.searchsorted(keys, np.array(least[:-1], np.uint64)), [len(keys)]])


def _six(keys: np.ndarray) -> bytes:
    """The low six bytes of each key; with its bucket they identify it."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def requests(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """gram_order, bucket, chunk, keys (six bytes each), counted, left_out (32-bit counts): each n-gram of a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _unpacked(data.as_py())
                grams = Grams.of(table["text"], order)
                fold = np.repeat(table["fold"].to_numpy(), grams.sizes)
                for k, keys in enumerate(grams.keys):
                    unique, place = np.unique(keys, return_inverse=True)
                    counts = [np.bincount(place[fold == f], minlength=len(unique)).astype("<u4") for f in (_COUNTED, _OUT)]
                    at = _bucket_bounds(unique, buckets)
                    some = np.flatnonzero(np.diff(at))
                    cut = [slice(int(at[b]), int(at[b + 1])) for b in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), k + 1, np.int32)), pa.array(some.astype(np.int64)), pa.array(np.full(len(some), chunk)), pa.array([_six(unique[s]) for s in cut], pa.binary()), *(pa.array([c[s].tobytes() for s in cut], pa.binary()) for c in counts)],
                        names=["gram_order", "bucket", "chunk", "keys", "counted", "left_out"],
                    )

    return chunks.select("chunk", "docs").mapInArrow(run, "gram_order int, bucket long, chunk long, keys binary, counted binary, left_out binary")


def answers(asked: DataFrame) -> DataFrame:
    """Stored answers: gram_order, bucket, chunk, counts (of both folds over all chunks, in the order of the request, compressed); known, counted and left_out are the bucket's n-grams with a count and the sums of their counts, in one row a bucket."""

    def run(table: pa.Table) -> pa.Table:
        sent = [_from_six(k) for k in table["keys"].to_pylist()]
        _, place = np.unique(np.concatenate(sent), return_inverse=True)
        totals = []
        for name in ("counted", "left_out"):
            each = np.frombuffer(b"".join(table[name].to_pylist()), "<u4")
            totals.append(np.bincount(place, weights=each).astype(np.int64))  # exact below 2^53
        ends = np.cumsum([len(s) for s in sent])
        packed = [pa.compress(np.concatenate([t[place[e - len(s) : e]] for t in totals]).astype("<i8").tobytes(), "zstd", asbytes=True) for s, e in zip(sent, ends, strict=True)]
        once = np.zeros((3, len(sent)), np.int64)
        once[:, 0] = int((totals[0] + totals[1] > 0).sum()), int(totals[0].sum()), int(totals[1].sum())
        columns = [table["gram_order"], table["bucket"], table["chunk"], pa.array([len(s) for s in sent], pa.int64()), pa.array(packed, pa.binary()), *map(pa.array, once)]
        return pa.Table.from_arrays(columns, names=["gram_order", "bucket", "chunk", "n", "counts", "known", "counted", "left_out"])

    return checkpointed(asked.groupBy("gram_order", "bucket").applyInArrow(run, "gram_order int, bucket long, chunk long, n long, counts binary, known long, counted long, left_out long"))


def _looked_up(grams: Grams, answer: pa.Table) -> list[np.ndarray]:
    """For each order, the two counts of every token's n-gram (an array of two rows)."""
    answer = answer.sort_by([("gram_order", "ascending"), ("bucket", "ascending")])
    orders, n, data = answer["gram_order"].to_numpy(), answer["n"].to_numpy(), answer["counts"]
    out = []
    for k, keys in enumerate(grams.keys):
        parts = [np.frombuffer(pa.decompress(data[int(i)].as_py(), int(n[i]) * 16, "zstd"), "<i8").reshape(2, -1) for i in np.flatnonzero(orders == k + 1)]
        out.append(np.concatenate(parts, 1)[:, np.unique(keys, return_inverse=True)[1]])
    return out


def _contexts(counts: list[np.ndarray], firsts: np.ndarray, tokens: int, texts: int) -> list[np.ndarray]:
    """How often the context of each token was seen, by order: all tokens, then the count of the shorter n-gram before it; before a text's first token, the number of texts."""
    out = [np.full(len(counts[0]), tokens, np.int64)]
    for c in counts[:-1]:
        before = np.empty(len(c), np.int64)
        before[1:] = c[:-1]
        before[firsts] = texts
        out.append(before)
    return out


def _length(context: np.ndarray) -> np.ndarray:
    """Bit lengths of counts."""
    return np.frexp(context.astype(float))[1]


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.divide(c, x, out=np.zeros(len(c)), where=x > 0) for c, x in zip(counts, contexts, strict=True)]


def _with(chunks: DataFrame, answer: DataFrame, run, schema: str) -> DataFrame:
    return chunks.select("chunk", "docs").groupBy("chunk").cogroup(answer.select("chunk", "gram_order", "bucket", "n", "counts").groupBy("chunk")).applyInArrow(run, schema)


def weights(chunks: DataFrame, answer: DataFrame, order: int, tokens: int, texts: int, uniform: float) -> np.ndarray:
    """weight[k - 1, b]: how much of order k's mixture is its own estimate where its context's count has b bits; the rest is order k - 1's.

    Expectation-maximisation over the left-out documents' tokens, against estimates from the
    counted ones (``tokens`` tokens of ``texts`` texts). A context never seen has weight 0; a
    length that no left-out token has takes the weight of the nearest shorter one that has,
    else of the nearest longer one, and 0.5 where there is none.
    """

    def features(docs: pa.Table, answer: pa.Table) -> pa.Table:
        parts = []
        for data in docs["docs"].to_pylist():
            grams = Grams.of(_unpacked(data)["text"], order)
            counts = [c[0] for c in _looked_up(grams, answer)]
            contexts = _contexts(counts, grams.firsts(), tokens, texts)
            rows, n = np.unique(np.column_stack([*counts, *contexts]), axis=0, return_counts=True)
            parts.append(pa.compress(np.column_stack([rows, n]).astype("<i8").T.tobytes(), "zstd", asbytes=True))
            parts.append(len(rows))
        return pa.table({"n": pa.array(parts[1::2], pa.int64()), "rows": pa.array(parts[::2], pa.binary())})

    stored = checkpointed(_with(chunks.where("left_out"), answer.join(chunks.where("left_out").select("chunk"), "chunk", "left_semi"), features, "n long, rows binary"))
    weight = np.full((order, LENGTHS), 0.5)
    weight[:, 0] = 0

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, reached = np.zeros((order, LENGTHS)), np.zeros((order, LENGTHS))
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(pa.decompress(data.as_py(), n * (2 * order + 1) * 8, "zstd"), "<i8").reshape(2 * order + 1, -1)
                counts, contexts, left = list(rows[:order]), list(rows[order:-1]), rows[-1].astype(float)
                own = _estimates(counts, contexts)
                mixed = [np.full(len(left), uniform)]
                bits = [_length(x) for x in contexts]
                for k in range(order):
                    w = weight[k, bits[k]]
                    mixed.append(w * own[k] + (1 - w) * mixed[-1])
                for k in reversed(range(order)):
                    mine = left * weight[k, bits[k]] * own[k] / mixed[k + 1]
                    reached[k] += np.bincount(bits[k], left, LENGTHS)
                    used[k] += np.bincount(bits[k], mine, LENGTHS)
                    left = left - mine
        at = np.flatnonzero(reached.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(used.ravel()[at]), pa.array(reached.ravel()[at])], names=["i", "used", "reached"])

    for _ in range(ROUNDS):
        new, told = weight.copy(), np.zeros(weight.size, bool)
        sums = stored.mapInArrow(expected, "i long, used double, reached double").groupBy("i").agg(F.sum("used").alias("used"), F.sum("reached").alias("reached"))
        for row in sums.collect():  # at most order x LENGTHS rows
            new.flat[row["i"]] = min(row["used"] / row["reached"], MOST_WEIGHT) if row["reached"] > 0 else 0.5
            told[row["i"]] = True
        told = told.reshape(weight.shape)
        new[:, 0] = 0
        for k in range(order):
            have = [b for b in range(1, LENGTHS) if told[k, b]]
            for b in range(1, LENGTHS):
                if not told[k, b]:
                    new[k, b] = new[k, max([h for h in have if h < b] or have[:1])] if have else 0.5
        change, weight = float(np.abs(new - weight).max()), new
        if change < CLOSE:
            break
    return weight


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    docs needs doc_id and text; other columns don't matter. Rows whose id is held out (see
    ``held_out``) are scored and never learned from; rows without an id are learned from.
    A null text counts as empty: its only token is the end. Repeated rows are rows of their
    own. Without training documents every probability is that of the one unknown word, 1.
    An empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunked(docs)
    sizes = chunks.agg(F.sum("bytes").alias("bytes"), F.sum("n_counted").alias("counted"), F.sum(F.when(F.col("left_out"), F.col("n_docs"))).alias("out")).first()
    buckets = max(8, -(-(sizes["bytes"] or 0) * order // BUCKET))
    answer = answers(requests(chunks, order, buckets))
    known = answer.where("gram_order = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "counted", "left_out")]).first()
    words, tokens = known["known"], known["counted"] + known["left_out"]
    uniform = 1 / (words + 1)
    counted, texts = sizes["counted"] or 0, (sizes["counted"] or 0) + (sizes["out"] or 0)
    weight = weights(chunks, answer, order, known["counted"], counted, uniform)

    def run(docs: pa.Table, answer: pa.Table) -> pa.Table:
        out = []
        for data in docs["docs"].to_pylist():
            table = _unpacked(data)
            grams = Grams.of(table["text"], order)
            counts = [c.sum(0) for c in _looked_up(grams, answer)]
            first = grams.firsts()
            contexts = _contexts(counts, first, tokens, texts)
            p = np.full(len(counts[0]), uniform)
            for k, own in enumerate(_estimates(counts, contexts)):
                w = weight[k, _length(contexts[k])]
                p = w * own + (1 - w) * p
            base = np.log10((counts[0] + 1) / (tokens + words + 1))
            sums = [np.add.reduceat(v, first) for v in ((counts[0] > 0).astype(np.int64), base, np.log10(p))]
            out.append(pa.table([table["doc_id"], pc.equal(table["fold"], _HELD), pa.array(grams.sizes), pa.array(sums[0]), pa.array(np.full(len(first), tokens)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    return _with(chunks, answer, run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
