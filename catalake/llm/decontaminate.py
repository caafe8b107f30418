"""Benchmark decontamination: gapped word pairs as seeds, then Smith-Waterman alignment.

Pairs of terms that stand at most one term apart, in an item and in a document, are
seeds. Every one of them counts, whatever its frequency. Where enough of an item's
pairs stand close together in a document, the passage around them is aligned with the
item by words; an alignment that reaches ``LEAST_SCORE`` of the item's own score is a
leak, so edited copies are found too.

No such alignment is missed. It has m matches and costs at most 2m - 2tL for an item
of L terms and a least score of t. Two matches that follow each other cost what stands
between them, which is 2 or more unless they are a seed; so at least tL - 1 of the
m - 1 are seeds, and all of it spans at most L(3 - 2t) terms of the document.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, so what each task
holds has a bound for a benchmark of any size; every block meets every document.

Defined results: terms are lower-cased (A-Z) runs of ASCII letters and digits and of
bytes beyond ASCII. Null and empty texts and items have no terms and leak nothing.
Items of one or two terms are found by that term or pair. Repeated rows and
repeated items each have their leaks; a null id is an id like any other. Of an item's
leaks in a document the one of the best score counts, then the first. An empty table of
documents or items gives no row. Only doc_id, text and item_id are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..session import broadcast_if_small
from . import kernels as K

BLOCK_WORDS = 1_000_000
LEAST_SCORE = 0.5
MATCH, MISS, GAP = 2, -1, -1
#: Terms from a pair's first to its second.
REACH = (1, 2)
#: Seeds that are held at once, and cells of a row of alignments.
HELD, CELLS = 2_000_000, 60_000


def terms_of(column: pa.Array) -> Iterator[tuple[K.Chunk, K.Words, np.ndarray]]:
    for chunk in K.chunks(column):
        lower = K.Chunk(K.LOWER[chunk.data], chunk.bounds, chunk.first)
        words = K.Words(lower, K.NOT_TERM)
        yield lower, words, K.word_hashes(lower.data, words)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.splitmix((left + np.uint64(2)) * np.uint64(K._MULTIPLIER) + right)


class Benchmark:
    """A block of items: their terms, and by the hash of a seed the items that have it."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.terms = ids, []
        for _, words, hashes in terms_of(pa.array([t or "" for t in texts], pa.string())):
            self.terms += [hashes[words.first[i] : words.first[i + 1]] for i in range(len(words.counts))]
        grams = [np.concatenate([_pairs(t[:-d], t[d:]) for d in REACH]) if len(t) > 1 else K.splitmix(t) for t in self.terms]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        all_grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(all_grams, kind="stable")
        self.item = item[order]
        self.keys, self.first, self.counts = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.size = np.array([len(t) for t in self.terms], np.int64)
        self.single = bool((self.size == 1).any())


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_words`` words: bounded, whatever the benchmark's size."""
    items = benchmark.select(F.col("item_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    blocks = max(1, -(-int(size) // (4 * block_words)))
    for k in range(blocks):
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)).collect()
        rows.sort(key=lambda r: (str(r["id"]), r["text"]))
        if rows:
            yield Benchmark([r["id"] for r in rows], [r["text"] for r in rows])


def passages(words: K.Words, hashes: np.ndarray, bench: Benchmark, least_score: float) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, end word) of every passage that may reach the least score, over the documents of a chunk."""
    doc = words.doc()
    spots, keys = [], []
    for d in REACH:
        at = np.flatnonzero(doc[:-d] == doc[d:])
        spots.append(at)
        keys.append(_pairs(hashes[at], hashes[at + d]))
    if bench.single:
        spots.append(np.arange(len(hashes)))
        keys.append(K.splitmix(hashes))
    at, key = np.concatenate(spots), np.concatenate(keys)
    if not len(at) or not len(bench.keys):
        return
    k = np.minimum(np.searchsorted(bench.keys, key), len(bench.keys) - 1)
    hit = bench.keys[k] == key
    at, k = at[hit], k[hit]
    order = np.argsort(at, kind="stable")
    at, k = at[order], k[order]
    least = np.maximum(1, np.ceil(least_score * bench.size - 1 - 1e-9)).astype(np.int64)
    span = np.maximum(np.ceil(bench.size * (3 - 2 * least_score)), bench.size).astype(np.int64) + max(REACH)
    # Whole documents together, as many as have HELD seeds.
    total = np.concatenate(([0], np.cumsum(bench.counts[k])))
    bounds = np.searchsorted(at, words.first)
    lo = 0
    while lo < len(words.counts):
        hi = max(lo + 1, int(np.searchsorted(total[bounds], total[bounds[lo]] + HELD, "right")) - 1)
        part = slice(bounds[lo], bounds[hi])
        lo = hi
        n = bench.counts[k[part]]
        if not len(n):
            continue
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, spot = bench.item[np.repeat(bench.first[k[part]], n) + step], np.repeat(at[part], n)
        order = np.argsort(item, kind="stable")
        item, spot = item[order], spot[order]
        # A seed from which enough seeds of its item follow in its document begins a passage.
        last = np.arange(len(item)) + least[item] - 1
        inside = np.minimum(last, len(item) - 1)
        begins = np.flatnonzero((last < len(item)) & (item[inside] == item) & (doc[spot[inside]] == doc[spot]) & (spot[inside] - spot <= span[item]))
        item, spot = item[begins], spot[begins]
        if not len(item):
            continue
        new = np.flatnonzero((item[1:] != item[:-1]) | (doc[spot[1:]] != doc[spot[:-1]]) | (spot[1:] - spot[:-1] > 2 * span[item[1:]])) + 1
        for i, j in zip([0, *new], [*new, len(item)], strict=True):
            d, m = int(doc[spot[i]]), int(item[i])
            a, b = max(int(words.first[d]), int(spot[i] - span[m])), min(int(words.first[d + 1]), int(spot[j - 1] + span[m]) + 1)
            # A match is worth two, so so many of the item's terms must be there.
            if np.isin(bench.terms[m], hashes[a:b]).sum() >= least_score * bench.size[m] - 1e-9:
                yield d, m, a, b


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair of term arrays, and the end of the alignment in b (exclusive). All pairs advance together, a row of a at a time."""
    n, la, lb = len(a), max(map(len, a)), max(map(len, b))
    left, right = np.zeros((n, la), np.uint64), np.zeros((n, lb), np.uint64)
    for i in range(n):
        left[i, : len(a[i])], right[i, : len(b[i])] = a[i], b[i]
    a_len, b_len = np.array([*map(len, a)]), np.array([*map(len, b)])
    inside = np.arange(lb)[None, :] < b_len[:, None]
    h = np.zeros((n, lb + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    drop = np.arange(lb + 1, dtype=np.int32) * -GAP
    for i in range(la):
        live = (i < a_len)[:, None]
        step = np.where((left[:, i, None] == right) & inside & live, MATCH, MISS).astype(np.int32)
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + step, h[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + drop, axis=1) - drop  # gaps in b: the best start so far, less its distance
        new[:, 1:][~inside] = 0
        h = np.where(live, new, h)
        row = h.max(1)
        better = row > best
        end[better] = h[better].argmax(1)
        best = np.maximum(best, row)
    return best, end


def leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score (of the item's own), start and end (code points) of the best leak of each item in each document."""
    out = None
    for bench in benchmark_blocks(benchmark):
        found = _leaks_of(docs, bench, least_score, benchmark.schema["item_id"].dataType)
        out = found if out is None else out.unionByName(found)
    if out is None:
        id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, score double, start long, end long")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("back"), "start", "end")).alias("m"))
    return best.select("doc_id", "item_id", "m.score", "m.start", "m.end")


def _leaks_of(docs: DataFrame, bench: Benchmark, least_score: float, item_type: DataType) -> DataFrame:
    terms, ids = bench.terms, bench.ids

    def scored(hashes: np.ndarray, jobs: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, score, first word, end word) of the passages that reach the least score, those of like length together."""
        jobs.sort(key=lambda j: j[3] - j[2])
        lo = 0
        while lo < len(jobs):
            hi = lo + 1
            while hi < len(jobs) and (hi + 1 - lo) * (jobs[hi][3] - jobs[hi][2]) <= CELLS:
                hi += 1
            part, lo = jobs[lo:hi], hi
            score, end = align([terms[m] for _, m, _, _ in part], [hashes[a:b] for _, _, a, b in part])
            own = np.array([MATCH * len(terms[m]) for _, m, _, _ in part])
            good = np.flatnonzero(score >= least_score * own - 1e-9).tolist()
            if good:
                _, back = align([terms[part[g][1]][::-1] for g in good], [hashes[part[g][2] : part[g][2] + end[g]][::-1] for g in good])
                for g, r in zip(good, back.tolist(), strict=True):
                    d, m, a, _ = part[g]
                    yield d, m, float(score[g] / own[g]), a + int(end[g]) - r, a + int(end[g])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(item_type)
        for batch in batches:
            doc_ids, out = batch.column("doc_id"), []
            for chunk, words, hashes in terms_of(batch.column("text")):
                found = list(scored(hashes, list(passages(words, hashes, bench, least_score))))
                points = K.code_points(chunk.data) if found else None
                for d, m, score, first, end in found:
                    base = points[chunk.bounds[d]]
                    out.append((chunk.first + d, ids[m], score, int(points[words.start[first]] - base), int(points[words.end[end - 1]] - base)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kind), *[pa.array(c, t) for c, t in zip(cols[2:], (pa.float64(), pa.int64(), pa.int64()), strict=True)]], names=["doc_id", "item_id", "score", "start", "end"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, item_id {item_type.simpleString()}, score double, start long, end long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that leak an item; all columns stay, and rows without an id stay."""
    gone = leaks(docs, benchmark, least_score).select("doc_id").distinct()
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
