"""Spelling variants: words of a corpus one edit apart, and the frequent form each of them leads to.

Positional q-grams: a word of L code points, padded by two marks on each side, has L + 2
trigrams. One edit changes at most three, so two near words share at least (length of the
longer) - 1 of them, at the same place or, behind an inserted code point, one place later.

The inverted index is dealt out by rare trigrams. Trigrams have one order, rarest first
(an equal trigram's second occurrence is an element of its own). By the count bound two
near words share an element among the first four of each, so words meet in the groups of
their first four elements and of their length. A group's postings (trigram, place) are
merged for a block of its words at a time, under the length and place limits; pairs at the
count bound are verified, and a pair counts only in the group of the first elements it
shares. A group of more than ``HOT`` words is split by the next element: two near words
share at least two among the first five, three among the first six, and so on, so no
pair is lost and no group is capped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpointed

#: Words of fewer code points or occurrences are no words of the vocabulary.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many runs of a document loses a code point.
MISSPELT = 97
#: Words of a group before it is split by a further element.
HOT = 3000
#: Elements that a group's key has at most. A key of eight leaves a word little room to differ, so such groups aren't split.
DEEPEST = 8
#: Distinct words that a task gathers before it passes their counts on, words and pairs of postings that it merges at once.
GATHERED, BLOCK_WORDS, BLOCK_PAIRS = 200_000, 20_000, 4_000_000
_NOT_LATIN = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_WORD_BYTES = bytes(b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z alone lower-cased, as UTF-8."""
    return _NOT_LATIN.sub(b" ", text.encode().lower()).translate(_WORD_BYTES).split()


def misspelt(word: bytes, h: int) -> bytes:
    """The word without its code point h % length."""
    points = word.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of every word of the texts that is long and frequent enough.

    Before counting, a run whose crc32 with its document's id (a null id is empty text) is
    divisible by ``MISSPELT`` loses one code point. A null text has no words.
    """
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= least_length]  # no word has more code points than bytes
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = Counter(runs(text.as_py()))
                salt = zlib.crc32(f"{doc_id}:".encode())
                for word in [w for w in mine if len(w) >= least_length and not zlib.crc32(w, salt) % MISSPELT]:  # shorter ones are dropped either way
                    held[misspelt(word, zlib.crc32(word, salt))] += mine.pop(word)
                held.update(mine)
                if len(held) > GATHERED:
                    yield flush()
        yield flush()

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the padded words' trigrams, the word of each and its place."""
    sizes = np.array([len(w) for w in words], np.int64) + 2
    points = np.frombuffer("".join(f"\x01\x01{w}\x01\x01" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(word)) + 2 * word
    return (points[at] << 42) | (points[at + 1] << 21) | points[at + 2], word, place


def trigram_ranks(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the vocabulary, sorted, and the rank of each by the number of words that have it.

    Their number is bounded by the alphabet: 26 letters, 64 code points from U+00C0 and the
    pad give at most 91^3 = 753,571, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gram, word, _ = trigrams(batch.column(0).to_pylist())
                order = np.lexsort((word, gram))
                gram, word = gram[order], word[order]
                new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (word[1:] != word[:-1])))
                unique, n = np.unique(gram[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n.astype(np.int64))], names=["gram", "n"])

    table = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((gram, n))] = np.arange(len(gram))
    order = np.argsort(gram)
    return gram[order], rank[order]


def with_elements(words: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """word, n and elements: the first of its trigrams' elements in the common order, as many as the deepest key may need."""
    grams, ranks = trigram_ranks(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, word, _ = trigrams(batch.column(0).to_pylist())
            rank = ranks[np.searchsorted(grams, gram)]
            order = np.lexsort((rank, word))
            rank, word = rank[order], word[order]
            at = np.arange(len(rank))
            same = np.concatenate(([False], (rank[1:] == rank[:-1]) & (word[1:] == word[:-1])))
            nth = at - np.maximum.accumulate(np.where(same, 0, at))
            first = np.searchsorted(word, np.arange(batch.num_rows))
            keep = at - first[word] < depth + 3
            element = (rank[keep] << 24) | np.minimum(nth[keep], (1 << 24) - 1)
            ends = np.concatenate(([0], np.cumsum(np.bincount(word[keep], minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(element))], names=["word", "n", "elements"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, elements array<long>")


def grouped(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Stored groups: size and key (what the words of a group share), word, n and elements.

    A word stands in groups of its own length and, as the longer partner, of the length below.
    """
    length = F.char_length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    now = words.select("word", "n", "elements", sizes).select("*", F.explode(F.slice("elements", 1, 4)).alias("e")).select("size", F.array("e").alias("key"), "word", "n", "elements")
    done = None
    for level in range(1, DEEPEST + 1):
        now = checkpointed(now)
        # Words of length L share at least L - 1 elements, so a key of more would lose pairs.
        large = now.groupBy("size", "key").count().where((F.col("count") > hot) & (F.size("key") <= F.col("size") - 2)).select("size", "key")
        if level == DEEPEST or large.isEmpty():
            return now if done is None else done.unionByName(now)
        large = broadcast_if_small(large)
        small = now.join(large, ["size", "key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        # The key's next element comes after its last one in the order, among the first 4 + level.
        more = F.explode(F.filter(F.slice("elements", 1, 4 + level), lambda e: e > F.element_at("key", -1))).alias("e")
        now = now.join(large, ["size", "key"], "left_semi").select("size", "key", "word", "n", "elements", more).select("size", F.concat("key", F.array("e")).alias("key"), "word", "n", "elements")
    raise AssertionError("unreachable")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the words apart; b isn't shorter than a."""
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def merged(group: np.ndarray, size: np.ndarray, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words of one group that share enough positional trigrams, the shorter (or earlier) one first.

    The index holds the words of the group's own length; every word's postings are looked
    up in it and merged, for as many words at a time as ``BLOCK_PAIRS`` postings allow.
    """
    gram, word, place = trigrams(words)
    lengths = np.array([len(w) for w in words], np.int64)
    longer = lengths > size
    _, gram = np.unique(gram, return_inverse=True)
    # Postings have the group, trigram and place in one number.
    wide, deep = int(gram.max()) + 1, int(place.max()) + 2
    key = (group[word] * wide + gram) * deep + place
    own = ~longer[word]
    order = np.argsort(key[own], kind="stable")
    index, index_word = key[own][order], word[own][order]
    # A longer word's trigram meets the same place or the one before.
    behind = longer[word] & (place > 0)
    asked, asker = np.concatenate([key, key[behind] - 1]), np.concatenate([word, word[behind]])
    low, high = np.searchsorted(index, asked), np.searchsorted(index, asked, "right")
    # Of two words of one length the later one asks: up to its own posting.
    high[np.flatnonzero(own)[order]] = np.arange(len(index))
    order = np.argsort(asker, kind="stable")
    asker, low, high = asker[order], low[order], high[order]
    met = np.maximum(high - low, 0)
    ends = np.cumsum(met)
    starts = np.searchsorted(asker, np.arange(len(words)))
    begin = 0
    while begin < len(words):
        done = int(ends[starts[begin] - 1]) if starts[begin] else 0
        end = begin + 1
        stop = np.searchsorted(ends, done + BLOCK_PAIRS, "right")
        if stop < len(asker):
            end = max(end, int(asker[stop]))
        else:
            end = len(words)
        at = slice(int(starts[begin]), int(starts[end]) if end < len(words) else len(asker))
        count = met[at]
        total = int(count.sum())
        if total:
            offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            left = index_word[np.repeat(low[at], count) + offset]
            right = np.repeat(asker[at], count)
            code, shared = np.unique(right * len(words) + left, return_counts=True)
            left, right = code % len(words), code // len(words)
            enough = shared >= lengths[right] - 1
            yield left[enough], right[enough]
        begin = end


def near_pairs(groups: DataFrame) -> DataFrame:
    """word, near and near_n: every ordered pair of words one edit apart, once."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        words, n = rows["word"].to_pylist(), rows["n"].to_pylist()
        keys, elements = rows["key"].to_pylist(), rows["elements"].to_pylist()
        size, group = rows["size"].to_numpy().astype(np.int64), rows["group"].to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for left, right in merged(np.concatenate(([0], np.cumsum(group[1:] != group[:-1]))), size, words):
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                if keys[i] == keys[j] and one_edit(words[i], words[j]):
                    other = set(elements[j])
                    if [e for e in elements[i] if e in other][: len(keys[i])] == keys[i]:
                        for a, b in ((i, j), (j, i)):
                            out[0].append(words[a])
                            out[1].append(words[b])
                            out[2].append(n[b])
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:  # sorted by group: whole groups are settled, the last one waits for the next batch
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < BLOCK_WORDS:
                continue
            table = pa.concat_tables(held)
            group = table["group"].to_numpy()
            at = int(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[-1])
            if at:
                yield settle(table.slice(0, at))
            held = [table.slice(at)]
        if held:
            yield settle(pa.concat_tables(held))

    marked = groups.withColumn("group", F.xxhash64("size", "key"))
    dealt = marked.repartition("group").sortWithinPartitions("group", "size", "key", "word")
    return dealt.select("group", "size", "key", "word", "n", "elements").mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows word and form (null: its own root), by pointers that double each round.

    A form is at least twice as frequent as its word, so the paths have no cycle and at most
    as many steps as the largest count has bits. Rows that have arrived leave the rounds.
    """
    done = forms.where("form is null").select("word", F.col("word").alias("root"))
    open_ = steps = forms.where("form is not null").select("word", F.col("form").alias("to"))
    while not open_.isEmpty():
        moved = checkpointed(open_.join(steps.toDF("to", "next"), "to", "left").select("word", "to", "next"))
        arrived = moved.where("next is null").select("word", "to")
        done = done.unionByName(arrived.withColumnRenamed("to", "root"))
        # Words that have arrived stay as steps for others.
        open_ = moved.where("next is not null").select("word", F.col("next").alias("to"))
        steps = checkpointed(steps.join(moved.select("word"), "word", "left_anti").unionByName(arrived).unionByName(open_))
    return done


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    form is the near word of largest n (ties: the smallest in code-point order) if it is at
    least twice as frequent; root is where forms lead. docs needs doc_id and text; other
    columns don't matter, and repeated rows count as often as they come. An empty table, or
    one without frequent words, gives no rows.
    """
    words = checkpointed(vocabulary(docs, least_length, least_count))
    pairs = near_pairs(grouped(with_elements(words), hot))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    joined = words.join(best, "word", "left")
    twice = -F.col("b.m") >= 2 * F.col("n")
    known = checkpointed(joined.select("word", F.when(twice, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(twice, -F.col("b.m")).alias("form_n")))
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")
