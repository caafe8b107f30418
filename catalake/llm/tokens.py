"""Exact token counts at every prefix, by dynamic programming over prefixes.

For a byte-pair encoder, a sequence of tokens is the encoding of its text if and
only if each token and each neighbouring pair of tokens encodes to itself. So the
encoding of a prefix ends in the one token t for which the shorter prefix's last
token and t form such a pair, and the count is the shorter prefix's count plus 1.
One pass over a text gives the count of every prefix, which answers truncation
and budget questions without encoding again.

Pieces of the model carry the space mark only at their start, so no merge crosses
from a word to a following space: the program runs per run of spaces plus word,
and counts of a text's prefixes are sums over its runs. Runs repeat, so their
results are kept in a bounded table.

Defined results: null and empty texts have 0 tokens. Characters outside the
vocabulary count their UTF-8 bytes (byte fallback). Repeated rows count alike, and so do
rows without an id. A count equal to the limit is not over it. An empty table gives no
row. ``count_tokens`` reads doc_id and text only; ``truncate_texts`` gives all columns
back, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

LIMIT = 4096
#: Bounds of the tables of a worker process. The table of runs has two
#: generations of this size: a run found in the old one moves to the new one.
RUNS, PAIRS = 500_000, 500_000
MARK = "▁"


class PrefixCounter:
    """Prefix counts for one sentencepiece BPE model."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        # Without a newline in any piece, and with the mark only at a piece's start, runs are independent.
        self.by_run = not any(MARK in pieces[i].lstrip(MARK) for i in plain)
        self.by_line = not any("\n" in pieces[i] for i in plain)
        self.pieces = {pieces[i]: i for i in plain}
        self.names = pieces
        self.pairs: dict[int, bool] = {}
        self.runs: dict[str, int] = {}
        self.old_runs: dict[str, int] = {}
        self.finder = ahocorasick.Automaton()
        for t, i in self.pieces.items():
            if self._encodes_to(t, [t]):
                self.finder.add_word(t, (i, len(t)))
        self.finder.make_automaton()
        self.letters = frozenset(t for t in self.pieces if len(t) == 1)

    def _encodes_to(self, text: str, parts: list[str]) -> bool:
        """Whether the model cuts text, as it stands between other text, into just these parts."""
        # The newline keeps the model's own leading mark apart from the text.
        return self.lib.encode("\n" + text, out_type=str)[2:] == parts

    def _fits(self, key: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.names[key >> 32], self.names[key & 0xFFFFFFFF]
        ok = self.pairs[key] = self._encodes_to(a + b, [a, b])
        return ok

    def prefixes(self, run: str) -> list[int]:
        """Tokens of run[:0], run[:1], ...; run has marks for spaces and is not preceded by anything that merges with it."""
        if self.letters.issuperset(run):
            return self._known(run)
        # Characters outside the vocabulary are their bytes, which merge with nothing and so part the run.
        out, at = [0], 0
        for k, c in enumerate(run):
            if c not in self.letters:
                if k > at:
                    out += [out[at] + n for n in self._known(run[at:k])[1:]]
                out.append(out[k] + len(c.encode("utf-8", "surrogatepass")))
                at = k + 1
        if at < len(run):
            out += [out[at] + n for n in self._known(run[at:])[1:]]
        return out

    def _known(self, run: str) -> list[int]:
        counts, last, done, pairs = [0] * (len(run) + 1), [-1] * (len(run) + 1), 0, self.pairs
        for end, (piece, length) in self.finder.iter(run):
            if end >= done:
                start = end + 1 - length
                if start:
                    key = last[start] << 32 | piece
                    ok = pairs.get(key)
                    if ok is None:
                        ok = self._fits(key)
                    if not ok:
                        continue
                done = end + 1
                counts[done] = counts[start] + 1
                last[done] = piece
        return counts

    def _run_count(self, run: str) -> int:
        """run: a word with the marks before it as spaces, or a newline and what follows it."""
        n = self.runs.get(run)
        if n is None:
            if len(self.runs) >= RUNS:
                self.runs, self.old_runs = {}, self.runs
            n = self.old_runs.get(run)
            if n is None:
                n = self.prefixes(run.replace(" ", MARK))[-1]
            self.runs[run] = n
        return n

    def _runs_of(self, text: str) -> list[str]:
        """The runs of a text. They spell the text with one space before it."""
        if not self.by_run:
            return [" " + text]
        if self.by_line and "\n" in text:
            return re.findall(r" +[^ \n]*|\n[^ \n]*|[^ \n]+", " " + text)
        if "  " in text or text[0] == " " or text[-1] == " ":
            return re.findall(r" +[^ ]*", " " + text)
        return [" " + w for w in text.split(" ")]

    def count(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        get, count = self.runs.get, self._run_count
        return sum([get(r) or count(r) for r in self._runs_of(text)])

    def all_prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text: the prefix's own encoding by the model."""
        if not text:
            return np.zeros(1, np.int64)
        out, base = [0], 0
        for k, run in enumerate(self._runs_of(text)):
            inner = self.prefixes(run.replace(" ", MARK))
            out += [base + c for c in (inner[2:] if k == 0 else inner[1:])]
            base += inner[-1]
        return np.array(out, np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens, found in the table of prefixes."""
        table = self.all_prefixes(text)
        fits = np.flatnonzero(table <= budget)
        return text[: int(fits[-1])] if len(fits) else ""

    def fits(self, texts: list[str], budget: int) -> int:
        """How many of the texts, in order, fit one budget together."""
        return bisect_right(list(accumulate(map(self.count, texts))), budget)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a model file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            offsets, _ = K.string_buffers(batch.column("text"))
            tokens = np.array([count(x.as_py()) for x in batch.column("text")], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def truncate_texts(docs: DataFrame, model_path: str, budget: int) -> DataFrame:
    """docs with text cut to its longest prefix of at most ``budget`` tokens; null stays null."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            k = batch.schema.get_field_index("text")
            cut = pa.array([None if x is None else c.truncate(x, budget) for x in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), cut)

    return docs.select(*columns).mapInArrow(run, docs.schema)
