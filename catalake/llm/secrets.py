"""Secret scans: fixed patterns, and sliding-window Shannon entropy.

Fixed patterns are searched leftmost and without overlap, kind by kind. Candidate
strings (long runs of key characters) are also scanned with a window per character
class; the entropy of each window follows from the last one's counts by one
character in and one out. A candidate whose best window reaches its class's
threshold is a secret, unless the allow-list knows it or a fixed pattern has it.

Defined results: null and empty texts have no spans; offsets are code points,
ends exclusive; repeated rows are scanned alike; texts are scanned whole. Rows without an
id are scanned like others; spans of one start go by kind; an empty table gives no row;
only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .spans import SPANS

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]

# Fixed patterns and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH, CANDIDATE_LENGTH = 6, 20, 24, 20

WINDOW = 20
#: Least entropy in bits of the best window, by character class.
HEX_BITS, KEY_BITS = 3.0, 3.6
#: Fixed allow-list: identifiers, dates, numbers, paths and words are no keys.
ALLOWED = [re.compile(p) for p in (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[0-9_=+/-]+", r"[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*", r"(.)\1*", r".*EXAMPLE.*", r"(sha(1|256|384|512)|md5)-.*", r"([A-Za-z]+|[0-9]{1,4})([-_/=+]+([A-Za-z]+|[0-9]{1,4}))*[-_/=+]*")]

_HEXISH = np.isin(np.arange(256), list(b"0123456789abcdef"))
_KEYISH = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


def best_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits, of a window of the text, by incremental counts: sum n log n moves with two counts a step."""
    size = min(window, len(text))
    if not size:
        return 0.0
    term = [0.0] + [n * log2(n) for n in range(1, size + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for c in text[:size]:
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
    least = total
    for i in range(size, len(text)):
        out, new = text[i - size], text[i]
        if out != new:
            n = counts[out]
            total += term[n - 1] - term[n]
            counts[out] = n - 1
            n = counts.get(new, 0)
            total += term[n + 1] - term[n]
            counts[new] = n + 1
            least = min(least, total)
    return log2(size) - least / size


def is_key(candidate: str) -> bool:
    if any(p.fullmatch(candidate) for p in ALLOWED):
        return False
    if not re.search("[0-9]", candidate):
        return False
    limit = HEX_BITS if re.fullmatch("[0-9a-fA-F]+", candidate) else KEY_BITS
    return best_entropy(candidate) >= limit


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: (kind, start, end), unordered."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    # Of the base spans that begin before a candidate ends, the one that reaches farthest tells whether any meets it.
    base = sorted((s, e) for _, s, e in spans)
    starts, reach = [s for s, _ in base], [0, *accumulate((e for _, e in base), max)]
    for m in CANDIDATE.finditer(text):
        if reach[bisect_left(starts, m.end())] <= m.start() and is_key(m[0]):
            spans.append(("entropy", *m.span()))
    return spans


def _runs(mask: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``length`` true bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    start, end = edges[::2], edges[1::2]
    long = end - start >= length
    return start[long], end[long]


def suspects(chunk: K.Chunk) -> np.ndarray:
    """Whether each text can hold a span at all, from its bytes: a run long enough, or a sign of an assignment."""
    found = np.zeros(len(chunk), bool)
    start, stop = _runs(_HEXISH[chunk.data], HEX_LENGTH)
    keys, ends = _runs(_KEYISH[chunk.data], CANDIDATE_LENGTH)
    digits = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(_DIGIT[chunk.data], out=digits[1:])
    some = digits[ends] > digits[keys]
    keys, ends = keys[some], ends[some]
    signs = np.flatnonzero((chunk.data == ord(":")) | (chunk.data == ord("=")))
    raw, akia, at = chunk.data.tobytes(), [], -1
    while (at := raw.find(b"AKIA", at + 1)) >= 0:
        akia.append(at)
    for p in (signs, np.array(akia, np.int64)):
        found[np.searchsorted(chunk.bounds, p, "right") - 1] = True
    # A run may reach over the end of a text; all texts from its start to its end are looked at.
    step = np.zeros(len(chunk) + 1, np.int64)
    for a, b in ((start, stop), (keys, ends)):
        np.add.at(step, np.searchsorted(chunk.bounds, a, "right") - 1, 1)
        np.add.at(step, np.searchsorted(chunk.bounds, b - 1, "right"), -1)
    found |= np.cumsum(step[:-1]) > 0
    return found


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column("text")
            out: list[list] = []
            for chunk in K.chunks(texts):
                for i, seen in enumerate(suspects(chunk).tolist()):
                    text = texts[chunk.first + i].as_py() if seen else None
                    out.append([{"kind": k, "start": s, "end": e} for k, s, e in find(text)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans {SPANS}")
