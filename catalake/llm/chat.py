"""Chat formatting in budgeted windows.

Turns become ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline; texts and
roles are escaped so that control strings in them can't end or start a turn, and
``unescape`` gives them back. Prefix sums of turn tokens choose windows of whole
turns within the budget. Each window repeats the conversation's leading system turn
and a limited history; repeated turns are outside the loss mask, so each assistant
text is a target once.

Rows stream through one sorted partition a conversation, in memory bounded by the
budget: a conversation of any length is one stream because its digest is.

Defined results: turns go by turn, role and text, nulls first; null text and role
are empty. A turn over the budget is a window of its own. Repeated rows are turns
of their own, and turns without a conv_id are one conversation; no conversation gives no
row. Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import counter

#: Tokens of a window, of which the history takes at most a quarter.
BUDGET = 2048
HISTORY = 2
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n([^<]*(?:<(?!\|)[^<]*)*)<\|im_end\|>\n")

WINDOWS = "window long, text string, loss array<struct<start:long,end:long>>, repeated int"


def escape(text: str) -> str:
    """Without ``<|`` and reversible: a backslash doubles, and one parts the two characters."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|") if "<" in text or "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def _close(conv, window: int, lead: list, new: list) -> tuple:
    parts, loss, at = [], [], 0
    for k, (role, text) in enumerate(lead + new):
        head = f"{START}{role}\n"
        if k >= len(lead) and role == "assistant" and text:
            loss.append({"start": at + len(head), "end": at + len(head) + len(text)})
        turn = f"{head}{text}{END}\n"
        parts.append(turn)
        at += len(turn)
    return conv, window, "".join(parts), loss, len(lead)


def windows_of(conv, turns: Iterator[tuple[str, str]], count, budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple]:
    """Windows of one conversation, as its turns come. count: tokens of a text."""
    mark = count(f"{START}x\n{END}\n")
    system: list = []
    lead: list = []
    new: list = []
    used = window = 0
    sums: list[int] = []  # prefix sums of the tokens of the window's turns
    for k, (role, text) in enumerate(turns):
        turn = (escape_role(role), escape(text))
        cost = mark + count(turn[1])
        if new and used + sums[-1] + cost > budget:
            yield _close(conv, window, lead, new)
            window += 1
            past, back = [], len(new)
            # The latest turns that fit a quarter of the budget together, by the same sums.
            while back and len(past) < history and sums[-1] - (sums[back - 2] if back > 1 else 0) <= budget // 4:
                back -= 1
                if new[back] in system:
                    break
                past.insert(0, new[back])
            fixed = sum(mark + count(t) for _, t in system)
            held = fixed + sum(mark + count(t) for _, t in past)
            if held + cost > budget:
                past, held = [], fixed
            lead, used, new, sums = system + past, held, [], []
        if k == 0 and role == "system":
            system = [turn]
        new.append(turn)
        sums.append((sums[-1] if sums else 0) + cost)
    if new:
        yield _close(conv, window, lead, new)


def format_chats(turns: DataFrame, model_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation: conv_id, window, text, loss (code points), repeated (leading turns that earlier windows have).

    Windows of a conversation come in order in one partition.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    kind = to_arrow_type(turns.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        count = counter(model_path).count

        def rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True)

        loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out: list[tuple] = []
        size = 0
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            for w in windows_of(conv, ((r[1] or "", r[2] or "") for r in group), count, budget, history):
                out.append(w)
                size += len(w[2])
                if size > 1 << 21:
                    yield _batch(out, kind, loss)
                    out, size = [], 0
        if out:
            yield _batch(out, kind, loss)

    sorted_turns = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_turns.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {id_type}, {WINDOWS}")


def _batch(rows: list[tuple], kind: pa.DataType, loss: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    ids = pa.array(cols[0], kind)
    return pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], loss), pa.array(cols[4], pa.int32())], names=["conv_id", "window", "text", "loss", "repeated"])


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of conversations, from format_chats' own output and order: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    id_type = windows.schema["conv_id"].dataType.simpleString()
    kind = to_arrow_type(windows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "repeated")], strict=True)

        out = []
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            said, target = hashlib.sha256(), hashlib.sha256()
            n = chars = formatted = 0
            for _, text, loss, repeated in group:
                formatted += len(text)
                for k, m in enumerate(_TURN.finditer(text)):
                    if k >= repeated:
                        said.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                for s in loss:
                    part = unescape(text[s["start"] : s["end"]])
                    chars += len(part)
                    target.update(part.encode("utf-8", "surrogatepass"))
            out.append((conv, n, said.hexdigest(), chars, target.hexdigest(), formatted))
            if len(out) >= 5000:
                yield _digests(out, kind)
                out = []
        if out:
            yield _digests(out, kind)

    return windows.select("conv_id", "text", "loss", "repeated").mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
