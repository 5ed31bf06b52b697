"""Chat formatting in budgeted windows.

A conversation's turns, in order, get their token counts; prefix sums over them
choose spans of whole turns that fit a budget. Every window holds the system
turn, then at most ``max_history`` turns of history (as far as
``history_tokens`` goes), then the turns of its span. Repeated turns, the system
turn's repetitions included, are outside the loss mask, so each assistant text
is a target exactly once. A single turn over the budget gets a window to itself
and stays whole (``over_budget``).

Turns are marked with control strings. Where a text holds something that looks
like a control string of this or another common template, a backslash goes in
after its first character; one that already carries backslashes gets one more,
so reading back is exact.

The rows of a conversation are sorted within partitions and streamed, and only
the turns of the current window are held, so a conversation of any length
passes in bounded memory. NULL texts and roles count as empty; equal turn numbers
are ordered by role and text; NULL turn numbers come first; the rows with a NULL
conversation id form one conversation. Repeated rows are repeated turns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalmill.llm.common import plain, text_of

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
# Control strings of this and of other common templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_FIRST = "".join({re.escape(c[0]) for c in CONTROL})
_HIDE = re.compile(rf"([{_FIRST}])(\\*)({_REST})")
_SHOW = re.compile(rf"([{_FIRST}])\\(\\*)({_REST})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

WINDOW_SCHEMA = ("conv_id bigint, window int, text string, n_turns int, n_repeated int, n_tokens bigint, "
                 "over_budget boolean, loss array<struct<start: int, end: int>>")
_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()),
                     ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
                     ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
DIGEST_SCHEMA = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                 "formatted_chars bigint, n_windows bigint")
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                     ("n_windows", pa.int64())])


def escape(text: str) -> str:
    return _HIDE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role stands on the line of its mark: no line feed may be in it."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@lru_cache(maxsize=2)
def _encoding(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def windows(turns: Iterator[tuple[str, str]], count, budget: int, history_tokens: int, max_history: int) -> Iterator[dict]:
    """The windows of one conversation, given as ``(role, text)`` in order."""
    system: tuple[str, str, int] | None = None  # role, marked turn, tokens
    span: list[tuple[str, str, int]] = []
    history: deque[tuple[str, str, int]] = deque(maxlen=max_history)
    shown: list[tuple[str, str, int]] = []  # history of the window under way
    held = number = 0  # prefix sum of the window's tokens

    def emit() -> dict:
        repeated = ([system] if system and number else []) + shown
        text, loss, at = [], [], 0
        for k, (role, marked, _) in enumerate(repeated + span):
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + marked.index(MIDDLE) + 1, "end": at + len(marked) - len(END)})
            text.append(marked)
            at += len(marked)
        return {"window": number, "text": "".join(text), "n_turns": len(repeated) + len(span), "n_repeated": len(repeated),
                "n_tokens": held, "over_budget": held > budget, "loss": loss}

    for k, (role, text) in enumerate(turns):
        marked = START + escape_role(role) + MIDDLE + escape(text) + END
        turn = (role, marked, count(marked))
        if span and held + turn[2] > budget:
            yield emit()
            number += 1
            for t in span:
                if t is not system:
                    history.append(t)
            room = min(history_tokens, budget - turn[2] - (system[2] if system else 0))
            shown = []
            for t in reversed(history):
                if t[2] > room:
                    break
                shown.insert(0, t)
                room -= t[2]
            span, held = [], (system[2] if system else 0) + sum(t[2] for t in shown)
        if k == 0 and role == "system":
            system = turn
        span.append(turn)
        held += turn[2]
    if span:
        yield emit()


def format_conversations(rows: DataFrame, ranks_file: str, pattern: str, budget: int = 1024, history_tokens: int = 256,
                         max_history: int = 4, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per window (``WINDOW_SCHEMA``); a conversation's windows stand together and in order.

    ``loss`` holds the spans of code points under the loss mask.
    """
    turns = rows.select(plain(id_col).cast("bigint").alias("conv_id"), plain(turn_col).cast("bigint").alias("turn"),
                        text_of(plain(role_col)).alias("role"), text_of(plain(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_file, pattern).encode_ordinary
        stream = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))))
        out: list[dict] = []
        size = 0
        for conv, own in groupby(stream, key=lambda r: r[0]):
            for w in windows(((r[1], r[2]) for r in own), lambda t: len(encode(t)), budget, history_tokens, max_history):
                out.append({"conv_id": conv} | w)
                size += len(w["text"])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, _WINDOW)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _WINDOW)

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, WINDOW_SCHEMA))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its windows say (``DIGEST_SCHEMA``), parsed from their text alone.

    Takes windows as ``format_conversations`` gives them, or read again from a
    table after ``repartition("conv_id").sortWithinPartitions("conv_id", "window")``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("conv_id", "text", "n_repeated", "loss"))))
        out = []
        for conv, own in groupby(stream, key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_windows = 0
            for _, text, repeated, spans in own:
                n_windows += 1
                chars += len(text)
                for k, m in enumerate(_TURN.finditer(text)):
                    if k >= repeated:
                        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                        n_turns += 1
                for s in spans:
                    target = unescape(text[s["start"]:s["end"]])
                    loss.update(target.encode())
                    loss_chars += len(target)
            out.append({"conv_id": conv, "n_turns": n_turns, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                        "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_windows": n_windows})
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, _DIGEST)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _DIGEST)

    return formatted.select("conv_id", "text", "n_repeated", "loss").mapInArrow(run, DIGEST_SCHEMA)
