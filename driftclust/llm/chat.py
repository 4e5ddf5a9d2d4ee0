"""Chat formatting in windows under a token budget, with loss masks, and its exact reading back."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import own_columns
from driftclust.llm.tokens import counter

#: Strings that mark turns here or in other chat templates. None begins with the end of another, so that finds don't overlap.
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIND = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_OPEN, _CLOSE = "<|turn|>", "<|end|>"
SYSTEM, TARGET = "system", "assistant"


def escape(text: str) -> str:
    """One more backslash after the first character of each control string, so that none is left; ``unescape`` takes it out."""
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Window:
    """Formatted turns, with the spans of the text that count for the loss."""

    def __init__(self):
        self.parts, self.at, self.spans, self.turns, self.repeated, self.tokens = [], 0, [], 0, 0, 0

    def add(self, role: str, text: str, tokens: int, again: bool) -> None:
        head, body = f"{_OPEN}{_role(role)}\n", escape(text)
        if role == TARGET and not again:  # a target that stands here as history again is masked
            self.spans.append((self.at + len(head), self.at + len(head) + len(body)))
        self.parts += [head, body, _CLOSE, "\n"]
        self.at += len(head) + len(body) + len(_CLOSE) + 1
        self.turns, self.repeated, self.tokens = self.turns + 1, self.repeated + again, self.tokens + tokens


def windows(turns: Iterator[tuple[str, str, int]], budget: int, history: int, most: int) -> Iterator[Window]:
    """Windows over (role, text, tokens). ``sums[i]`` is the prefix sum of tokens; a window takes the longest span of new turns
    that the budget allows after the system turn and the history: as many of the latest turns as ``history`` tokens and
    ``most`` turns allow, but not so many that the next turn doesn't fit any more. A turn over the budget has a window of its own."""
    system: tuple[str, str, int] | None = None
    recent: deque[tuple[str, str, int]] = deque()
    now: Window | None = None
    for i, turn in enumerate(turns):
        tokens = turn[2]
        if now is not None and now.tokens + tokens > budget:
            yield now
            now = None
        if now is None:
            now = Window()
            if i:
                used = (system[2] if system else 0) + tokens
                if system:
                    now.add(*system, True)
                sums, start = [0], len(recent)
                for old in reversed(recent):
                    sums.append(sums[-1] + old[2])
                while start > 0 and sums[len(recent) - start + 1] <= min(history, budget - used):
                    start -= 1
                for old in list(recent)[start:]:
                    now.add(*old, True)
        now.add(*turn, False)
        if i == 0 and turn[0] == SYSTEM:
            system = turn
        else:
            recent.append(turn)
            if len(recent) > most:
                recent.popleft()
    if now is not None:
        yield now


def read_window(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn of a formatted window, unescaped."""
    at, masks = 0, iter(spans)
    mask = next(masks, None)
    while at < len(text):
        head = text.index("\n", at)
        end = text.index(_CLOSE + "\n", head)
        loss = ""
        while mask and mask[0] <= end:
            loss += unescape(text[mask[0] : mask[1]])
            mask = next(masks, None)
        yield _unrole(text[at + len(_OPEN) : head]), unescape(text[head + 1 : end]), loss
        at = end + len(_CLOSE) + 1


_WINDOW = "conv_id long, window long, text string, loss_starts array<int>, loss_ends array<int>, n_turns int, n_repeated int, n_tokens long"


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Groups of rows that follow each other with the same first value, none held as a whole."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def same():
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        yield key, (part := same())
        for _ in part:
            pass


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _format(vocabulary: str, budget: int, history: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)

        def counted() -> Iterator[tuple]:
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                tokens = count.counts([t.encode("utf-8") for t in texts])
                yield from zip(batch.column("conv_id").to_pylist(), (r or "" for r in batch.column("role").to_pylist()), texts, tokens, strict=True)

        out, size = [], 0

        def made():
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()), strict=True)], [x.split()[0] for x in _WINDOW.split(", ")])

        for conv_id, turns in _conversations(counted()):
            for k, w in enumerate(windows(turns, budget, history, most)):
                out.append((conv_id, k, "".join(w.parts), [a for a, _ in w.spans], [b for _, b in w.spans], w.turns, w.repeated, w.tokens))
                size += w.at
                if size > 1 << 22 or len(out) > 4096:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()

    return run


def format_conversations(conversations: DataFrame, vocabulary: str = "word_bpe_49k.json", budget: int = 2048, history: int = 512, most: int = 8) -> DataFrame:
    """Windows of formatted conversations: conv_id, window, text, loss_starts and loss_ends (spans of code points of the text that
    are learned), n_turns, n_repeated (turns at the window's start that earlier windows had), n_tokens.

    Turns are ordered by turn, then role, then text, nulls first. The system turn of a conversation (its first turn, if the role says
    so) opens each window; up to ``history`` tokens or ``most`` turns of history are repeated, masked; every assistant text is learned
    once. Null roles and texts are empty. Rows with a null conv_id are one conversation. Repeated rows are turns of their own. A
    conversation is streamed, not held: memory is bounded by the budget and the longest turn. Other columns are ignored.
    """
    rows = own_columns(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(vocabulary, budget, history, most), _WINDOW)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _rows(batches, "conv_id", "text", "loss_starts", "loss_ends", "n_repeated")
    out = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c) if t == "string" else pa.array(c, pa.int64()) for c, t in zip(zip(*out, strict=True), ("long", "long", "string", "long", "string", "long"), strict=True)], [x.split()[0] for x in _DIGEST.split(", ")])

    for conv_id, parts in _conversations(rows):
        turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for text, starts, ends, repeated in parts:
            chars += len(text)
            for i, (role, said, masked) in enumerate(read_window(text, list(zip(starts, ends, strict=True)))):
                loss.update(masked.encode("utf-8"))
                learned += len(masked)
                if i >= repeated:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
        out.append((conv_id, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
        if len(out) == 4096:
            yield made()
            out = []
    if out:
        yield made()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations read back from windows that come as ``format_conversations`` returns them, each conversation's in order."""
    return formatted.mapInArrow(_digest, _DIGEST)
