"""Chat formatting: a reversible template and turn-aligned windows within a token budget."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks around a turn. Every mark starts with one of the OPENERS.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
OPENERS = "<["
LEARNT_ROLE, KEPT_ROLE = "assistant", "system"
BUDGET, HISTORY = 512, 128

_ESCAPED = re.compile(r"[<\[\\]\\")


def escape(text: str) -> str:
    """`text` with a backslash after each opener and backslash, so that it holds no mark of this or any template that starts with one."""
    text = text.replace("\\", "\\\\")
    for opener in OPENERS:
        text = text.replace(opener, opener + "\\")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text lies in that."""
    head = START + escape(role).replace("\n", "<n>") + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back from what `render` wrote."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part[: -len(END)].partition(MIDDLE)
        turns.append((unescape(role.replace("<n>", "\n")), unescape(text)))
    return turns


def count_words(text: str) -> int:
    return len(text.split())


class Windows:
    """Windows of one conversation, given its turns in order.

    Turns' running token sums say which whole turns fit: a window is the system turn, as many of the latest turns
    before it as fit in the history limit, and new turns up to the budget. History that would keep a new turn from
    fitting is left out, oldest first. A turn that does not fit beside the system turn alone makes a window of its own
    that is over the budget; nothing is dropped. Only new assistant turns are learnt, repeated ones are masked. Held
    at any time: the system turn, a history and a window.
    """

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]):
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: list = []
        self.past: deque = deque()
        self.new: list = []
        self.sum, self.past_start, self.new_start, self.kept, self.number, self.first = 0, 0, 0, 0, 0, True

    def add(self, role: str, text: str) -> Iterator[dict]:
        shown, lo, hi = render(role, text)
        size = self.tokens(shown)
        turn = (shown, lo, hi, role == LEARNT_ROLE, size)
        if self.new and self._total() + size > self.budget:
            yield self.close()
        if not self.new:
            while self.past and self._total() + size > self.budget:
                self._forget()
        self.new.append(turn)
        self.sum += size
        if self.first and role == KEPT_ROLE:
            self.system, self.kept = [turn], size
        self.first = False

    def _total(self) -> int:
        shown = self.sum - self.past_start
        return shown + (self.kept if self.number else 0)

    def _forget(self) -> None:
        self.past_start += self.past.popleft()[4]

    def close(self) -> dict:
        before = [*(self.system if self.number else []), *self.past]
        at, learnt = 0, []
        for i, (shown, lo, hi, learn, _) in enumerate([*before, *self.new]):
            if learn and i >= len(before):
                learnt.append({"lo": at + lo, "hi": at + hi})
            at += len(shown)
        tokens = self._total()
        row = {"window": self.number, "text": "".join(t[0] for t in [*before, *self.new]), "n_repeated": len(before), "n_new": len(self.new), "n_tokens": tokens, "over_budget": tokens > self.budget, "loss": learnt}
        fresh = self.new[1:] if self.number == 0 and self.system else self.new
        if self.number == 0 and self.system:
            self.past_start += self.kept
        self.past.extend(fresh)
        self.new, self.number = [], self.number + 1
        while self.past and self.sum - self.past_start > self.history:
            self._forget()
        return row


SCHEMA = "conv_id long, window int, text string, n_repeated int, n_new int, n_tokens long, over_budget boolean, loss array<struct<lo: int, hi: int>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])
_FLUSH_CHARS = 1 << 22


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_words) -> DataFrame:
    """Windows (SCHEMA) of each conversation in `turns` (conv_id, turn, role, text), in order within a conversation.

    Turns go by number, equal ones by role and text, null numbers first. Null text and null role are empty; turns
    without a conv_id are one conversation. `loss` has the learnt spans of `text` in code points. A conversation
    streams through one task in sorted order, and the task holds a window of it at a time, however long it is.
    Repeated rows are turns each. An empty table gives an empty table.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        now, windows, out, held = object(), None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if windows is None or conv != now:
                    if windows is not None:
                        out.append({"conv_id": now} | windows.close())
                    now, windows = conv, Windows(budget, history, tokens)
                for row in windows.add(role, text):
                    out.append({"conv_id": conv} | row)
                    held += len(row["text"])
                if held > _FLUSH_CHARS or len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out, held = [], 0
        if windows is not None:
            out.append({"conv_id": now} | windows.close())
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return ordered.mapInArrow(run, SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """A row for each conversation, from its windows as `format_conversations` orders them: turns and learnt text, parsed from the formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches):
        now, state, out = object(), None, []
        for batch in batches:
            for conv, text, skip, loss in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(finish(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text)[skip:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learnt = unescape(text[span["lo"] : span["hi"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
                state[5] += 1
                if len(out) > 5000:
                    yield as_batch(out)
                    out = []
        if state is not None:
            yield as_batch([*out, finish(now, state)])

    def finish(conv, s):
        return (conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5])

    def as_batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return windows.select("conv_id", "text", "n_repeated", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op2_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(control)))
