"""Chat formatting in budgeted windows with a loss mask, and its exact reading back."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template. A window is BEGIN, then its turns, then END; a turn is OPEN role CLOSE text TURN.
#: The last ones are marks of common chat templates, escaped as well, so that no tokenizer takes a text for one.
BEGIN, END, OPEN, CLOSE, TURN = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"
CONTROL = (BEGIN, END, OPEN, CLOSE, TURN, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"

_UNSAFE = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_WINDOW = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(CLOSE)}(.*?){re.escape(TURN)}", re.DOTALL)

BUDGET = 512  # tokens of a window
HISTORY = 128  # of these, tokens of earlier turns that a window may repeat
WINDOW_SCHEMA = (
    "conv_id {key}, window int, first_turn bigint, n_system int, n_repeated int, n_turns int, n_tokens bigint, "
    "over_budget boolean, text string, loss array<struct<start:int,end:int>>"
)


def escape(text: str) -> str:
    """Put the escape sign after the first character of every control string, and double the sign itself.

    No control string is left in the result, and ``unescape`` gives the text back.
    """
    return _UNSAFE.sub(lambda m: m[0][0] + ESCAPE + m[0][1:] if m[0] != ESCAPE else ESCAPE * 2, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def count_words(text: str) -> int:
    """Default token measure of a turn: its words and two marks."""
    return len(text.split()) + 2


class _Conversation:
    """Windows of one conversation, made turn by turn; holds at most one window and its history."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str]] = []  # repeated ones first, then the window's own
        self.sums = [0]  # prefix sums of their tokens
        self.repeated = self.window = self.first = self.seen = 0

    def add(self, role: str, text: str) -> dict | None:
        """Take a turn; returns the window that it closes, if any."""
        tokens, closed = count_words(text), None
        if self.seen == 0 and role == "system":
            self.system = (role, text, tokens)
            self.seen = 1
            return None
        head = self.system[2] if self.system else 0
        if len(self.turns) > self.repeated and head + self.sums[-1] + tokens > self.budget:
            closed = self.close()
            # as many of the last turns as the history's share holds and the new turn leaves room for
            room = min(self.history, self.budget - head - tokens)
            cut = bisect_right([self.sums[-1] - s for s in reversed(self.sums)], max(room, 0)) - 1
            kept = self.turns[len(self.turns) - cut :] if cut else []
            self.turns, self.repeated = list(kept), len(kept)
            base = self.sums[len(self.sums) - 1 - cut]
            self.sums = [s - base for s in self.sums[len(self.sums) - 1 - cut :]]
            self.first = self.seen
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + tokens)
        self.seen += 1
        return closed

    def close(self) -> dict:
        parts, spans, at = [BEGIN], [], len(BEGIN)
        system = [(self.system[0], self.system[1])] if self.system else []
        for place, (role, text) in enumerate(system + self.turns):
            head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
            if role == "assistant" and place >= len(system) + self.repeated:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts.append(f"{head}{body}{TURN}")
            at += len(parts[-1])
        tokens = self.sums[-1] + (self.system[2] if self.system else 0)
        made = {
            "conv_id": self.conv, "window": self.window, "first_turn": self.first, "n_system": len(system),
            "n_repeated": self.repeated, "n_turns": len(system) + len(self.turns), "n_tokens": tokens,
            "over_budget": tokens > self.budget, "text": "".join(parts) + END, "loss": spans,
        }
        self.window += 1
        return made


def format_windows(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """Windows of conversations: ``conv_id, window, first_turn, n_system, n_repeated, n_turns, n_tokens, over_budget,
    text, loss``.

    Prefix sums of the turns' tokens place the windows: a window takes turns while the system turn, repeated history and
    they stay within ``budget``; turns are never cut. The next window repeats the system turn (the first turn, if its
    role is system) and as many of the last turns as ``history`` holds. ``loss`` are the character spans of
    assistant texts that appear for the first time; repeated ones are outside it, so each is a target once. A turn
    longer than the budget has a window of its own, marked ``over_budget``.

    Texts and roles are escaped (``escape``), so control strings inside them are plain text and come back whole.
    A null text or role is empty. Rows are ordered by turn, then role and text; a null turn comes first, and rows that
    repeat a turn are turns of their own. Null conversation ids are one conversation. Empty tables give none.

    Conversations are shuffled once by id and streamed in order through the task, which holds one window at a time,
    however long a conversation is. Windows of one conversation leave in order, side by side.
    """
    kind = turns.schema[key].dataType.simpleString()
    rows = turns.select(
        F.col(key).cast("string").alias("conv_id"),  # as text: pandas makes doubles of whole numbers beside a null
        F.col(order).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: _Conversation | None = None
        for batch in batches:
            made = []
            missing = batch["conv_id"].isna()
            for conv, lost, who, what in zip(batch["conv_id"], missing, batch["role"], batch["text"]):
                conv = None if lost else conv
                if state is None or state.conv != conv:
                    if state is not None:
                        made.append(state.close())
                    state = _Conversation(conv, budget, history)
                closed = state.add(who, what)
                if closed:
                    made.append(closed)
            yield _frame(made)
        if state is not None:
            yield _frame([state.close()])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    made = ordered.select("conv_id", "role", "text").mapInPandas(run, WINDOW_SCHEMA.format(key="string"))
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def _frame(made: list[dict]) -> pd.DataFrame:
    names = [part.split()[0] for part in WINDOW_SCHEMA.format(key="x").split(", ")]
    frame = pd.DataFrame(made, columns=names)
    frame["conv_id"] = pd.Series([m["conv_id"] for m in made], dtype=object)  # whole numbers stay so beside a null
    return frame


def read_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window, repeated ones too."""
    return [(unescape(r), unescape(t)) for r, t in _WINDOW.findall(text)]


DIGEST_SCHEMA = (
    "conv_id {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_windows bigint"
)


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows alone: turns, their digest, the text under the loss mask and its
    digest, and the formatted characters.

    Windows of a conversation must lie in order in one partition, as ``format_windows`` leaves them.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None

        def finish() -> tuple:
            return (conv, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"])

        names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars n_windows".split()
        for batch in batches:
            made = []
            missing = batch["conv_id"].isna()
            for key, lost, number, system, repeated, text, loss in zip(
                batch["conv_id"], missing, batch["window"], batch["n_system"], batch["n_repeated"], batch["text"], batch["loss"]
            ):
                if number == 0:
                    if state is not None:
                        made.append(finish())
                    conv = None if lost else key
                    state = {"turns": 0, "chars": 0, "size": 0, "windows": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                turns = read_window(text)
                fresh = turns[:system] * (number == 0) + turns[system + repeated :]
                for role, body in fresh:
                    state["all"].update(f"{role}\n{body}\n".encode())
                state["turns"] += len(fresh)
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(body)
                    state["loss"].update(body.encode())
                state["size"] += len(text)
                state["windows"] += 1
            yield _keyed(made, names)
        if state is not None:
            yield _keyed([finish()], names)

    named = windows.withColumn("conv_id", F.col("conv_id").cast("string"))
    return named.mapInPandas(run, DIGEST_SCHEMA.format(key="string")).withColumn("conv_id", F.col("conv_id").cast(kind))


def _keyed(made: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(made, columns=names)
    frame["conv_id"] = pd.Series([m[0] for m in made], dtype=object)
    return frame
