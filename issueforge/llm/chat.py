r"""Chat formatting in token-budgeted windows.

Turn ``role, text`` is written ``### role: text</turn>`` and a newline.  Inside role and text a
backslash stands before every backslash, before a ``#`` that follows a ``#`` and before a ``/`` that
follows a ``<`` (in roles before ``:`` too), so no marker can occur there; dropping one backslash of
each pair gives the text back.

A conversation becomes windows of whole turns.  Prefix sums of turn tokens choose each window's span:
the system turn first, then earlier turns of at most ``history`` tokens, then as many new turns as
the budget holds, one at least.  Only new assistant texts are under the loss mask, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.llm.textvec import slices
from issueforge.llm.tokens import encoder, word_bpe_path

BUDGET = 1024
HISTORY = 256
TURN_COST = 4  # tokens of the markers of a turn
ASSISTANT, SYSTEM = "assistant", "system"

_ESCAPED = re.compile(r"\\|(?<=#)#|(?<=<)/")
_ESCAPED_ROLE = re.compile(r"\\|(?<=#)#|(?<=<)/|:")
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window; raises if it is not one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


WINDOW = pa.schema(
    [
        ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss_start", pa.list_(pa.int64())),
        ("loss_end", pa.list_(pa.int64())), ("carried", pa.int64()), ("n_new", pa.int64()), ("tokens", pa.int64()),
    ]
)
WINDOW_DDL = (
    "conv_id bigint, window bigint, text string, loss_start array<bigint>, loss_end array<bigint>, carried bigint, "
    "n_new bigint, tokens bigint"
)


class _Conversation:
    """Turns of one conversation as they arrive; holds no more than a window and its history."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]  # tokens before each held turn
        self.new, self.number, self.seen = 0, 0, 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        self.seen += 1
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        while self.sums[-1] - self.sums[self._from()] + self._system_cost() > self.budget and len(self.turns) - self.new > 1:
            yield self._window()
        if self.seen == 1 and role == SYSTEM:
            self.system = self.turns[0]

    def _system_cost(self) -> int:
        return self.system[2] if self.system and self.number else 0

    def _from(self) -> int:
        """First turn of the history before the new turns; none if it would push the first new turn out."""
        first = bisect_left(self.sums, self.sums[self.new] - self.history)
        room = self.budget - self._system_cost() - (self.sums[self.new + 1] - self.sums[self.new])
        return max(first, bisect_left(self.sums, self.sums[self.new] - max(room, 0)))

    def _window(self) -> tuple:
        first = self._from()
        last = bisect_right(self.sums, self.sums[first] + self.budget - self._system_cost()) - 1
        last = min(max(last, self.new + 1), len(self.turns))
        head = [self.system] if self.system and self.number else []
        shown = head + self.turns[first:last]
        carried = len(head) + self.new - first
        parts, at, starts, ends = [], 0, [], []
        for n, (role, text, _) in enumerate(shown):
            opening = f"### {_ESCAPED_ROLE.sub(lambda m: chr(92) + m[0], role)}: "
            body = escape(text)
            if n >= carried and role == ASSISTANT:
                starts.append(at + len(opening))
                ends.append(at + len(opening) + len(body))
            part = f"{opening}{body}</turn>\n"
            parts.append(part)
            at += len(part)
        tokens = self.sums[last] - self.sums[first] + self._system_cost()
        row = (self.conv_id, self.number, "".join(parts), starts, ends, carried, last - self.new, tokens)
        self.number += 1
        self.new = last
        # what can still be history
        keep = bisect_left(self.sums, self.sums[self.new] - self.history)
        if self.system and keep == 0 and self.number:
            keep = 1  # the system turn heads every window and is not repeated as history
        self.turns, self.sums, self.new = self.turns[keep:], self.sums[keep:], self.new - keep
        return row

    def close(self) -> Iterator[tuple]:
        while self.new < len(self.turns):
            yield self._window()


def _formatted(batches: Iterator[pa.RecordBatch], path: str, budget: int, history: int) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    rows: list[tuple] = []

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), WINDOW)], schema=WINDOW)
        rows.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            sizes = encoder(path).encode(part.column("text"))[1]
            for n, (conv, role, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")))):
                if now is None or conv != now.conv_id:
                    rows += now.close() if now else ()
                    now = _Conversation(conv, budget, history)
                rows += now.add(role, text, int(sizes[n + 1] - sizes[n]) + TURN_COST)
            if rows:
                yield flushed()
    rows += now.close() if now else ()
    if rows:
        yield flushed()


def format_conversations(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None
) -> DataFrame:
    """One row per window: conv_id, window, text, loss spans (code points), carried, n_new, tokens.

    ``conversations`` has conv_id, turn, role, text.  Turns go by ``turn`` (null first), equal ones by
    role and text; repeated rows are turns of their own.  Null roles and texts are empty; a null
    conv_id is a conversation.  A turn over the budget gets a window of its own beside the system
    turn.  A conversation's windows stand together and in order.  ``carried`` leading turns repeat
    the system turn and history.  A task reads a conversation turn by turn and holds only its
    current window.  Further columns are ignored.
    """
    path = tokenizer or word_bpe_path()
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", empty("role"), empty("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(lambda b: _formatted(b, path, budget, history), WINDOW_DDL)


DIGEST_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in DIGEST_DDL.split(", "))])
    conv, state, rows = None, None, []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def closed():
        rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        columns = ("conv_id", "text", "loss_start", "loss_end", "carried", "window")
        for own, text, starts, ends, carried, window in zip(*(batch.column(c).to_pylist() for c in columns)):
            if state is None or own != conv or window == 0:
                if state is not None:
                    closed()
                conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(text)[carried:]
            state[0] += len(turns)
            for role, said in turns:
                state[1].update(f"{role}\n{said}\n".encode())
            for a, b in zip(starts, ends):
                said = unescape(text[a:b])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if rows:
            yield batch_of(rows)
            rows = []
    if state is not None:
        closed()
        yield batch_of(rows)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what the windows of ``format_conversations`` hold, read back from their text."""
    return windows.mapInArrow(_digested, DIGEST_DDL)
