"""Chat formatting from event logs.

The log of a conversation is brought together by a hash exchange on its id, sorted by sequence and
folded as it streams by: messages, streamed deltas, edits and regenerations become final messages, which
are rendered with a reversible escape and character spans of the loss mask.

Template: ``### <role>: <text> </turn>`` and a line feed for each message. Inside roles and texts each
of the characters ``\\ # < :`` (the colon in roles only) gets a backslash before it, so no text can hold
a live marker, and taking one backslash away from each pair restores it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, to_batch

_TEXT, _ROLE, _BACK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*) </turn>\n", re.S)
KINDS = ("message", "delta", "edit", "regenerate")


class Conversation:
    """Messages that the events of one conversation leave, by turn."""

    def __init__(self):
        #: Messages (role, parts) of each turn; turns in order, but for the null one.
        self.of: dict[int | None, list[tuple[str, list[str]]]] = {}
        self.turns: list[int] = []

    def apply(self, kind: str, turn: int | None, role: str, text: str) -> None:
        """Applies one event.

        message adds a message. delta appends to the last message of its turn, edit replaces its text,
        regenerate replaces it and drops the messages of later turns; each adds a message where its turn has
        none. Unknown kinds count as message.
        """
        here = self.of.get(turn)
        if here is None:
            here = self.of[turn] = []
            if turn is not None:
                insort(self.turns, turn)
        if not here or kind not in KINDS[1:]:
            here.append((role, [text]))
        elif kind == "delta":
            here[-1][1].append(text)
        else:
            here[-1][1][:] = [text]
            if kind == "regenerate" and turn is not None:
                later = bisect_right(self.turns, turn)
                for t in self.turns[later:]:
                    del self.of[t]
                del self.turns[later:]

    def messages(self) -> list[tuple[str, str]]:
        """Roles and texts: those without a turn first, then by turn."""
        return [(role, "".join(parts)) for t in (None, *self.turns) for role, parts in self.of.get(t, ())]


def render(messages: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int], list[int]]:
    """Formatted conversation, and starts and ends of the spans to learn from."""
    out, at, starts, ends = [], 0, [], []
    for role, text in messages:
        head = f"### {_ROLE.sub(r'\\\g<0>', role)}: "
        body = _TEXT.sub(r"\\\g<0>", text)
        if role == learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out.append(f"{head}{body} </turn>\n")
        at += len(out[-1])
    return "".join(out), starts, ends


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted conversation."""
    got, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        got.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return got


def format_conversations(events: DataFrame, order_by: list[str], learn: str = "assistant") -> DataFrame:
    """Final messages of each conversation's log, rendered.

    events: conv_id long, kind string, turn long, role string, text string and the columns of order_by,
    which must order a conversation's events; other columns are ignored. Returns conv_id, formatted,
    loss_starts and loss_ends (character spans of the text of role ``learn``).

    Null text or role: empty. Null conv_id: one conversation of its own. Null turn: a turn of its own,
    first in order. Events that tie in order_by are applied by turn, kind, role and text. Repeated rows are events each. Empty table: empty result. A task holds one
    conversation's messages at a time, which is what its rendered row holds as well.
    """
    spark = events.sparkSession
    prepare(spark)
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, log, out = object(), None, []

        def done():
            if log:
                text, a, b = render(log.messages(), learn)
                out.append((here, text, a, b))

        for batch in batches:
            for conv, kind, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if conv != here:
                    done()
                    here, log = conv, Conversation()
                log.apply(kind, turn, role or "", text or "")
            if len(out) >= 256:
                yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)
                out = []
        done()
        if out:
            yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)

    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    log = events.select("conv_id", "kind", "turn", "role", "text", *keys)
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", *[f"_o{i}" for i in range(len(keys))], "turn", "kind", "role", "text")
    return log.select("conv_id", "kind", "turn", "role", "text").mapInArrow(run, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, all parsed from the output: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Columns as format_conversations returns them."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = []
            for conv, text, starts, ends in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                rows.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            if rows:
                yield to_batch(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as an event log of streamed messages.

    A row of an assistant: a draft, its regeneration, and two deltas with the halves of the text; any other row: a draft,
    an edit to the first half, and a delta with the rest.
    """
    half = (F.length("text") / 2).cast("int")
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("uid"))
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda part, kind, piece: F.struct(F.lit(kind).alias("kind"), F.lit(part).alias("part"), piece.alias("piece"))
    draft = event(0, "message", F.lit("draft"))
    streamed = F.array(draft, event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest))
    parts = F.when(F.col("role") == "assistant", streamed).otherwise(F.array(draft, event(1, "edit", first), event(2, "delta", rest)))
    return rows.select("conv_id", "turn", "role", "tie", "uid", F.explode(parts).alias("e")).select("conv_id", "e.kind", "turn", "role", F.col("e.piece").alias("text"), "tie", "uid", "e.part")


EVENT_ORDER = ["turn", "tie", "uid", "part"]
