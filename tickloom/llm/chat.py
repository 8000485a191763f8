"""Chat formatting with any template, by incremental black-box rendering.

A template is a function from messages to text whose insides are not looked at. The first
turn, the first two turns, ... are rendered in turn; where each output continues the one
before, the new part is the span of the new turn. An output that does not continue the one
before shows a template that rewrites history: its spans would not hold in the final text.
Inside a turn's span the text is found by rendering the turn once more with a probe
character in its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import column

Message = tuple[str, str]  # role, text
START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = 256  # turns rendered together; a longer conversation becomes several formatted rows

_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left in the text: ``<|`` gets a backslash, ``<\\|`` another one."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and in one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def marked(messages: list[Message]) -> str:
    """The default template: start mark, role, line break, text, end mark."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in messages)


@dataclass(frozen=True)
class Span:
    """A turn in the formatted text: ``start:stop`` with its marks, ``text_start:text_stop`` its text."""

    start: int
    stop: int
    text_start: int
    text_stop: int


@dataclass(frozen=True)
class Rendered:
    text: str
    spans: list[Span] | None  # None if the template rewrites history or hides a text
    rewrites_at: int | None  # first turn whose rendering changes what stood before


def _probe(*texts: str) -> str:
    used = set().union(*texts)
    return next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)


def render_turns(messages: list[Message], template: Callable[[list[Message]], str], plain: Callable[[str], str]) -> Rendered:
    """Render all messages and locate every turn; ``plain`` undoes the template's escaping."""
    before, spans, rewrites = template([]), [], None
    for k, (role, text) in enumerate(messages):
        now = template(messages[: k + 1])
        if not now.startswith(before):
            rewrites = k if rewrites is None else rewrites
        elif spans is not None and rewrites is None:
            probe = _probe(before, role)
            sample = template([*messages[:k], (role, probe)])
            head, _, foot = sample.partition(probe)
            begin, end = len(head), len(now) - len(foot)
            whole = sample.count(probe) == 1 and now.startswith(head) and now.endswith(foot) and begin <= end
            if whole and plain(now[begin:end]) == text:
                spans.append(Span(len(before), len(now), begin, end))
            else:
                spans = None  # the template drops or changes this text
        before = now
    return Rendered(before, None if rewrites is not None else spans, rewrites)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        roles, texts = (column(batch, c).fill_null("").to_pylist() for c in ("role", "text"))
        yield from zip(column(batch, "conv_id").to_pylist(), roles, texts, strict=True)


def _segments(turns: Iterator[tuple[int | None, str, str]], limit: int) -> Iterator[tuple[int | None, int, list[Message]]]:
    """(conversation, number of the segment, its messages) of rows sorted by conversation."""
    held: list[Message] = []
    now, number, any_yet = None, 0, False
    for conv, role, text in turns:
        if any_yet and (conv != now or len(held) >= limit):
            yield now, number, held
            number, held = (number + 1 if conv == now else 0), []
        now, any_yet = conv, True
        held.append((role, text))
    if any_yet:
        yield now, number, held


FORMATTED = (
    "conv_id long, segment int, formatted string, rewrites_at int, "
    "turns array<struct<role:string,start:int,stop:int,text_start:int,text_stop:int,loss:boolean>>"
)
TURN = pa.struct([("role", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("text_start", pa.int32()), ("text_stop", pa.int32()), ("loss", pa.bool_())])
ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("rewrites_at", pa.int32()), ("turns", pa.list_(TURN))])


def format_conversations(
    rows: DataFrame,
    template: Callable[[list[Message]], str] = marked,
    plain: Callable[[str], str] = unescape,
    trained: tuple[str, ...] = ("assistant",),
    segment: int = SEGMENT,
) -> DataFrame:
    """Formatted conversations with the place of every turn and the loss mask.

    ``rows`` needs conv_id, turn, role and text; other columns are ignored. Returns a row per
    conversation and segment of up to ``segment`` turns: ``formatted``, ``turns`` (positions in
    code points; ``loss`` marks the turns of the ``trained`` roles, whose text_start:text_stop
    is the loss mask) and ``rewrites_at``, the first turn at which the template rewrote
    history. ``turns`` is null if it did, or if it does not show a text as it is.

    Turns are ordered by turn (null first), role and text, so ties and repeated rows have one
    result. Null roles and texts count as empty; rows with a null conv_id are one conversation.
    Rows stream through a task in order: it holds one segment, however long a conversation is.
    """
    wanted = frozenset(trained)
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, number, messages in _segments(_turns(batches), segment):
            done = render_turns(messages, template, plain)
            turns = None if done.spans is None else [{"role": role, "start": s.start, "stop": s.stop, "text_start": s.text_start, "text_stop": s.text_stop, "loss": role in wanted} for (role, _), s in zip(messages, done.spans, strict=True)]
            out.append({"conv_id": conv, "segment": number, "formatted": done.text, "rewrites_at": done.rewrites_at, "turns": turns})
            size += len(done.text)
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the default template's output, one row per conversation.

    Takes the rows as ``format_conversations`` returns them, in its order: (conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars). Roles and texts are parsed from
    the formatted text; the counts and hashes are kept while rows stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        state: dict | None = None

        def close() -> None:
            if state is not None:
                out.append(state | {"turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] == 0:
                    close()
                    state = {"conv_id": row["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                text = row["formatted"]
                state["formatted_chars"] += len(text)
                for turn in row["turns"] or []:
                    head = text[turn["start"] : turn["text_start"]]
                    role = unescape_role(head.removeprefix(START).removesuffix("\n"))
                    said = unescape(text[turn["text_start"] : turn["text_stop"]])
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{role}\n{said}\n".encode())
                    if turn["loss"]:
                        state["loss_chars"] += len(said)
                        state["loss_sha256"].update(said.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
