"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, per role, the control strings around a turn, the roles whose texts carry
loss, and the turn order as transitions between states. Formatting a conversation gives one
row per turn with its text segments, each flagged for loss: opening mark, text, closing
mark. Control strings inside texts are escaped: backslashes are doubled and a backslash
splits whatever would read as a control string, so the concatenated output can be parsed
back without loss (``parse``).

A turn that the machine has no transition for is marked (``sound`` false) and still
formatted; the machine goes on from the state that its role has. Roles without marks of
their own are written with the template's general marks, which hold the role's name.

Conversations are dealt by conv_id, sorted by (turn, role, text) and streamed through the
machine: a task holds one Arrow batch, never a conversation. (A conversation's digest is by
definition computed turn after turn; so is the state of the machine.)

Nulls and odd rows: a null text or role is empty; rows with a null conv_id are one
conversation; null turns come first; equal turns are ordered by role, then text, and all
kept; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of any other role (before the name, between name and text, after), order and loss."""

    marks: Mapping[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    order: Mapping[str, Mapping[str, str]]
    start: str = "start"
    closed: frozenset[str] = frozenset()
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        controls = (*(m for pair in self.marks.values() for m in pair), *self.other)
        if len(set(controls)) < len(controls) or any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("marks are distinct, of two characters at least and without backslash")
        if any(a != b and a in b for a in controls for b in controls):
            raise ValueError("no mark may contain another")
        object.__setattr__(self, "controls", controls)

    def pattern(self) -> re.Pattern[str]:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))

    def splitter(self) -> re.Pattern[str]:
        """First characters of control strings."""
        return re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls))

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state and whether the order allows the turn."""
        to = self.order.get(state, {}).get(role)
        return (role, False) if to is None else (to, True)


INSTRUCT = Template(
    marks={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("<|role|>", "<|text|>", "<|end|>"),
    loss=frozenset({"assistant"}),
    order={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    closed=frozenset({"assistant"}),
)


def escape(text: str, splitter: re.Pattern[str]) -> str:
    return splitter.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def segments(role: str, text: str, template: Template, splitter: re.Pattern[str]) -> list[tuple[str, bool]]:
    """A turn as (text, loss) segments."""
    marks = template.marks.get(role)
    if marks is None:
        before, between, after = template.other
        opening, closing = before + escape(role, splitter) + between, after
    else:
        opening, closing = marks
    return [(opening, False), (escape(text, splitter), role in template.loss), (closing, False)]


class Parser:
    """Reads formatted text back, piece by piece; a piece never cuts a control string."""

    def __init__(self, template: Template):
        self.pattern = template.pattern()
        self.opening = {marks[0]: (role, marks[1]) for role, marks in template.marks.items()}
        self.other = template.other
        self.role: str | None = None
        self.ending: str | None = None
        self.text: list[str] = []

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in the piece."""
        at = 0
        for mark in self.pattern.finditer(piece):
            self._add(piece[at : mark.start()])
            at = mark.end()
            done = self._mark(mark[0])
            if done:
                yield done
        self._add(piece[at:])

    def _add(self, text: str) -> None:
        if text and self.ending is None:
            raise ValueError("text outside a turn")
        self.text.append(text)

    def _mark(self, mark: str) -> tuple[str, str] | None:
        if self.ending is None:
            if mark == self.other[0]:
                self.role, self.ending = None, self.other[1]
            elif mark in self.opening:
                self.role, self.ending = self.opening[mark]
            else:
                raise ValueError("a turn can't begin with " + mark)
            self.text = []
            return None
        if mark != self.ending:
            raise ValueError(mark + " inside a turn")
        own = unescape("".join(self.text))
        self.text = []
        if self.role is None:
            self.role, self.ending = own, self.other[2]
            return None
        self.ending = None
        return self.role, own


def _streamed(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn: conv_id, position (from 0), role, sound (the order allows it), segments (text, loss)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = template.splitter()
        current, state, position = object(), template.start, 0
        for batch in batches:
            conv = batch.column("conv_id").to_pylist()
            positions, sounds, cut = [], [], []
            roles = batch.column("role").to_pylist()
            for c, role, text in zip(conv, roles, batch.column("text").to_pylist(), strict=True):
                if c != current:
                    current, state, position = c, template.start, 0
                state, sound = template.step(state, role)
                positions.append(position)
                sounds.append(sound)
                cut.append([{"text": t, "loss": loss} for t, loss in segments(role, text, template, splitter)])
                position += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(positions, pa.int64()), batch.column("role"), pa.array(sounds, pa.bool_()), pa.array(cut, _SEGMENTS)],
                ["conv_id", "position", "role", "sound", "segments"],
            )

    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"),
        common.whole(conversations["role"]).alias("role"), common.whole(conversations["text"]).alias("text"),
    )
    return _streamed(rows, "turn", "role", "text").mapInArrow(
        run, "conv_id long, position long, role string, sound boolean, segments array<struct<text: string, loss: boolean>>"
    )


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, from the formatted text alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, sound, closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "sound", "closed"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        current = object()
        parser = turns = loss = None
        n = lost = chars = 0
        sound, state = True, template.start

        def finished():
            return (current, n, turns.hexdigest(), lost, loss.hexdigest(), chars, sound, state in template.closed)

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            done = []
            for c, parts in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                if c != current:
                    if parser:
                        done.append(finished())
                    current, parser, turns, loss = c, Parser(template), hashlib.sha256(), hashlib.sha256()
                    n = lost = chars = 0
                    sound, state = True, template.start
                for part in parts:
                    chars += len(part["text"])
                    if part["loss"]:
                        text = unescape(part["text"])
                        lost += len(text)
                        loss.update(text.encode())
                for role, text in parser.feed("".join(p["text"] for p in parts)):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                    state, fits = template.step(state, role)
                    sound = sound and fits
            if done:
                yield batch_of(done)
        if parser:
            yield batch_of([finished()])

    return _streamed(formatted.select("conv_id", "position", "segments"), "position").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, sound boolean, closed boolean",
    )


def round_trip(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Formats, stores the segments in the shared folder and reads them back."""
    stored = common.scratch(conversations, "chat").save(format_turns(conversations, template), "segments")
    return read_back(stored, template)


def loss_text(formatted: DataFrame) -> DataFrame:
    """(conv_id, position, text) of the segments under the loss mask, unescaped."""
    parts = formatted.select("conv_id", "position", F.explode("segments").alias("part")).where("part.loss")
    return parts.select("conv_id", "position", F.regexp_replace("part.text", r"(?s)\\(.)", "$1").alias("text"))
