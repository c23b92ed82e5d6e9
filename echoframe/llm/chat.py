"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role its opening and closing control strings and says whether its text counts for the loss. The
machine reads a conversation's turns in order, says whether their order is allowed, and emits segments, each with a loss
flag. Control strings and backslashes inside texts are escaped by a backslash, which :func:`parse` undoes.

Turns of a conversation are dealt by its id and sorted by Spark; the machine reads them as a stream and keeps one state,
so a conversation of any length takes constant memory.

Defined cases: a null text or role is empty; a null id is a conversation of its own; turns with equal numbers go by role,
then text, and repeated rows stay; an order that isn't allowed is formatted all the same and told in ``valid``; very long
texts and conversations are formatted whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


@dataclass(frozen=True)
class Mark:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Mark] = field(
        default_factory=lambda: {"system": Mark("<<SYS>>", "<</SYS>>"), "user": Mark("[INST] ", " [/INST]"), "assistant": Mark("<s>", "</s>", True), "tool": Mark("[TOOL] ", " [/TOOL]")}
    )
    #: Any other role: its name stands between the first two.
    other: tuple[str, str, str] = ("[ROLE ", "] ", " [/ROLE]")
    #: Allowed steps of the machine; "" is the start, and a conversation may end after any role in ``final``.
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
    )
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({x.strip() for m in self.roles.values() for x in (m.open, m.close)} | {self.other[0].strip(), self.other[2].strip()}, key=len, reverse=True)


def escape(text: str, t: Template) -> str:
    """Backslashes doubled, and one before each control string; ``]`` too, which ends an unknown role's name."""
    return re.sub("|".join(map(re.escape, ["\\", "]", *t.controls()])), lambda m: "\\" + (m[0] if m[0] != "\\" else "\\"), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segments(role: str, text: str, t: Template) -> list[tuple[str, bool]]:
    """A turn as (text, counts for the loss) in order."""
    if role in t.roles:
        m = t.roles[role]
        return [(m.open, False), (escape(text, t), m.loss), (m.close, False)]
    a, b, c = t.other
    return [(a + escape(role, t) + b, False), (escape(text, t), False), (c, False)]


def parse(formatted: str, t: Template) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted string."""
    opens = {m.open: (r, m.close) for r, m in t.roles.items()}
    at = 0
    while at < len(formatted):
        role, close, start = next(((r, c, at + len(o)) for o, (r, c) in opens.items() if formatted.startswith(o, at)), (None, t.other[2], at))
        if role is None:
            end = re.compile(r"(?:\\.|[^\\\]])*+", re.S).match(formatted, at + len(t.other[0])).end()
            role, start = unescape(formatted[at + len(t.other[0]) : end]), end + len(t.other[1])
        stop = re.compile(r"(?:\\.|(?!%s)[^\\])*+" % re.escape(close), re.S).match(formatted, start).end()
        yield role, unescape(formatted[start:stop])
        at = stop + len(close)


FORMATTED = "conv_id long, seq long, formatted string, loss_from long, loss_to long, valid boolean"


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn, ``seq`` giving its place: its formatted string, the code points under the loss mask (from, to; -1
    if none), and whether the order was allowed up to here. A conversation's string is the concatenation by ``seq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, seq, valid = object(), "", 0, True
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                role, text = role or "", text or ""
                if conv != now:
                    now, state, seq, valid = conv, "", 0, True
                valid = valid and role in template.steps.get(state, ())
                state = role
                out, at, loss = [], 0, (-1, -1)
                for piece, counts in segments(role, text, template):
                    out.append(piece)
                    if counts:
                        loss = (at, at + len(piece))
                    at += len(piece)
                rows.append((conv, seq, "".join(out), *loss, valid))
                seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)

    dealt = conversations.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


NAMES = [x.split()[0] for x in FORMATTED.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digests(output: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted rows say when they are parsed back: one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, some, last = None, False, ""

        def ended():
            return (now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid and last in template.final)

        for b in batches:
            rows = []
            for conv, text, lo, hi, ok in zip(*(b.column(i).to_pylist() for i in range(5))):
                if not some or conv != now:
                    if some:
                        rows.append(ended())
                    now, some, n, loss_chars, chars = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text, template):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n, last = n + 1, role
                valid = ok
                chars += len(text)
                if lo >= 0:
                    under = unescape(text[lo:hi])
                    loss.update(under.encode("utf-8", "surrogatepass"))
                    loss_chars += len(under)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(ended(), kinds)], names)

    dealt = output.select("conv_id", "formatted", "loss_from", "loss_to", "valid", "seq").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return dealt.drop("seq").mapInArrow(run, DIGEST)


def round_trip(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The formatted rows are written, read back and parsed."""
    return digests(written(formatted(conversations, template), "chat"), template)
