"""Chat formatting: a state machine over roles and a declarative template.

Turns are sorted inside their conversation and streamed, so a conversation of any length
needs no more memory than its longest turn. Every turn becomes three segments (opening
marker, text, closing marker) with a loss flag each. Control strings inside texts are
escaped, and ``read_back`` parses the formatted stream alone to give the turns again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers, role names, roles that are learned, and the turns that may follow each other."""

    opening: str = "### "
    named: str = ":\n"
    closing: str = "\n</turn>\n"
    roles: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    learned: frozenset = frozenset({"assistant"})
    follows: dict = field(
        default_factory=lambda: {
            "": {"system", "user"},
            "system": {"user"},
            "user": {"assistant"},
            "assistant": {"user", "tool"},
            "tool": {"assistant"},
        }
    )
    ends: frozenset = frozenset({"assistant"})

    def header(self, role: str) -> str:
        """A listed role by its name, any other one as ``=`` and its escaped text."""
        name = self.roles.get(role)
        return self.opening + (name if name else "=" + re.sub(r"([\\:\n#<])", r"\\\1", role)) + self.named

    def role(self, name: str) -> str:
        listed = {v: k for k, v in self.roles.items()}
        return listed[name] if not name.startswith("=") else re.sub(r"(?s)\\(.)", r"\1", name[1:])


CHAT = Template()
# Strings that mark turns; a backslash before each of them, and before a backslash.
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(\\|### |</turn>)")
_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n((?:[^\\<]|\\.|<(?!/turn>))*)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_SEGMENTS = "conv_id long, turn_no long, part string, text string, loss boolean, valid boolean"


def _segment_batches(template: Template):
    """Sorted turns to segments; ``valid`` on a closing says that the order held so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn_no, state, valid = object(), 0, "", True
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, turn_no, state, valid = c, 0, "", True
                valid = valid and role in template.follows.get(state, ())
                state = role
                out.append((c, turn_no, "open", template.header(role), False, None))
                out.append((c, turn_no, "text", escape(text), role in template.learned, None))
                out.append((c, turn_no, "close", template.closing, False, valid and role in template.ends))
                turn_no += 1
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds)],
                names=["conv_id", "turn_no", "part", "text", "loss", "valid"],
            )

    return run


def segments(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, turn_no, part, text, loss, valid: three rows per turn, in order per partition.

    Turns are ordered by turn, then role and text; null roles and texts are empty. The
    texts of a conversation, joined in this order, are its formatted form. ``valid`` of a
    conversation's last closing is the verdict of the state machine: system at most
    once and first, user and assistant in turn, tool after assistant, assistant at the
    end. Invalid conversations are formatted all the same.
    """
    slim = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_segment_batches(template), _SEGMENTS)


_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


class _Reader:
    """Parses the formatted stream of one conversation."""

    def __init__(self, template: Template):
        self.template, self.buffer, self.valid = template, "", True
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        self.buffer += piece
        if not self.buffer.endswith(self.template.closing):
            return
        found = _TURN.fullmatch(self.buffer)
        if not found:
            raise ValueError("formatted text can't be read back")
        role, text = self.template.role(found[1]), unescape(found[2])
        self.turns += 1
        self.turn_digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role in self.template.learned:
            self.loss_chars += len(text)
            self.loss_digest.update(text.encode("utf-8", "surrogatepass"))
        self.buffer = ""

    def row(self, conv: int) -> tuple:
        if self.buffer:
            raise ValueError("formatted text ends inside a turn")
        return (conv, self.turns, self.turn_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars, self.valid)


def _read_batches(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            columns = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for c, text, valid in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "valid"))):
                if reader is None or c != conv:
                    if reader is not None:
                        out.append(reader.row(conv))
                    conv, reader = c, _Reader(template)
                reader.feed(text)
                if valid is not None:
                    reader.valid = valid
            yield batch_of(out)
        if reader is not None:
            yield batch_of([reader.row(conv)])

    return run


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, from ``segments`` in the order in which it gives them."""
    return formatted.select("conv_id", "text", "valid").mapInArrow(_read_batches(template), _DIGEST)
