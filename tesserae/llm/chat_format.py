"""Conversations formatted by a compiled template, with marks on what a model is trained to write.

Control strings inside texts are escaped reversibly, so that a formatted conversation can be parsed back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import Template

#: Marks of the default template; each begins with a character that no mark has further on.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "</s>"
CONTROL = (OPEN, BODY, CLOSE, "<s>", "[INST]", "[/INST]")
TEMPLATE = (
    "<s>{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</s>{% endfor %}"
)


@dataclass(frozen=True)
class Escaping:
    """Doubles backslashes, and puts one behind the first character of every control string."""

    control: tuple[str, ...] = CONTROL

    def escape(self, text: object) -> str:
        text = ("" if text is None else str(text)).replace("\\", "\\\\")
        some = "|".join(map(re.escape, sorted(self.control)))
        return re.sub(rf"(?s)(.)(?<=(?=(?:{some})).)", r"\1\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


@dataclass(frozen=True)
class ChatFormat:
    """``part`` characters of a long conversation, about, stand in one row, so that memory stays bounded."""

    template: str = TEMPLATE
    control: tuple[str, ...] = CONTROL
    part: int = 1 << 20

    def format(self, conversations: DataFrame) -> DataFrame:
        """``conv_id, part, text, spans`` of ``conv_id, turn, role, text`` rows (other columns are ignored).

        Turns are ordered by turn, then role and text; null roles and texts are empty; a null conv_id is a conversation;
        repeated rows are turns of their own; an empty table gives no rows. ``spans``: starts and ends, in the part's
        code points, of what the model is trained to write. A part ends at the end of an output of the template.
        """
        source, control, most = self.template, self.control, self.part
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.int32()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            template = Template(source, {"escape": Escaping(control).escape})
            done: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done.clear()
                return out

            rows = (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True))
            for conv, turns in groupby(rows, key=lambda x: x[0]):
                text, spans, part, length = [], [], 0, 0

                def write(piece: str, generated: bool) -> None:
                    nonlocal text, spans, part, length, size
                    if generated:
                        spans += (length, length + len(piece))
                    text.append(piece)
                    length += len(piece)
                    if length >= most:
                        end()

                def end() -> None:
                    nonlocal text, spans, part, length, size
                    done.append((conv, part, "".join(text), spans))
                    size += length
                    text, spans, part, length = [], [], part + 1, 0

                template.render(write, messages=({"role": role, "text": x} for _, role, x in turns))
                if text or not part:
                    end()
                if size >= 1 << 22:
                    yield flush()
                    size = 0
            if done:
                yield flush()

        text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), text("role"), text("text"))
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
        return rows.mapInArrow(run, "conv_id long, part int, text string, spans array<int>")

    def digests(self, formatted: DataFrame) -> DataFrame:
        """Turns and trained text of conversations in the default template's form, parsed from ``format``'s output.

        conv_id, n_turns, turns_sha256 (of role, newline, text, newline a turn), loss_chars, loss_sha256,
        formatted_chars, unescaped.
        """
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        undo, utf8 = Escaping.unescape, lambda x: x.encode("utf-8", "surrogatepass")

        def read(parts: Iterator[tuple]) -> tuple:
            """One conversation, part by part; only its last open turn is kept."""
            turns, loss, n, chars, total, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, text, spans in parts:
                total += len(text)
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    piece = undo(text[a:b])
                    chars += len(piece)
                    loss.update(utf8(piece))
                *whole, rest = (rest + text).split(CLOSE)
                for turn in whole:
                    role, _, body = turn[turn.index(OPEN) + len(OPEN) :].partition(BODY)
                    turns.update(utf8(f"{undo(role)}\n{undo(body)}\n"))
                    n += 1
            return n, turns.hexdigest(), chars, loss.hexdigest(), total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = []
            rows = (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True))
            for conv, parts in groupby(rows, key=lambda x: x[0]):
                done.append((conv, *read(parts)))
                if len(done) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                    done = []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "text", "spans")
        return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
