"""Conversations as training text, with the mask of what a model should learn to write."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.template import compile_template, unescape

#: Turns begin with ``### role: `` and end with ``</turn>``; control strings inside roles and texts are escaped.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_name }}: "
    "{% if m.role == trained_role %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
CONSTANTS = {"trained_role": "assistant"}
#: A conversation is put out in segments of about so many characters; most have one.
SEGMENT_CHARS = 1 << 16

_SEGMENT = "segment long, formatted string, mask array<struct<start:long,stop:long>>"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def segments(pieces: Iterable[tuple[str, bool]], size: int = SEGMENT_CHARS) -> Iterator[tuple[str, list[dict]]]:
    """Rendered pieces as texts of about ``size`` characters, each with the spans of its generated parts in code points."""
    parts: list[str] = []
    mask: list[dict] = []
    at = 0
    for text, generated in pieces:
        if generated:
            if mask and mask[-1]["stop"] == at:
                mask[-1]["stop"] = at + len(text)
            else:
                mask.append({"start": at, "stop": at + len(text)})
        parts.append(text)
        at += len(text)
        if at >= size:
            yield "".join(parts), mask
            parts, mask, at = [], [], 0
    if parts:
        yield "".join(parts), mask


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, constants: Mapping[str, Any] | None = None,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv_id, segment, formatted, mask``: each conversation rendered, in segments numbered from 0.

    ``mask`` has the spans of ``formatted``, in code points, that the template
    marks as generation. The template sees ``messages``, each with ``turn, role,
    text``, and the constants, which are folded when it is compiled.

    Turns are ordered by turn (nulls first), then role, then text, so ties and
    repeated rows have one order. Null texts and roles count as empty. Rows
    without an id form one conversation of their own. A table without rows gives
    none. Other columns are not read.

    Conversations are shuffled by id and rendered as a stream: a task holds
    a segment and two turns, however long the conversation is. Rows of the result
    stand side by side and in order within their partition.
    """
    constants = CONSTANTS if constants is None else dict(constants)
    id_type = turns.schema[conv_id].dataType
    ordered = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"messages"}, constants)
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_column = first.schema.field("conv_id").type

        def rows() -> Iterator[dict]:
            yield from _rows([first])
            yield from _rows(batches)

        def made() -> Iterator[tuple]:
            for key, messages in groupby(rows(), key=lambda row: row["conv_id"]):
                for n, (formatted, mask) in enumerate(segments(render(messages=messages))):
                    yield key, n, formatted, mask
                for _ in messages:
                    pass

        yield from _batches(made(), id_column)

    return ordered.mapInArrow(run, f"conv_id {id_type.simpleString()}, {_SEGMENT}")


_MASK = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _batches(made: Iterator[tuple], id_column: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 32 segments' worth of characters."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        keys, numbers, texts, masks = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, id_column), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, _MASK)],
            names=["conv_id", "segment", "formatted", "mask"],
        )

    for row in made:
        held.append(row)
        size += len(row[2]) + 64
        if size >= 32 * SEGMENT_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


# --- Reading back ----------------------------------------------------------------------------

_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*+): ", re.DOTALL)
_END = re.compile(r"\\.|</turn>\n", re.DOTALL)


def read_turns(parts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a conversation formatted by ``TEMPLATE``, from its segments in order."""
    held = ""
    for part in parts:
        held += part
        start = 0
        while head := _HEAD.match(held, start):
            end = next((m for m in _END.finditer(held, head.end()) if m[0][0] == "<"), None)
            if end is None:
                break
            yield unescape(head[1]), unescape(held[head.end():end.start()])
            start = end.end()
        held = held[start:]
    if held:
        raise ValueError("the formatted conversation ends within a turn")


class _Digest:
    """What is known of a conversation after the segments read so far."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def masked(self, rows: Iterable[dict]) -> Iterator[str]:
        for row in rows:
            self.formatted_chars += len(row["formatted"])
            for span in row["mask"]:
                kept = unescape(row["formatted"][span["start"]:span["stop"]])
                self.loss_chars += len(kept)
                self.loss.update(kept.encode())
            yield row["formatted"]

    def read(self, rows: Iterable[dict]) -> None:
        for role, text in read_turns(self.masked(rows)):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())


def digest_formatted(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per formatted conversation, read back from its text and mask.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``:
    the turns are parsed from the text and unescaped, and what stands under the
    mask is unescaped and joined. ``ordered`` says that the rows come straight
    from :func:`format_conversations`; rows read from storage are brought
    together by id and segment first. A digest is one chain, so a conversation is
    read by one task, as a stream.
    """
    rows = formatted if ordered else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    id_type = formatted.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_column = first.schema.field("conv_id").type

        def every() -> Iterator[dict]:
            yield from _rows([first])
            yield from _rows(batches)

        held: list[tuple] = []
        for key, group in groupby(every(), key=lambda row: row["conv_id"]):
            d = _Digest()
            d.read(group)
            held.append((key, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.formatted_chars))
            if len(held) == 4096:
                yield digests(held, id_column)
                held = []
        if held:
            yield digests(held, id_column)

    def digests(held: list[tuple], id_column: pa.DataType) -> pa.RecordBatch:
        kinds = [id_column, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return rows.mapInArrow(
        run, f"conv_id {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
