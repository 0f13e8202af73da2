"""Chat formatting of conversations made of typed content parts.

A visitor flattens a message's parts (text, image, audio, document) in order:
text as it is but for escapes, any other part as a placeholder, whose reference
and expanded token count are recorded.  Messages follow each other in the
template ``<|im_start|>role\\ntext<|im_end|>\\n``.

Control strings inside a text (those of ``CONTROL``) get a backslash after their
first character and a backslash is doubled, so that none is left in a text and
``unescape`` gives it back exactly.

A conversation comes out as one row per message, with the character at which the
message begins in the whole formatted conversation and the span under the loss
mask (the text of an assistant's message).  Messages are sorted by Spark within
a conversation and pass through a task in a stream, so no conversation, however
long, is held in memory.

Defined cases: a null text is empty; a null role is an empty role; messages of
one turn number follow by role, then text (null turns first, nulls before
others); repeated rows are messages of their own; a null ``conv_id`` is a
conversation of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mean something to a chat template, ours or another; fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
START, END = "<|im_start|>", "<|im_end|>\n"
_SEGMENT = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n\Z", re.S)
#: Tokens that a part takes once it is expanded: image per patch, audio per second, document per page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024

SCHEMA = ("conv_id {key}, turn bigint, position bigint, formatted string, starts bigint, loss_start bigint, "
          "loss_end bigint, expanded_tokens bigint, "
          "attachments array<struct<kind:string,ref:string,at:bigint,tokens:bigint>>")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of one message; ``text`` is what they flatten to."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: Mapping) -> None:
        kind = part.get("type")
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:
            raise ValueError(f"content part of unknown type {kind!r}")
        visitor(part)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, part: Mapping) -> None:
        self._add(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: Mapping, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._add(f"<|{kind}|>")

    def visit_image(self, part: Mapping) -> None:
        sides = [ceil(max(0, part.get(k) or 0) / IMAGE_PATCH) for k in ("width", "height")]
        self._attach("image", part, max(1, sides[0] * sides[1]))

    def visit_audio(self, part: Mapping) -> None:
        self._attach("audio", part, max(1, ceil(max(0.0, part.get("seconds") or 0.0) * AUDIO_RATE)))

    def visit_document(self, part: Mapping) -> None:
        self._attach("document", part, PAGE_TOKENS * max(1, part.get("pages") or 0))

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def flatten(parts: Sequence[Mapping]) -> Flattener:
    out = Flattener()
    for p in parts:
        out.visit(p)
    return out


def read_segment(formatted: str) -> tuple[str, str]:
    """Role and text (placeholders kept) of one formatted message."""
    m = _SEGMENT.match(formatted)
    if m is None:
        raise ValueError("not a formatted message")
    return unescape(m[1]), unescape(m[2])


def format_conversations(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per message, in the columns of ``SCHEMA``; ``parts`` (array of structs) is used where it isn't null.

    A struct of ``parts`` has ``type`` and what its kind needs of: text, ref,
    width, height, seconds, pages.
    """
    spark = messages.sparkSession
    kind = messages.schema[key].dataType.simpleString()
    columns = [F.col(f"`{key}`").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
               F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
               F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")]
    if parts is not None:
        columns.append(F.col(f"`{parts}`").alias("parts"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (messages.select(*columns).repartition(n, "conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches):
        now, position, at = object(), 0, 0
        for b in batches:
            names = b.schema.names
            rows = zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True)
            out: list[list] = [[] for _ in range(9)]
            for conv, turn_no, role_, text_, *more in rows:
                if conv != now:
                    now, position, at = conv, 0, 0
                flat = flatten(more[0] if more and more[0] is not None else [{"type": "text", "text": text_}])
                head = f"{START}{escape_role(role_)}\n"
                whole = head + flat.text + END
                begin = at + len(head)
                loss = (begin, begin + flat.length) if role_ == "assistant" else (None, None)
                marks = [a | {"at": a["at"] + begin} for a in flat.attachments]
                for column, value in zip(out, (conv, turn_no, position, whole, at, *loss,
                                               sum(a["tokens"] for a in marks), marks), strict=True):
                    column.append(value)
                position += 1
                at += len(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()),
                 *(pa.array(out[i], pa.int64()) for i in range(4, 8)),
                 pa.array(out[8], pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()),
                                                      ("at", pa.int64()), ("tokens", pa.int64())])))],
                names=["conv_id", "turn", "position", "formatted", "starts", "loss_start", "loss_end",
                       "expanded_tokens", "attachments"])

    return ordered.mapInArrow(run, SCHEMA.format(key=kind))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the rows of ``format_conversations`` in their order."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches) -> Iterator[pa.RecordBatch]:
        now, state, type_ = object(), None, None

        def row():
            conv, n, turns, chars, loss, size = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                    "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        def batch(rows):
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("conv_id", type_), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                 ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        for b in batches:
            type_, done = b.schema.field(0).type, []
            for conv, segment, starts, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    masked = unescape(segment[lo - starts:hi - starts])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(segment)
            if done:
                yield batch(done)
        if state is not None:
            yield batch([row()])

    return formatted.select("conv_id", "formatted", "starts", "loss_start", "loss_end").mapInArrow(
        read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """Format all conversations, and one whose texts are control strings, and digest what is read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    return conversation_digests(format_conversations(rows.unionByName(extra)))
