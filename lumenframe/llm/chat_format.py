"""Chat formatting by a visitor over typed content parts.

A conversation is formatted as a run of segments, one a turn; their concatenation is the conversation's text:

    <s>[ROLE]user[/ROLE][INST]question[/INST][ROLE]assistant[/ROLE]answer</s>

The first segment of a conversation starts with <s>. What an assistant says stands between [/ROLE] and </s>; what any other
role says between [INST] and [/INST]. The loss mask covers the assistant's text alone.

Control strings inside a text or a role are escaped reversibly: a backslash goes in after their first character, and one more
where backslashes are there already (`[INST]` -> `[\\INST]` -> `[\\\\INST]`), so that other text stays as it is.

Content is a string (one text part) or an array of parts, struct<type, text, ref, width, height, seconds, pages>. Text parts
are escaped; an image, audio or document part becomes its placeholder, repeated once per token that the model will see in its
place, and an attachment (kind, ref, position among the conversation's attachments, tokens) is recorded. Unknown part types
are taken as text.

Rows are dealt by conversation and sorted by turn, and read as a stream: a task holds one Arrow batch, however long a
conversation is. Defined results: null text or content is empty; a null role is an empty one; a null conv_id is a
conversation of its own; a null turn comes first; ties in turn are ordered by role, then content; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[IMAGE]", "[AUDIO]", "[DOCUMENT]")
_PLAIN = re.compile("|".join(f"{re.escape(x[0])}(\\\\*){re.escape(x[1:])}" for x in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(x[0])}(\\\\+){re.escape(x[1:])}" for x in CONTROL))
_SEGMENT = re.compile(r"(?:<s>)?\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?)</s>)", re.S)
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


@dataclass
class Visitor:
    """Flattens parts in order. patch: pixels on a side of one image token; rate: audio tokens a second; page: tokens a page."""

    patch: int = 14
    rate: float = 12.5
    page: int = 256
    attachments: list[dict] = field(default_factory=list)

    def visit(self, content) -> str:
        if content is None:
            return ""
        if isinstance(content, str):
            return escape(content)
        # escaped as one run: a control string split over two text parts would otherwise come together unescaped
        out, run = [], []
        for part in content:
            kind = (part or {}).get("type")
            act = getattr(self, f"visit_{kind}", None) if kind in ("image", "audio", "document") else None
            if act is None:
                run.append((part or {}).get("text") or "")
            else:
                out += [escape("".join(run)), act(part)]
                run = []
        return "".join([*out, escape("".join(run))])

    def visit_image(self, part: dict) -> str:
        return self._attach("image", part, math.ceil((part.get("width") or 1) / self.patch) * math.ceil((part.get("height") or 1) / self.patch))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.rate))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 1) * self.page)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        tokens = max(1, tokens)
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"[{kind.upper()}]" * tokens


SEGMENT = ("conv_id long, position long, segment string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string,position:long,tokens:int>>, expanded_tokens long")
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int32())]))), ("expanded_tokens", pa.int64())])


def format_turns(turns: DataFrame, content: str = "text", **sizes) -> DataFrame:
    """One row per turn of (conv_id, turn, role, content): its segment, where the loss mask lies in it (code points; null
    without), its attachments and the tokens they expand to. Rows come dealt by conversation, in order within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, position, attached = (), 0, 0
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if (x["conv_id"],) != last:
                    last, position, attached = (x["conv_id"],), 0, 0
                visitor = Visitor(**sizes)
                body = visitor.visit(x["content"])
                role = x["role"] or ""
                head = f"{'' if position else '<s>'}[ROLE]{escape(role)}[/ROLE]"
                mask = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
                for k, a in enumerate(visitor.attachments):
                    a["position"] = attached + k
                segment = f"{head}{body}</s>" if role == "assistant" else f"{head}[INST]{body}[/INST]"
                rows.append({"conv_id": x["conv_id"], "position": position, "segment": segment, "loss_start": mask[0], "loss_end": mask[1], "attachments": visitor.attachments, "expanded_tokens": sum(a["tokens"] for a in visitor.attachments)})
                position += 1
                attached += len(visitor.attachments)
            yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENTS)

    given = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), turns[content].alias("content"))
    order = F.col("content") if isinstance(given.schema["content"].dataType, T.StringType) else F.to_json("content")
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", order).mapInArrow(run, SEGMENT)


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a segment, unescaped."""
    m = _SEGMENT.fullmatch(segment)
    return unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])


def digests(segments: DataFrame) -> DataFrame:
    """Of what format_turns() returns, unchanged in order: one row per conversation, read back from its segments."""
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = pa.schema(list(zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, position, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "segment", "loss_start", "loss_end")), strict=True):
                if not position:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescape(segment[start:end])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_pylist([_row(columns, x) for x in done], schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([_row(columns, state)], schema=schema)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _row(columns, state) -> dict:
    return dict(zip(columns, (x.hexdigest() if hasattr(x, "hexdigest") else x for x in state), strict=True))
