"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to text. Successive prefixes
of a conversation are rendered and compared: what the output gains is the
turn's span. If an output doesn't begin with the one before, the template
rewrites history, and the turn is marked. Where the text of an assistant turn
lies in its span is found by rendering the turn with two probe texts that
differ in their only character: they agree up to where the text begins and
after where it ends.

Every prefix is rendered whole, so a template is called on all turns so far and
time grows with the square of a conversation's turns. Only a template that is
declared to concatenate what it makes of each turn alone (its attribute
``concatenates`` is true, as for the standard one) is rendered over the last
``window`` turns of a longer conversation, which gives the same spans in time
linear in its turns.
The formatted text is stored a span per row; a conversation is never gathered,
both ways stream over rows sorted by conversation and turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, partitions_for, session_of

Turn = dict[str, str]

CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")
_RAW = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
_SPAN = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """A control string, with any backslashes after its first character, gets one more of them."""
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_turns(turns: list[Turn]) -> str:
    """The standard template: marked turns, control strings in texts escaped."""
    return "".join(f"<|turn|>{_role(t['role'])}\n{escape(t['text'])}<|end|>\n" for t in turns)


def parse_span(span: str) -> tuple[str, str]:
    """Role and text of a span of the standard template."""
    m = _SPAN.fullmatch(span)
    if m is None:
        raise ValueError("not a span of the standard template")
    return _unrole(m[1]), unescape(m[2])


render_turns.concatenates = True

PROBES = ("\ue000", "\ue001")


class Renderer:
    """Spans of the turns of one conversation after another."""

    def __init__(self, render: Callable[[list[Turn]], str], window: int = 64, loss_role: str = "assistant"):
        self.render, self.loss_role = render, loss_role
        self.window = window if getattr(render, "concatenates", False) else None
        self.start()

    def start(self) -> None:
        self.turns: list[Turn] = []
        self.before = self.render([])

    def add(self, role: str, text: str) -> tuple[str | None, int | None, int | None, bool]:
        """Span, where its loss begins and ends in code points (null: no loss), and whether history was rewritten.

        The first span holds whatever the template puts before all turns.
        """
        fresh = not self.turns
        if self.window is not None and len(self.turns) >= self.window:
            self.turns = self.turns[1 - self.window :] if self.window > 1 else []
            self.before = self.render(self.turns)
        after = self.render([*self.turns, {"role": role, "text": text}])
        intact = after.startswith(self.before)
        span = after if fresh else after[len(self.before) :]
        begin = end = None
        if intact and role == self.loss_role:
            a, b = (self.render([*self.turns, {"role": role, "text": p}]) for p in PROBES)
            head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None)
            if head is not None and len(a) == len(b) and head >= len(self.before):
                tail = len(a) - head - 1
                shift = 0 if fresh else len(self.before)
                begin, end = head - shift, len(after) - tail - shift
                intact = begin <= end and after[:head] == a[:head] and after.endswith(a[head + 1 :])
            else:
                intact = False
        self.turns.append({"role": role, "text": text})
        self.before = after
        return (span, begin, end, False) if intact else (None, None, None, True)


SPANS = "position long, span string, loss_start int, loss_end int, rewritten boolean"


def format_conversations(conversations: DataFrame, render: Callable[[list[Turn]], str] = render_turns, window: int = 64) -> DataFrame:
    """A row for each turn of ``conversations`` (conv_id, turn, role, text), in order of turn, role, text.

    Null text and null role are empty; null turn comes first; null conv_id is a
    conversation; repeated rows are turns. An empty table gives no rows.
    """
    spark = session_of(conversations)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition(partitions_for(spark, 0, 1), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType), *T._parse_datatype_string(SPANS).fields])

    def run(batches):
        import pyarrow as pa

        renderer, now, position = Renderer(render, window), object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now:
                    renderer.start()
                    now, position = conv, 0
                out.append((position, *renderer.add(role, text)))
                position += 1
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return ordered.mapInArrow(run, schema)


def digests(spans: DataFrame) -> DataFrame:
    """What the stored spans of the standard template hold, a row per conversation."""
    spark = session_of(spans)
    ordered = spans.repartition(partitions_for(spark, 0, 1), "conv_id").sortWithinPartitions("conv_id", "position")
    schema = T.StructType([T.StructField("conv_id", spans.schema["conv_id"].dataType), *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean").fields])

    def run(batches):
        import pyarrow as pa

        key_type = None
        now, state = None, None
        done: list[tuple] = []

        def close():
            n, turns, chars, loss, total, rewritten = state
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total, rewritten))

        def out():
            cols = list(zip(*done, strict=True)) or [[]] * 7
            types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)

        for batch in batches:
            key_type = batch.column(0).type
            for conv, span, a, b, rewritten in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[0] += 1
                state[5] |= rewritten
                if span is None:
                    continue
                role, text = parse_span(span)
                state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    learned = unescape(span[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(span)
            if len(done) >= 4096:
                yield out()
        if state is not None:
            close()
            yield out()

    return ordered.mapInArrow(run, schema)


def format_and_read_back(conversations: DataFrame, scratch_group: str = "chat") -> DataFrame:
    """Format, write the spans, and return the digests of what is read back."""
    scratch = Scratch(session_of(conversations), scratch_group)
    return digests(scratch.table("spans", format_conversations(conversations)))
