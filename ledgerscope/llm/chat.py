"""Chat formatting: conversations rendered by a compiled template, and read back.

The template marks turns with control strings.  Those strings are escaped inside texts
and roles by a reversible code, so a text that holds them cannot end a turn: the escape
character follows every character that can start a control string, and itself.

Turns of a conversation are hashed in order, which is one stream per conversation by
nature.  Rows are shuffled by conversation, sorted by Spark with spilling, and drawn
through the template one turn at a time: memory does not grow with the conversation.

Defined results: null texts and roles are empty; turns are ordered by turn (null first),
then role, then text, so ties and repeated rows have one order; rows without conversation
id form one conversation; an empty table gives only what was added to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerscope.llm.frames import arrow_type, column, small_batches
from ledgerscope.llm.template import compile_template

ESCAPE = "\x10"
ASSISTANT = "assistant"
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
# Every control string starts with one of the first three.
_OPENING = re.compile(r"[<\[|\x10]")
_ESCAPED = re.compile(r"([<\[|\x10])\x10")

TEMPLATE = (
    "<s>{% for turn in turns %}"
    "<|{{ turn.role | escape }}|>"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>"
    "{% elif turn.role == 'system' %}<<SYS>>{{ turn.text | escape }}<</SYS>></s>"
    "{% else %}[INST]{{ turn.text | escape }}[/INST]</s>{% endif %}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """Break up control strings: the escape follows each character that can start one, and itself."""
    return _OPENING.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return _ESCAPED.sub(lambda m: m[1], text)


FILTERS = {"escape": lambda value: escape("" if value is None else str(value))}
_TURN = re.compile(
    r"<\|(?P<role>.*?)\|>(?:<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|(?P<assistant>.*?))</s>", re.S
)


class Reader:
    """Reads turns back from rendered text and mask, piece by piece."""

    def __init__(self):
        self.held: list[str] = []
        self.n_turns = self.formatted = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.masked: list[str] = []

    def feed(self, text: str, under_mask: bool) -> None:
        self.formatted += len(text)
        self.held.append(text)
        if under_mask:
            self.masked.append(text)
        elif "</s>" in text:
            self._turn()

    def _turn(self) -> None:
        """A turn ended: parse what is held; the mask of this turn is complete as well."""
        text = "".join(self.held)
        self.held = []
        if text.startswith("<s>"):
            text = text[3:]
        at = 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
            body = m["system"] if m["system"] is not None else m["user"] if m["user"] is not None else m["assistant"]
            said = f"{unescape(m['role'])}\n{unescape(body)}\n"
            self.turns.update(said.encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        if at < len(text):
            self.held.append(text[at:])
        said = unescape("".join(self.masked))
        self.masked = []
        self.loss_chars += len(said)
        self.loss.update(said.encode("utf-8", "surrogatepass"))

    def result(self) -> dict:
        left = "".join(self.held)
        if left not in ("", "<s>"):
            raise ValueError("an unfinished turn")
        return {
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.formatted,
        }


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")))


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Each conversation with an iterator of its turns (to be used up before the next)."""
    for conv, turns in groupby(rows, key=lambda r: r[0]):
        yield conv, ({"role": role or "", "text": text or ""} for _, role, text in turns)


def _sorted(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    small_batches(rows.sparkSession)
    return (
        rows.select(
            column(conv_id).alias("conv_id"), column(turn).alias("turn"), column(role).alias("role"), column(text).alias("text")
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )


def _per_conversation(ready: DataFrame, template: str, result: str, make) -> DataFrame:
    schema = f"conv_id {ready.schema['conv_id'].dataType.simpleString()}, {result}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        out: list[dict] = []
        for conv, turns in _conversations(_turns(batches)):
            out.append({"conv_id": conv, **make(turns, render)})
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    kind = arrow_type(T._parse_datatype_string(schema))

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        made = pa.array(rows, kind)
        return pa.RecordBatch.from_arrays(made.flatten(), [f.name for f in kind])

    return ready.mapInArrow(run, schema)


def format_conversations(
    rows: DataFrame,
    template: str = TEMPLATE,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id, formatted, loss_spans``: the text, and code point ranges under the mask.

    The output itself holds the whole conversation; use :func:`digests` where only
    figures are wanted and conversations may be very long.
    """

    def make(turns, render):
        parts, spans, at = [], [], 0
        for piece, masked in render(turns=turns):
            if masked:
                spans += [at, at + len(piece)]
            parts.append(piece)
            at += len(piece)
        return {"formatted": "".join(parts), "loss_spans": spans}

    ready = _sorted(rows, conv_id, turn, role, text)
    return _per_conversation(ready, template, "formatted string, loss_spans array<long>", make)


def digests(
    rows: DataFrame,
    template: str = TEMPLATE,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Figures of each conversation, read back from the rendered stream."""

    def make(turns, render):
        reader = Reader()
        for piece, masked in render(turns=turns):
            reader.feed(piece, masked)
        return reader.result()

    result = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _per_conversation(_sorted(rows, conv_id, turn, role, text), template, result, make)


def with_probe(rows: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = rows.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string"
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
