"""Chat formatting by event-sourced reconstruction.

A log has one row per event of a conversation. Events of one message are folded in the
order of their sequence numbers; messages are rendered by a template that marks turns and
escapes control strings; the pieces of a conversation follow each other in the order of
their first events. Messages are dealt by (conversation, message), so that folding,
rendering and escaping of one huge conversation run in many tasks; what reads a
conversation as a whole streams its pieces and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import partitions

#: Kinds of events: a whole message, text added at its end, its text replaced, its answer begun anew, and its removal.
MESSAGE, DELTA, EDIT, REGENERATE, DELETE = "message", "delta", "edit", "regenerate", "delete"

# The control strings of this template, and those of other widely used ones.
TURN, HEAD_END, TURN_END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, HEAD_END, TURN_END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<start_of_turn>", "<end_of_turn>")
_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNBREAK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""No control string is left: ``\`` becomes ``\\``, and ``\.`` follows the first character of each control string."""
    return _BREAK.sub(lambda m: m[0] + "\\.", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNBREAK.sub(lambda m: m[1] if m[1] == "\\" else "", text)


def render(role: str, text: str) -> str:
    """One turn. The text under the loss mask is what lies between HEAD_END and TURN_END of an assistant's turn."""
    return f"{TURN}{escape(role)}{HEAD_END}{escape(text)}{TURN_END}\n"


def parse(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, text, first and end of the escaped text) of each turn of a formatted conversation."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at character {at}")
        head = formatted.index(HEAD_END, at)
        end = formatted.index(TURN_END, head)
        first = head + len(HEAD_END)
        yield unescape(formatted[at + len(TURN) : head]), unescape(formatted[first:end]), (first, end)
        at = end + len(TURN_END) + 1


def masked(formatted: str) -> Iterator[str]:
    """The texts under the loss mask, unescaped."""
    return (text for role, text, _ in parse(formatted) if role == "assistant")


class Fold:
    """State of one message."""

    def __init__(self) -> None:
        self.role, self.parts, self.gone, self.begun = "", [], False, False

    def add(self, kind: str | None, role: str | None, text: str | None) -> None:
        """Applies an event. A null kind is a whole message, a null text empty; unknown kinds are errors.

        The first role that is not empty stays. After a removal, deltas are lost; a whole message, an
        edit or a regeneration brings the message back with its text.
        """
        if role and not self.role:
            self.role = role
        if kind in (None, MESSAGE, EDIT):
            self.parts, self.gone = [text or ""], False
        elif kind == DELTA:
            self.parts.append(text or "")
        elif kind == REGENERATE:
            self.parts, self.gone = [text or ""], False
        elif kind == DELETE:
            self.parts, self.gone = [], True
        else:
            raise ValueError(f"event kind {kind!r} is not known")


EVENTS = ("conv_id", "message_id", "seq", "kind", "role", "text")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, seq, role, text): the final messages; seq is that of a message's first event.

    Needs EVENTS; other columns are ignored. Null ids are ids of their own, and null sequence
    numbers come first; ties are ordered by kind, role and text, so that the result does not
    depend on the order of rows. Repeated deltas count as often as they come.
    """
    schema = {c: events.schema[c].dataType for c in EVENTS}
    dealt = events.select(*EVENTS).repartition(partitions(events.sparkSession), "conv_id", "message_id").sortWithinPartitions(*EVENTS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, state = None, None, Fold()
        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field(i) for i in (0, 1, 2)] + [pa.field("role", pa.string()), pa.field("text", pa.string())])
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for conv, message, seq, kind, role, text in zip(*columns, strict=True):
                if now != (conv, message):
                    if now is not None and not state.gone:
                        done.append((*now, first, state.role, "".join(state.parts)))
                    now, first, state = (conv, message), seq, Fold()
                state.add(kind, role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now is not None and not state.gone:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, first, state.role, "".join(state.parts)), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(fold, f"conv_id {schema['conv_id'].simpleString()}, message_id {schema['message_id'].simpleString()}, seq {schema['seq'].simpleString()}, role string, text string")


def pieces(folded: DataFrame) -> DataFrame:
    """folded with ``piece``: each message as the template writes it. A null role is an empty one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            made = pa.array([render(r or "", t or "") for r, t in zip(roles, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], [*batch.schema.names[:3], "piece"])

    own = ", ".join(f"{c} {folded.schema[c].dataType.simpleString()}" for c in ("conv_id", "message_id", "seq"))
    return folded.mapInArrow(write, f"{own}, piece string")


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, formatted): each conversation's pieces in order as one string. For conversations that fit in a row."""
    made = pieces(messages(events))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "message_id", "piece")))
    return made.groupBy("conv_id").agg(F.concat_ws("", F.transform(ordered, lambda x: x["piece"])).alias("formatted"))


def digests(events: DataFrame) -> DataFrame:
    """One row per conversation with what is read back from its formatted turns.

    The pieces stream in order; a conversation of any length takes the memory of one piece.
    """
    made = pieces(messages(events))
    kind = events.schema["conv_id"].dataType.simpleString()
    dealt = made.repartition(partitions(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq", "message_id", "piece")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state, key = None, None, None

        def row(kind: pa.DataType) -> pa.RecordBatch:
            n, turns, chars, loss, length = state
            values = [[now[0]], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [length]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)

        for batch in batches:
            key = batch.schema.field(0).type
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != (conv,):
                    if now is not None:
                        yield row(key)
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _ in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in masked(piece):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece)
        if now is not None:
            yield row(key)

    return dealt.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of messages (conv_id, turn, role, text) as a log such as chat services keep: each row is a message of its own.

    A user's message arrives as a delta of its first half and an edit to the whole. An assistant's begins with a delta,
    is edited, and is regenerated from nothing in two deltas. Rows that repeat a turn stay separate messages, in the
    order of a digest of role and text, so that the order does not depend on that of the rows. Null turns come
    first and are one event.
    """
    body, turn = F.coalesce("text", F.lit("")), F.col("turn")
    own = F.sha2(F.concat_ws("\0", F.coalesce("role", F.lit("")), body), 256)
    row = F.concat_ws(":", own, F.monotonically_increasing_id().cast("string"))
    rows = conversations.select("conv_id", row.alias("message_id"), turn.cast("decimal(19,0)").alias("turn"), "role", body.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.left("text", half), F.substring("text", half + 1, F.length("text"))
    event = lambda i, kind, text: F.struct((F.col("turn") * 8 + i).cast("decimal(22,0)").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.concat(F.left("text", F.lit(9)), F.lit(" [draft]"))
    answer = F.array(event(0, DELTA, F.left("text", F.lit(30))), event(1, EDIT, draft), event(2, REGENERATE, F.lit("")), event(3, DELTA, first), event(4, DELTA, rest))
    asked = F.array(event(0, DELTA, F.left("text", F.lit(30))), event(1, EDIT, F.col("text")))
    whole = F.array(F.struct(F.col("turn").cast("decimal(22,0)").alias("seq"), F.lit(MESSAGE).alias("kind"), F.col("text").alias("text")))
    log = F.when(F.col("turn").isNull(), whole).when(F.col("role") == "assistant", answer).otherwise(asked)
    return rows.select("conv_id", "message_id", "role", F.explode(log).alias("_e")).select("conv_id", "message_id", "_e.seq", "_e.kind", "role", "_e.text")
