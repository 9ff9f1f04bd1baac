"""Chat formatting from event logs: conversations are put together from their events and rendered with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is `### role:`, a line feed, the text, `</turn>`, a line feed.  In roles and texts a backslash stands before each
#: backslash and before what could be read as a mark, so that a mark without one is always the template's.
_HEAD, _END = "### ", "</turn>"
_MARKS = re.compile(r"\\|#|</turn>")
_ROLE_MARKS = re.compile(r"[\\#:\n]|</turn>")
_READ = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\:\n])*):\n((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)
#: Kinds of events.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escaped(text: str) -> str:
    return _MARKS.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _READ.sub(r"\1", text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it, in code points."""
    head = _HEAD + _ROLE_MARKS.sub(lambda m: "\\" + m[0], role) + ":\n"
    body = escaped(text)
    return head + body + _END + "\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    return [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(formatted)]


def _fold(events: Iterable[tuple]) -> Iterator[tuple[str, str]]:
    """Final messages of one conversation from its events (turn, seq, kind, role, text), by turn and then by sequence.

    Only the message at hand is held.  A regeneration takes back what came before it at its own and all later turns; as
    turns come in order, the newest of those seen so far is all that has to be known.
    """
    void = None  # sequence of the newest regeneration of an earlier turn
    for _, of_turn in groupby(events, key=lambda e: e[0]):
        messages: list[list] = []
        newest = void
        for _, seq, kind, role, text in of_turn:
            if void is not None and (seq is None or seq <= void):
                continue
            if kind == REGENERATE:
                messages = [[role, [text]]]
                newest = seq if newest is None or (seq is not None and seq > newest) else newest
            elif kind == EDIT and messages:
                messages[-1][1] = [text]
            elif kind == DELTA and messages:
                messages[-1][1].append(text)
            else:
                messages.append([role, [text]])
        void = newest
        for role, parts in messages:
            yield role, "".join(parts)


def format_conversations(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Turns in order, rendered: `conv_id, turn_no, role, formatted, start, loss_start, loss_end`.

    `events` has `conv_id, turn, seq, kind, role, text`.  A `message` adds a message at its turn, a `delta` goes on with
    the last message there, an `edit` gives it another text, a `regenerate` starts its turn anew and takes back all that
    came earlier in the log at this and later turns.  A delta or edit without a message is one; so is any other kind.

    The formatted text of a conversation is that of its turns in order; `start` is where a turn begins in it and
    `loss_start` to `loss_end` where the text under the loss mask is within the turn, all in code points (equal for
    roles that aren't trained).  A null text or role is empty, a null turn or sequence number comes first, rows without
    conversation are one conversation; events that tie in turn and sequence go by kind, role and text.  Repeated rows
    are events of their own.  Other columns are not looked at.  A conversation streams through one task in sorted order,
    which holds one message at a time.
    """
    source = events.select("conv_id", "turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = source.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, turn_no long, role string, formatted string, start long, loss_start long, loss_end long"
    out_type = pa.schema([("turn_no", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("start", pa.int64()),
                          ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "seq", "kind", "role", "text")])

        ids, out, volume = [], [], 0
        for conv_id, events in groupby(rows(), key=lambda r: r[0]):
            start = 0
            for turn_no, (role, text) in enumerate(_fold(e[1:] for e in events)):
                formatted, a, b = rendered(role, text)
                ids.append(conv_id)
                out.append({"turn_no": turn_no, "role": role, "formatted": formatted, "start": start,
                            "loss_start": a, "loss_end": b if role == trained_role else a})
                start += len(formatted)
                volume += len(formatted)
                if volume > 1 << 23 or len(out) >= 10_000:
                    yield _batch(ids, out)
                    ids, out, volume = [], [], 0
        if out:
            yield _batch(ids, out)

    def _batch(ids: list, out: list[dict]) -> pa.RecordBatch:
        found = pa.RecordBatch.from_pylist(out, out_type)
        return pa.RecordBatch.from_arrays([pa.array(ids), *found.columns], ["conv_id", *found.schema.names])

    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return ordered.mapInArrow(run, schema)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted turns, by conversation, one turn at a time:
    `conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")])

        out = []
        for conv_id, turns in groupby(rows(), key=lambda r: r[0]):
            n = loss_chars = chars = 0
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, text, a, b in turns:
                chars += len(text)
                for role, said in read_turns(text):
                    n += 1
                    all_turns.update(f"{role}\n{said}\n".encode())
                masked = unescaped(text[a:b])
                loss_chars += len(masked)
                loss.update(masked.encode())
            out.append((conv_id, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    picked = formatted.select("conv_id", "turn_no", "formatted", "loss_start", "loss_end")
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(run, schema)
