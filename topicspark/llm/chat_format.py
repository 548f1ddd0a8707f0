"""Chat formatting with a grammar round trip (operator 1).

A turn is rendered as ``<|im_start|>role NL text <|im_end|> NL``.  A
deterministic parser reads the rendered turn back; where that doesn't give
the source, conflicting content is escaped until it does.  Escaping puts one
more backslash into every ``<`` backslashes ``|`` of the text, and the parser
takes one out; a line end in a role becomes ``<|nl|>``.

Defined cases: null roles and texts are empty; turns of one conversation are
ordered by turn (null first), then role and text, and repeated rows are turns
of their own; rows without a conv_id form one conversation; an empty table
gives an empty result; other columns are ignored.  A conversation's digests
need its turns in order, so a sorted stream of turns is hashed as it passes;
no conversation is held in memory.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|im_(?:start|end)\|>)[^\n])*)\n((?:(?!<\|im_(?:start|end)\|>).)*)<\|im_end\|>\n", re.S)
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text, or None if it isn't a sequence of turns."""
    at, turns = 0, []
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if m is None:
            return None
        turns.append((unescape(m[1].replace(NEWLINE, "\n")), unescape(m[2])))
        at = m.end()
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """(rendered turn, where its text begins): parsed again it gives exactly this turn."""
    head, body = role, text
    for attempt in range(3):
        header = head.replace("\n", NEWLINE)
        out = f"{START}{header}\n{body}{END}\n"
        back = parse(out)
        if back == [(role, text)]:
            return out, len(START) + len(header) + 1
        if attempt == 0:  # what conflicts: the text, the role, or both
            body = escape(text) if parse(f"{START}\n{text}{END}\n") != [("", text)] else text
            head = escape(role) if parse(f"{START}{role.replace(chr(10), NEWLINE)}\n{END}\n") != [(role, "")] else role
        else:
            head, body = escape(role), escape(text)
    raise ValueError("a turn that can't be rendered reversibly")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered, text_at, text_end): each turn as rendered, and its text's span in it."""
    def run(batches):
        for b in batches:
            roles, bodies = b.column("role").to_pylist(), b.column("text").to_pylist()
            done = [render(r, t) for r, t in zip(roles, bodies)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([len(d[0]) - len(END) - 1 for d in done], pa.int64())], [*b.schema.names, "rendered", "text_at", "text_end"])
    clean = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, rendered string, text_at bigint, text_end bigint")


def read_back(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """Digests of each conversation, from its rendered turns alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars);
    the loss mask covers the texts of role ``learn``.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, state = (), None

        def closed():
            return [now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for b in batches:
            out = []
            for conv, rendered in zip(b.column("conv_id").to_pylist(), b.column("rendered").to_pylist()):
                if now != (conv,):
                    if now:
                        out.append(closed())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == learn:
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c) for c in cols[1:])], names)
        if now:
            last = closed()
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), *(pa.array([x]) for x in last[1:])], names)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    one = formatted.select("conv_id", "turn", "role", "text", "rendered").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "rendered")
    return one.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_report(turns: DataFrame) -> DataFrame:
    return read_back(format_turns(turns))
