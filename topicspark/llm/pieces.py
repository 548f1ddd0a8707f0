"""Whole texts through a tokenizer by their distinct pieces.

Every tokenizer used here first cuts a text where a space is followed by a
character that isn't white space, and never joins across such a cut.  So each
distinct piece is encoded once and a text's ids are its pieces' ids in order.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

_SPACE_RUN = re.compile(r" (?:\s|$)")
_CUT = re.compile(r"(?= \S)")


def cut(text: str) -> tuple[str, list[str]]:
    """(head, parts): the text is head, then a space and a part each; a part starts with a non-space."""
    if _SPACE_RUN.search(text):
        head, *pieces = _CUT.split(text)
        return head, [p[1:] for p in pieces]
    head, *parts = text.split(" ")
    return head, parts


MARKS = frozenset(",.;:!?")


class PieceTable:
    """Ids (little-endian unsigned 32-bit) of pieces, encoded when first seen.

    At ``limit`` pieces the table stays as it is (it then holds the frequent
    ones), and others are encoded again when another call brings them.
    A mark after letters is a piece of its own, as no tokenizer here joins them.
    Texts that hold one of ``controls`` aren't cut.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 500_000, controls: Iterable[str] = ()):
        self.encode, self.limit, self.parts = encode, limit, {}
        found = "|".join(map(re.escape, sorted(controls, key=len, reverse=True)))
        self.control = re.compile(found) if found else None
        self.marks = dict(zip(MARKS, encode(list(MARKS))))

    def cut(self, text: str) -> tuple[str, list[str]]:
        return (text, []) if self.control and self.control.search(text) else cut(text)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        parts, marks, heads, new = self.parts, self.marks, set(), set()
        for t in texts:
            head, rest = self.cut(t)
            heads.add(head)
            new.update(p for p in set(rest) if p not in parts)
        marked = [p for p in new if p[-1] in marks and p[:-1].isalpha()]
        plain = new.difference(marked)
        plain.update(p[:-1] for p in marked if p[:-1] not in parts)
        pieces, starts = list(plain), list(heads)
        parts.update(zip(pieces, self.encode([" " + p for p in pieces])))
        for p in marked:
            parts[p] = parts[p[:-1]] + marks[p[-1]]
        known_heads = dict(zip(starts, self.encode(starts)))
        get = parts.__getitem__
        for t in texts:
            head, rest = self.cut(t)
            yield known_heads[head] + b"".join(map(get, rest))
        if len(parts) > self.limit:
            for p in plain.union(marked):
                del parts[p]


_LIBRARY: dict[tuple[str, int], PieceTable] = {}
BETWEEN = "|"


def library_encoder(path: str) -> tuple[Callable[[list[str]], Iterator[bytes]], list[str]]:
    """(encoder of pieces by a ``tokenizers`` file, its control strings, which get their own ids).

    Pieces that start with a space are joined by `` |`` to a few long texts
    and their ids parted at that mark's id, as a call for each takes longer.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    mark = t.encode(" " + BETWEEN, add_special_tokens=False).ids

    def each(pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(pieces, add_special_tokens=False)]

    def joined(pieces: list[str], step: int = 200) -> list[bytes]:
        groups = [pieces[k:k + step] for k in range(0, len(pieces), step)]
        out = []
        for group, e in zip(groups, t.encode_batch_fast([(" " + BETWEEN).join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            edges = [-1, *np.flatnonzero(ids == mark[0]).tolist(), len(ids)]
            raw = ids.tobytes()
            if len(edges) == len(group) + 1:
                out += [raw[4 * a + 4:4 * b] for a, b in zip(edges[:-1], edges[1:])]
            else:
                out += each(group)
        return out

    def encode(pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), 20_000):
            some = pieces[at:at + 20_000]
            if len(mark) != 1:
                yield from each(some)
                continue
            alone = [p for p in some if p[:1] != " " or BETWEEN in p or p[1:2].isspace()]
            done = dict(zip(alone, each(alone)))
            rest = [p for p in some if p not in done]
            done.update(zip(rest, joined(rest)))
            for p in some:
                yield done[p]

    return encode, [a.content for a in t.get_added_tokens_decoder().values()]


def library_table(path: str, limit: int = 500_000) -> PieceTable:
    """One table a worker for each tokenizer file and limit."""
    if (path, limit) not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, controls = library_encoder(path)
        _LIBRARY[path, limit] = PieceTable(encode, limit, controls)
    return _LIBRARY[path, limit]
