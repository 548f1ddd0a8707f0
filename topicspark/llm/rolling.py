"""Words and their rolling (Rabin-Karp) hashes for a slice of texts, in numpy.

Hashes are polynomials modulo 2**64 in an odd base; a window's hash is the
difference of two prefix sums, scaled back by the inverse power.  Word hashes
are mixed afterwards, so windows add up well-spread values.

Long strings of two letters can be built that such polynomials never tell
apart, whatever the base (from 1,024 letters on), so words of ``LONG`` bytes
and more get a keyed cryptographic digest instead; windows are shorter than that.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
BLOCK = 1 << 20
LONG = 64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i, i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        have = both[0], both[1]
        if size <= 4 * BLOCK:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: byte ranges in one buffer, and each text's range of words."""

    def __init__(self, texts: list[str], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            raw = [r.lower() for r in raw]
        self.raw = b"\n".join([*raw, b""])
        buf = np.frombuffer(self.raw, np.uint8)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edges = np.concatenate([[0], edges])
        self.buf, self.starts, self.ends = buf, edges[0::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """A 64-bit hash of every word, block by block."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.starts, begin + BLOCK)))
            segment = self.buf[begin:self.ends[to - 1]].astype(np.uint64) + np.uint64(1)
            power, inverse = _powers(base, len(segment) + 1)
            sums = np.zeros(len(segment) + 1, np.uint64)
            np.cumsum(segment * power[:len(segment)], out=sums[1:])
            a, b = self.starts[at:to] - begin, self.ends[at:to] - begin
            out[at:to] = (sums[b] - sums[a]) * inverse[a]
            at = to
        out = mix(out)
        key = base.to_bytes(8, "little")
        for i in np.flatnonzero(self.ends - self.starts >= LONG).tolist():
            out[i] = int.from_bytes(blake2b(self.raw[self.starts[i]:self.ends[i]], digest_size=8, key=key).digest(), "little")
        return out

    def owners(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def inside(self, size: int) -> np.ndarray:
        """For each of the len - size + 1 windows of ``size`` words: does it lie in one text?"""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, bool)
        return np.repeat(self.bounds[1:], self.counts)[:n] - np.arange(n) >= size


def rolling(values: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of every ``size`` consecutive values."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=sums[1:])
    return (sums[size:] - sums[:-size]) * inverse[:n - size + 1]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    have, out = 1, values
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = size - have
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def extremes(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, least id, greatest id of each)."""
    if not len(keys):
        return keys, ids, ids
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
