"""Texts as arrays of code points: classes of characters, hashes of words, and keys of any substring in constant time.

Where a hash stands for its text, it is multilinear (``hashes_of``) or XXH3 of 128 bits; where it only proposes candidates,
it is a polynomial from prefix sums (``Rolling``), which is cheap for many overlapping substrings.
"""

from __future__ import annotations

import sys

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, END = range(5)

#: Stands between two texts of a chunk; no text holds it.
STOP = 0x110000
#: Unicode has no letter, digit or space beyond plane 3.
_KNOWN = 0x40000

_state: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of every code point."""
    if "kind" not in _state:
        kind = np.zeros(STOP + 1, np.uint8)
        low = np.arange(STOP + 1, dtype=np.uint32)
        points = [k for k in range(_KNOWN) if not 0xD800 <= k < 0xE000]
        text, at = "".join(map(chr, points)), np.array(points)
        for c, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                kind[at[m.start() : m.end()]] = c
        kind[STOP] = END
        for k in points:
            c = chr(k).lower()
            if len(c) == 1:
                low[k] = ord(c)
        _state["kind"], _state["low"] = kind, low
    return _state["kind"], _state["low"]


def kinds(points: np.ndarray) -> np.ndarray:
    return _tables()[0][points]


def lowered(points: np.ndarray) -> np.ndarray:
    return _tables()[1][points]


def join(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ``texts``, each followed by STOP, and where each text begins; null is empty."""
    joined = "\0".join([t or "" for t in texts]) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    points[ends - 1] = STOP
    return points, ends - lengths


_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    have = _state.get(("pow", which))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _state[("pow", which)] = have = (out[0], out[1])
    return have


class Rolling:
    """Keys of any substrings of an array of code points, overlapping ones too.

    They only bring candidates together that are verified: texts can be made that differ and share a key.
    """

    def __init__(self, points: np.ndarray, which: int = 0):
        n = len(points)
        power, self.inverse = _powers(n + 1, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def _multipliers(n: int) -> np.ndarray:
    """n independent random odd numbers, always the same."""
    have = _state.get("random")
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = _state["random"] = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 63, size, np.uint64) << np.uint64(1) | np.uint64(1)
    return have


def hashes_of(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Multilinear hashes of the parts [start, end) of an array; parts are in order and don't overlap, and none is empty.

    Each place of a part has a random multiplier of its own, so no structure of two texts makes them collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    which = gather(starts, length)
    begin = np.cumsum(length) - length
    place = which - np.repeat(starts, length)
    value = (points[which].astype(np.uint64) + np.uint64(1)) * _multipliers(int(length.max()))[place]
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the argument matters to every bit of the result."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after another."""
    total = int(lengths.sum())
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(starts) else starts
    return np.repeat(shift, lengths) + np.arange(total)


def words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of letters and digits in lower case. Of each: the number of its text, start, end, hash."""
    points, begins = join(texts)
    points = lowered(points)
    kind = kinds(points)
    starts, ends = runs((kind == LETTER) | (kind == NUMBER))
    row = np.searchsorted(begins, starts, "right") - 1
    return row, starts - begins[row], ends - begins[row], hashes_of(points, starts, ends)


assert sys.byteorder == "little"
