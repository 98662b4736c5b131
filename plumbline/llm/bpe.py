"""Byte-level BPE encoding by a dynamic program over prefixes, and decoding.

The last token of a prefix's encoding is unique: it is the longest vocabulary entry ending there that is
compatible with the last token of what stands before it. So one pass over a piece stores a token for every
prefix: a suffix automaton of the vocabulary yields the entries that end at each byte, longest first; a pair test
undoes merges on both sides to see whether merging would have crossed the border; and the ids follow the
back-pointers from the end. The result equals that of merging by rank.

All different pieces of a chunk go along together, a byte a step, in array operations. The automaton and the merges are
made once, on the driver, and broadcast as arrays, whose size the vocabulary sets.

Cases: null text gives null ``token_ids``, 0 tokens and ``round_trip`` true; empty text gives an empty array;
there is no limit on the length of a text or a piece; strings of special tokens are ordinary text; repeated
rows are encoded each; a row with a null ``doc_id`` keeps it; further columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import textnum as tn
from plumbline.llm.common import chunked, column, small, table, tokenizers

#: The rank file, in the folder that the setting spark.plumbline.tokenizers names; only the driver reads it.
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Characters whose pieces go along together, and pair tests that a worker remembers, by place of their hash.
CHUNK, REMEMBERED = 1 << 20, 1 << 18

#: Pieces that go along together at least; the last ones, which are the longest, go on one by one.
TOGETHER = 24

SCHEMA = "doc_id bigint, n_tokens bigint, token_ids array<int>, n_bytes bigint, round_trip boolean"


def load_tokens(path: str) -> list[bytes]:
    """The vocabulary in the order of its ranks, which are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    return [ranks[k] for k in range(len(ranks))]


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Numbers by keys of 64 bits, in a table with open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            _, first = np.unique(slot[todo], return_index=True)
            placed = todo[first[self.keys[slot[todo[first]]] == -1]]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: int) -> int:
        """One value, or -1."""
        slot = ((key * int(_SPREAD)) & ((1 << 64) - 1)) >> (64 - self.bits)
        while (there := int(self.keys[slot])) != key:
            if there == -1:
                return -1
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(self.values[slot])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero((there != keys) & (there != -1))
        out[there != keys] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out


def suffix_automaton(tokens: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """Of all substrings of the tokens: transitions, suffix links and greatest lengths by state, and the state of each token."""
    follow: list[dict[int, int]] = [{}]
    link, length, state_of = [-1], [0], []

    def split(p: int, q: int, b: int) -> int:
        """The state of the strings of q that are at most one longer than p's."""
        new = len(follow)
        follow.append(follow[q].copy()), link.append(link[q]), length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and follow[p].get(b) == q:
            follow[p][b] = new
            p = link[p]
        return new

    for t in tokens:
        last = 0
        for b in t:
            q = follow[last].get(b)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, q, b)
                continue
            new, p = len(follow), last
            follow.append({}), link.append(0), length.append(length[last] + 1)
            while p >= 0 and b not in follow[p]:
                follow[p][b] = new
                p = link[p]
            if p >= 0:
                q = follow[p][b]
                link[new] = q if length[q] == length[p] + 1 else split(p, q, b)
            last = new
    for t in tokens:  # splits have moved the shorter strings of some states
        s = 0
        for b in t:
            s = follow[s][b]
        state_of.append(s)
    return follow, link, length, state_of


def _merges(tokens: list[bytes]) -> tuple[dict[int, int], list[int], list[int]]:
    """For each entry the pair whose merge makes it; a single byte is its own pair."""
    rank = {t: k for k, t in enumerate(tokens)}
    pair: dict[int, int] = {}
    left, right = list(range(len(tokens))), list(range(len(tokens)))
    for k, t in enumerate(tokens):
        for i in range(len(t) - 1, 0, -1):
            a, b = rank.get(t[:i], k), rank.get(t[i:], k)
            if a < k and b < k and _fits(a, b, pair, left, right):
                pair[a << 20 | b] = k
                left[k], right[k] = a, b
                break
    return pair, left, right


def _fits(a: int, b: int, pair: dict[int, int], left: list[int], right: list[int]) -> bool:
    """Whether merging leaves the border between two adjacent tokens alone."""
    most = 1 << 40
    while True:
        made = pair.get(a << 20 | b)
        if made is not None and made < most:
            return False
        if a > b:
            most = a
            a = right[a]
            if a == most:
                most = b + 1
                b = left[b]
                if b + 1 == most:
                    return True
        else:
            most = b + 1
            b = left[b]
            if b + 1 == most:
                most = a
                a = right[a]
                if a == most:
                    return True


def made_tables(tokens: list[bytes]) -> dict:
    """The automaton, the merges and the tokens' bytes as arrays."""
    follow, link, length, state_of = suffix_automaton(tokens)
    edges = np.array([(s << 8 | b, n) for s, x in enumerate(follow) for b, n in x.items()], np.int64)
    size = np.array([len(t) for t in tokens], np.int32)
    # of each state the longest token that is a suffix of all its strings that are long enough, and of each token the next one
    link_, best, shorter = np.array(link), np.full(len(link), -1, np.int32), np.full(len(tokens), -1, np.int32)
    own: dict[int, list[int]] = {}
    for k, s in enumerate(state_of):
        own.setdefault(s, []).append(k)
    for s in np.argsort(length, kind="stable").tolist():
        best[s] = best[link_[s]] if s else -1
        for k in sorted(own.get(s, ()), key=lambda k: len(tokens[k])):
            shorter[k], best[s] = best[s], k
    pair, left, right = _merges(tokens)
    return {
        "edges": Lookup(edges[:, 0], edges[:, 1].astype(np.int32)), "link": link_.astype(np.int32), "length": np.array(length, np.int32), "best": best, "shorter": shorter, "size": size,
        "pair": Lookup(np.fromiter(pair, np.int64, len(pair)), np.fromiter(pair.values(), np.int32, len(pair))), "left": np.array(left, np.int32), "right": np.array(right, np.int32),
        "flat": np.frombuffer(b"".join(tokens), np.uint8),
    }


@lru_cache(maxsize=2)
def tables(path: str) -> dict:
    return made_tables(load_tokens(path))


class Encoder:
    """The pair test and the dynamic program over the tables of one vocabulary."""

    def __init__(self, made: dict):
        for name, x in made.items():
            setattr(self, name, x)
        self.lengths = self.size.astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.asked, self.answers = np.full(REMEMBERED, -1, np.int64), np.zeros(REMEMBERED, bool)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each two adjacent tokens, whether merging leaves the border between them alone."""
        keys = a.astype(np.int64) << 20 | b
        slot = ((keys.view(np.uint64) * _SPREAD) >> np.uint64(46)).astype(np.int64) & (REMEMBERED - 1)
        out = self.answers[slot]
        new = np.flatnonzero(self.asked[slot] != keys)
        if len(new):
            distinct, which = np.unique(keys[new], return_inverse=True)
            out[new] = self._fits(distinct >> 20, distinct & 0xFFFFF)[which]
            self.asked[slot[new]] = keys[new]
            self.answers[slot[new]] = out[new]
            # of two that share a place one is remembered, with its own answer
            lost = self.asked[slot[new]] != keys[new]
            if lost.any():
                kept = new[~lost]
                self.answers[slot[kept]] = out[kept]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(a), bool), np.arange(len(a))
        most = np.full(len(a), 1 << 40)
        while len(todo):
            made = self.pair(a << 20 | b)
            on = (made < 0) | (made >= most)
            a, b, todo = a[on], b[on], todo[on]
            ra, lb = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            # undo the later merge of the two, or the other's where that one is a single byte
            first = np.where(a > b, ra != a, lb == b)
            done = (ra == a) & (lb == b)
            out[todo[done]] = True
            most = np.where(first, a, b + 1)
            a, b = np.where(first, ra, a), np.where(first, b, lb)
            a, b, todo, most = a[~done], b[~done], todo[~done], most[~done]
        return out

    def encode_pieces(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of bytes, one after another, and the number of each's."""
        order = np.argsort(length, kind="stable")
        begin, length = begin[order], length[order]
        last = np.full(len(flat), -1, np.int32)
        state, match = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int32)
        for j in range(1, int(length[-1]) + 1 if len(length) else 0):
            k = int(np.searchsorted(length, j))
            if len(length) - k < TOGETHER and j > 16:
                for x in range(k, len(length)):
                    self._alone(flat, int(begin[x]), j, int(length[x]), int(state[x]), int(match[x]), last)
                break
            at = begin[k:] + (j - 1)
            s, m, byte = state[k:], match[k:], flat[at].astype(np.int64)
            # the longest suffix that the automaton knows
            new = self.edges(s << 8 | byte)
            todo = np.flatnonzero((new < 0) & (s > 0))
            while len(todo):
                s[todo] = self.link[s[todo]]
                m[todo] = self.length[s[todo]]
                new[todo] = self.edges(s[todo] << 8 | byte[todo])
                todo = todo[(new[todo] < 0) & (s[todo] > 0)]
            m[:] = np.where(new < 0, 0, m + 1)
            s[:] = np.maximum(new, 0)
            token = self.best[s]
            long = np.flatnonzero(self.size[token] > m)
            while len(long):
                token[long] = self.shorter[token[long]]
                long = long[(token[long] >= 0) & (self.size[token[long]] > m[long])]
            # the longest of its tokens that is compatible with what stands before
            todo = np.arange(len(token))
            while len(todo):
                t = token[todo]
                if (t < 0).any():
                    raise ValueError(f"no token for byte {byte[todo[t < 0]][0]}")
                inner = self.size[t] < j
                todo, t = todo[inner], t[inner]
                good = self.fits(last[at[todo] - self.size[t]], t)
                todo = todo[~good]
                token[todo] = self.shorter[token[todo]]
            last[at] = token
        # back-pointers from the ends
        taken, end, todo = np.zeros(len(flat), bool), begin + length, np.arange(len(begin))
        while len(todo):
            at = end[todo] - 1
            taken[at] = True
            end[todo] = end[todo] - self.size[last[at]]
            todo = todo[end[todo] > begin[todo]]
        upto = np.concatenate(([0], np.cumsum(taken)))
        counts = np.empty(len(begin), np.int64)
        counts[order] = upto[begin + length] - upto[begin]
        return last[taken], counts

    def _alone(self, flat: np.ndarray, begin: int, j: int, length: int, s: int, m: int, last: np.ndarray) -> None:
        """One piece from its byte j on, by the same steps."""
        size, known = self.size, {}
        stored = last[begin : begin + length].tolist()
        for j, byte in enumerate(flat[begin + j - 1 : begin + length].tolist(), j):
            new = self.edges.get(s << 8 | byte)
            while new < 0 and s:
                s = int(self.link[s])
                m = int(self.length[s])
                new = self.edges.get(s << 8 | byte)
            s, m = (new, m + 1) if new >= 0 else (0, 0)
            t = int(self.best[s])
            while t >= 0:
                n = int(size[t])
                if n <= m:
                    if n == j:
                        break
                    key = (stored[j - n - 1], t)
                    if key not in known:
                        known[key] = bool(self._fits(*(np.array([x], np.int64) for x in key))[0])
                    if known[key]:
                        break
                t = int(self.shorter[t])
            if t < 0:
                raise ValueError(f"no token for byte {byte}")
            stored[j - 1] = t
        last[begin : begin + length] = stored

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        points, begins = tn.join(texts)
        starts, ends = pieces(points)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        length = ends - starts
        _, first, which = np.unique(tn.hashes_of(points, starts, ends), return_index=True, return_inverse=True)
        own = starts[first]
        if (length[first][which] != length).any() or (points[tn.gather(own[which], length)] != points[tn.gather(starts, length)]).any():
            own, first, which = starts, np.arange(len(starts)), np.arange(len(starts))  # different pieces of one hash: each for itself
        # the bytes of the different pieces
        n = length[first]
        chosen = points[tn.gather(own, n)]
        flat = np.frombuffer(chosen.tobytes().decode("utf-32-le").encode(), np.uint8)
        width = np.concatenate(([0], np.cumsum(1 + (chosen > 0x7F).astype(np.int64) + (chosen > 0x7FF) + (chosen > 0xFFFF))))
        upto = np.concatenate(([0], np.cumsum(n)))
        edge = width[upto]
        pool, counts = self.encode_pieces(flat, edge[:-1], np.diff(edge))
        each = counts[which]
        out = pool[tn.gather((np.cumsum(counts) - counts)[which], each)]
        upto = np.concatenate(([0], np.cumsum(each)))
        edges = upto[np.searchsorted(starts, np.append(begins, len(points)))]
        return out, np.diff(edges)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[tn.gather(self.begins[ids], self.lengths[ids])]


def pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces begin and end within which merges happen: contractions, runs of letters, of numbers or
    of other signs, each with a space before it, and white space. Texts end with STOP, which is in no piece."""
    kind, n = tn.kinds(points), len(points)
    start = np.ones(n + 3, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[:n] |= kind == tn.END
    visible = kind < tn.SPACE
    last = np.flatnonzero((kind[:-1] == tn.SPACE) & visible[1:])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & start[:n])
    if len(quote):
        padded = np.concatenate((points, [tn.STOP, tn.STOP]))
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, size in ((one, 2), (two & ~one, 3)):
            q = quote[which]
            start[q + 1] = False
            start[q + size] = True
    at = np.flatnonzero(start[:n])
    end = np.append(at[1:], n)
    keep = kind[at] != tn.END
    return at[keep], end[keep]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of ``docs``: its token ids, and whether decoding them gives its text back. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tables(os.path.join(tokenizers(docs.sparkSession), vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for batch in small(batches):
            texts, ids = column(batch, "text"), batch.column(0)
            for a, b in chunked(texts, CHUNK):
                part = texts[a:b]
                tokens, counts = e.encode_texts(part)
                back = e.decode_bytes(tokens).tobytes()
                raw = [t.encode() if t else b"" for t in part]
                exact = [True] * len(part) if back == b"".join(raw) else _each(e, tokens, counts, raw)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                null = np.array([t is None for t in part])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens), mask=pa.array(null)),
                        pa.array([len(r) for r in raw], pa.int64()),
                        pa.array(exact),
                    ],
                    ["doc_id", "n_tokens", "token_ids", "n_bytes", "round_trip"],
                )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def _each(e: Encoder, tokens: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> list[bool]:
    edges = np.concatenate(([0], np.cumsum(counts)))
    return [e.decode_bytes(tokens[a:b]).tobytes() == r for a, b, r in zip(edges[:-1], edges[1:], raw)]


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give null text, and ids that are not a text's give U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(tables(os.path.join(tokenizers(encoded.sparkSession), vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for batch in small(batches):
            texts = [None if x is None else e.decode_bytes(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in column(batch, "token_ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) as doc_id", "token_ids").mapInArrow(run, "doc_id bigint, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
