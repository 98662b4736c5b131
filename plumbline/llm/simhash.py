"""Near duplicates by SimHash signatures and one-wildcard variants of their segments.

A signature has 128 bits: each the sign of a sum over the document's distinct words, weighted with the fourth root of
their counts, to 20 binary places so that sums are exact. Signatures within 2 m - 1 bits, cut into m segments, agree in some segment but for one bit at most. So each
segment is indexed once for each of its bits, with that bit left out; equal variants join, and the full distance is
verified. The variants are made after the exchange, which moves a signature once for each third of a segment. Where more
signatures come together than ``ROUTE_ROWS``, they are cut into blocks, and each two blocks meet in a task of their own. Those
that come together are sorted by the part that may differ, and its values that differ in a bit at most are compared in tiles, by
the 64 bits outside the segment first. The search is exact: every pair within ``distance`` bits is found, once. Documents of equal
signature take part once, by their least ``doc_id``; the pairs' connected components are the groups, whose least ``doc_id`` stays.
A task passes on a spanning forest of its pairs, which has the same components, and no more pairs than signatures.

Cases: a null or empty text, or one without a letter or digit, has no signature and is in no group; a null ``doc_id``
can't be reported, so such rows are left out (and kept by ``deduplicated``); texts of any length count whole; ties in a
bit's sum give 1; rows that share a ``doc_id`` are one document, in the groups of all its texts; an empty table gives
no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textnum as tn
from plumbline.llm.common import DOCUMENT_COLUMNS, chunked, column, cut, small, table
from plumbline.llm.components import components

BITS, DISTANCE = 128, 17

#: The weight of a word that occurs once. Weights are whole numbers, whose sums are exact in any order.
WEIGHT = 1 << 20

#: Parts of a segment by which signatures are brought together, rows that are matched at once, and pairs that are held at once.
PARTS, MEETING, PAIRS = 3, 50_000, 500_000

#: Rows and columns of a tile, rows of a group of equal values that more bits aren't worth while for, and the most bits that tell groups apart.
TILE, GROUP, GROUP_BITS = (64, 1024), 128, 8

#: Rows of a block of those that come together.
ROUTE_ROWS = 50_000


def signatures_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the texts that have words, and two 64-bit halves for each."""
    rows, halves = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for a, b in chunked(texts):
        row, _, _, hashes = tn.words(texts[a:b])
        if not len(row):
            continue
        key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        row = (key >> np.uint64(40)).astype(np.int64)
        word = key & np.uint64((1 << 40) - 1)
        weight = np.rint(np.sqrt(np.sqrt(count)) * WEIGHT)
        bits = np.unpackbits(np.column_stack((tn.mix(word, 1), tn.mix(word, 2))).view(np.uint8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        total = np.add.reduceat(weight, begin)
        sums = np.empty((len(begin), BITS))
        # a sum for each text, as reduceat goes down the columns, which takes several times as long
        for k, (x, y) in enumerate(zip(begin.tolist(), begin[1:].tolist() + [len(row)])):
            np.add.reduce(bits[x:y] * weight[x:y, None], axis=0, out=sums[k])
        sign = np.packbits(sums * 2 >= total[:, None], axis=1, bitorder="little").view(np.int64)
        rows.append(row[begin] + a)
        halves.append(sign)
    return np.concatenate(rows), np.concatenate(halves)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of the documents that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows, halves = signatures_of(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "hi", "lo"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")
    return slim.mapInArrow(run, "doc_id bigint, hi bigint, lo bigint")


def _layout(distance: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """The parts of the segments as (segment, begin, end) in bits, and the segments' edges."""
    n = distance // 2 + 1
    edges = [round(k * BITS / n) for k in range(n + 1)]
    parts = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        inner = [a + round(j * (b - a) / PARTS) for j in range(PARTS + 1)]
        parts += [(k, x, y) for x, y in zip(inner[:-1], inner[1:]) if x < y]
    return parts, edges


def _halves(mask: int) -> tuple[int, int]:
    """A mask of BITS bits as the low and the high 64, in the order of the columns hi and lo of a signature."""
    return mask & ((1 << 64) - 1), mask >> 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_signatures(distinct: DataFrame, distance: int = DISTANCE, spanning: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of ``distinct`` (id, hi, lo) within ``distance`` bits, each once; if ``spanning``, a spanning
    forest of those of each task, whose pairs needn't be near themselves.

    A variant whose wildcard is in one part of a segment has the other parts unchanged, so signatures are brought together
    by these: a row for each part, not for each bit. Where they meet, they are matched and verified.
    """
    parts, edges = _layout(distance)
    fixed = [_halves(((1 << edges[k + 1]) - (1 << edges[k])) & ~((1 << b) - (1 << a))) for k, a, b in parts]
    hi, lo = (F.array(*(F.lit(_signed(m[j])) for m in fixed)) for j in (0, 1))
    routed = distinct.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))))
    route = F.hash("part", F.col("hi").bitwiseAND(F.get(hi, "part")), F.col("lo").bitwiseAND(F.get(lo, "part")))
    met = routed.select(route.alias("route"), F.col("part").cast("byte").alias("part"), "id", "hi", "lo", F.lit(0).alias("own"), F.lit(False).alias("cross"), F.lit(0).alias("block"))
    large = cut(met.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / ROUTE_ROWS).cast("int").alias("k")).where("k > 1"))
    if large.limit(1).count():
        # a row meets those of its own block, and of each other one
        cuts = met.join(large, "route", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("id"), "k").cast("int"), F.lit(0)))
        other = cuts.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)))
        block = F.least("own", "other") * F.coalesce("k", F.lit(1)) + F.greatest("own", "other")
        met = other.withColumn("cross", F.col("own") != F.col("other")).withColumn("block", block).select(*met.columns)
    met = met.repartition("route", "block").sortWithinPartitions("route", "block")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)])
            if sum(len(x[0]) for x in held) >= MEETING:
                rows = [np.concatenate(x) for x in zip(*held)]
                last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[7] != rows[7][-1]))[-1:].sum() + 1) if (rows[0][0], rows[7][0]) != (rows[0][-1], rows[7][-1]) else 0
                held = [[x[last:] for x in rows]]
                yield from _near([x[:last] for x in rows], parts, edges, distance)
        if held:
            yield from _near([np.concatenate(x) for x in zip(*held)], parts, edges, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _forests(pairs(batches)) if spanning else pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def _near(rows: list[np.ndarray], parts: list[tuple[int, int, int]], edges: list[int], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs among rows of whole blocks, each from the first segment that it agrees in but for one bit."""
    segment_of, begin, end = (np.array(x) for x in zip(*parts))
    segments = np.array([_halves((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:])], np.uint64)
    free = np.array([_halves((1 << b) - (1 << a)) for _, a, b in parts], np.uint64)
    part, hi, lo, block = rows[1].astype(np.int64), rows[3].view(np.uint64), rows[4].view(np.uint64), rows[7].astype(np.uint64)
    fixed = segments[segment_of[part]] & ~free[part]
    key = tn.mix(hi & fixed[:, 0]) ^ tn.mix(lo & fixed[:, 1], 1) ^ tn.mix(part.astype(np.uint64), 2) ^ tn.mix(block, 3)
    # the low bits tell the value of the part that may differ, or its highest bits
    a, b = begin[part], end[part]
    low = np.maximum(a, b - GROUP_BITS)
    value = np.where(low < 64, hi >> np.minimum(low, 63).astype(np.uint64), lo >> (np.maximum(low, 64) - 64).astype(np.uint64))
    value |= np.where((low < 64) & (b > 64), lo << np.clip(64 - low, 0, 63).astype(np.uint64), np.uint64(0))
    width = b - low
    value = (value & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))) << (GROUP_BITS - width).astype(np.uint64)
    key = (key & ~np.uint64((1 << GROUP_BITS) - 1)) | value
    order = np.argsort(key, kind="stable")
    key, part, hi, lo, block = key[order], part[order], hi[order], lo[order], block[order]
    ident, own_block, cross, width = rows[2][order], rows[5][order], rows[6][order], width[order]
    bucket = key >> np.uint64(GROUP_BITS)
    value = (key & np.uint64((1 << GROUP_BITS) - 1)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(key))
    some = np.flatnonzero(np.diff(edge) > 1)
    tiles = _Tiles(distance)

    def verified(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        due = ((own_block[x] != own_block[y]) == cross[x]) & (part[x] == part[y]) & (block[x] == block[y]) & (cross[x] == cross[y]) & (ident[x] != ident[y])
        x, y = x[due], y[due]
        dh, dl = hi[x] ^ hi[y], lo[x] ^ lo[y]
        errors = np.bitwise_count(dh[:, None] & segments[:, 0]).astype(np.int64) + np.bitwise_count(dl[:, None] & segments[:, 1])
        p = part[x]
        k = segment_of[p]
        # the wildcard is the bit that differs, or in the segment's first part if none does
        differs = ((dh & free[p, 0]) | (dl & free[p, 1])) != 0
        own = errors[np.arange(len(x)), k]
        keep = ((errors <= 1).argmax(1) == k) & np.where(own == 0, begin[p] == np.array(edges)[k], (own == 1) & differs)
        u, v = ident[x[keep]], ident[y[keep]]
        return np.minimum(u, v), np.maximum(u, v)

    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for s, e in zip(edge[some].tolist(), edge[some + 1].tolist()):
        p = int(part[s])
        first, second = (lo, hi) if edges[segment_of[p]] + edges[segment_of[p] + 1] < BITS else (hi, lo)
        bits = min(int(width[s]), ((e - s) // GROUP).bit_length())
        if bits:
            at = (s + np.searchsorted(value[s:e], np.arange((1 << bits) + 1) << (GROUP_BITS - bits))).tolist()
            areas = [(at[v], at[v + 1], at[w], at[w + 1]) for v in range(1 << bits) for w in (v, *(v | 1 << j for j in range(bits) if not v >> j & 1))]
        else:
            areas = [(s, e, s, e)]
        for area in areas:
            for x, y in tiles(first, second, *area):
                found.append((x, y))
                held += len(x)
                if held >= PAIRS:
                    yield verified(*(np.concatenate(z) for z in zip(*found)))
                    found, held = [], 0
    if found:
        yield verified(*(np.concatenate(z) for z in zip(*found)))


class _Tiles:
    """Compares rows with rows, a tile at a time."""

    def __init__(self, distance: int):
        self.distance = distance
        size = TILE[0] * TILE[1]
        self.differ, self.count, self.near = np.empty(size, np.uint64), np.empty(size, np.uint8), np.empty(size, bool)

    def __call__(self, first: np.ndarray, second: np.ndarray, a: int, b: int, c: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a row of [a, b) and one of [c, d) within the distance, or where both are the same range, each two of it."""
        for r in range(a, b, TILE[0]):
            n = min(TILE[0], b - r)
            for q in range(r if a == c else c, d, TILE[1]):
                m = min(TILE[1], d - q)
                size = n * m
                differ, count = self.differ[:size].reshape(n, m), self.count[:size]
                np.bitwise_xor(first[r : r + n, None], first[q : q + m], out=differ)
                np.bitwise_count(self.differ[:size], out=count)
                np.less_equal(count, self.distance, out=self.near[:size])
                whole = -(-size // 8)
                self.near[size : 8 * whole] = False
                # eight at once, as few are near
                eight = np.flatnonzero(self.near[: 8 * whole].view(np.uint64))
                if not len(eight):
                    continue
                one, place = np.nonzero(self.near.reshape(-1, 8)[eight])
                at = eight[one] * 8 + place
                x, y = r + at // m, q + at % m
                good = count[at] + np.bitwise_count(second[x] ^ second[y]) <= self.distance
                if a == c:
                    good &= y > x
                if good.any():
                    yield x[good], y[good]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the pairs but the least of its component, with that least one before it."""
    ids, which = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = which[: len(a)], which[len(a) :]
    label = np.arange(len(ids))
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            break
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        # labels are those of themselves here, so the greater one's whole tree goes over to the lesser
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[rest]], ids[rest]


def _forests(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs with the same components, at most PAIRS held at once beside those that come."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in pairs:
        held.append(pair)
        if sum(len(a) for a, _ in held) >= PAIRS:
            a, b = _forest(*(np.concatenate(z) for z in zip(*held)))
            held = [(a, b)]
            if len(a) >= PAIRS // 2:
                yield a, b
                held = []
    if held:
        yield _forest(*(np.concatenate(z) for z in zip(*held)))


def groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, group_id, group_size, keep): every document of a group of two or more; group_id is the one that stays."""
    signed = cut(signatures(docs).distinct())
    distinct = cut(signed.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    linked = components(near_signatures(distinct.select("id", "hi", "lo"), distance, spanning=True))
    group = distinct.join(linked, "id", "left").select("hi", "lo", "n", F.coalesce("least", "id").alias("group_id"))
    sizes = group.groupBy("group_id").agg(F.sum("n").alias("group_size")).where("group_size > 1")
    known = group.join(sizes, "group_id").select("hi", "lo", "group_id", "group_size")
    return signed.join(known, ["hi", "lo"]).select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` but for the documents of each group that don't stay."""
    gone = groups(docs, distance).where("not keep").select("doc_id").distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
