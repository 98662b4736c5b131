"""Near-duplicate lines by a segment-partition join on edit distance.

A line within ``DISTANCE`` edits of another that is cut into DISTANCE + 1 segments holds one of the segments unchanged,
near its place. So each line is indexed under (its length, a segment's number, the segment), and probes, for each length
from its own down to DISTANCE less, the substrings that the multi-match-aware windows leave. Keys that meet make candidate
pairs, each once; a banded bit-parallel edit distance verifies them. Lines of equal text take part once.

A key that very many lines share is not paired out: what its lines have besides the common segment is cut into segments
and probed in turn, within the key, so that only lines meet that share two segments. Rows of the most frequent keys, which a
sample of documents tells, are spread over tasks on their way there; that changes no result. What is frequent after that
as well is met in blocks of bounded size, in the order of the lines, and a line that is known to go is not compared with later
ones again, so that a family of similar lines takes about one comparison a line.

Lines are the same if 128-bit XXH3 hashes of them are.

A line is removed if a line before it in the corpus, by ``doc_id`` and line number, is equal or within the distance,
whether or not that one is removed itself. Lines are compared without the white space at both ends. Every line that isn't
blank takes part in equality; lines of fewer than ``distance`` + 1 characters are within the distance of any other such
line, so that only their equality counts.

Cases: a null or empty text has no lines to compare and stays; rows of null ``doc_id`` are left out (and stay in
``without_duplicates``); rows that share a ``doc_id`` are one document: equal places aren't duplicates of each other,
and a line number removed is removed from all of them; lines and texts of any length count whole; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textnum as tn
from plumbline.llm.common import DOCUMENT_COLUMNS, chunked, column, cut, int64s, partitions, passes, sieve, small, table

DISTANCE = 2
#: The least characters of lines that edits are sought of: each segment has one then.
LEAST_CHARS = DISTANCE + 1

#: Lines that a task remembers to have sent before it starts afresh.
MOST_KNOWN = 200_000

#: Pairs that are verified or formed at once.
BLOCK = 20_000

#: Pairs that a key may make before its lines are probed further, and lines of a block of those that are still together.
MOST_PAIRS, BLOCK_LINES = 1 << 20, 2_000

#: One document of so many tells which keys are frequent: those with more than a 1 / SHARE of an even task's rows, and more
#: than LEAST_FREQUENT of the sample. So there are at most SHARE of them for each task.
SAMPLED, SHARE, LEAST_FREQUENT = 64, 8, 200


def lines_of(texts: list, least: int = 1) -> tuple[np.ndarray, ...]:
    """Of each line of ``least`` characters or more: number of its text, of the line, start and end without blanks, and two hashes;
    where texts begin, and their characters."""
    points, begins = tn.join(texts)
    kind = tn.kinds(points)
    upto = np.flatnonzero((points == 10) | (kind == tn.END)) + 1
    start = np.concatenate(([0], upto[:-1])) if len(upto) else upto
    solid = np.flatnonzero((kind != tn.SPACE) & (kind != tn.END))
    first, last = np.searchsorted(solid, start), np.searchsorted(solid, upto) - 1
    row = np.searchsorted(begins, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(row, row)
    full = np.flatnonzero(first <= last)
    start, end = solid[first[full]], solid[last[full]] + 1
    long = end - start >= least
    row, number, start, end = row[full][long], number[full][long], start[long], end[long]
    shift = begins[row]
    hashes = [xxhash.xxh3_128_digest(texts[r][a:b].encode("utf-8", "surrogatepass")) for r, a, b in zip(row.tolist(), (start - shift).tolist(), (end - shift).tolist())]
    return row, number, start, end, np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2), begins, points


def segments(length: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the segments of lines of these lengths; a column for each segment."""
    k = np.arange(distance + 1)
    short, rest = np.divmod(length, distance + 1)
    size = short[:, None] + (k >= distance + 1 - rest[:, None])
    return np.cumsum(size, axis=1) - size, size


def keys_of(start: np.ndarray, end: np.ndarray, hasher: tn.Rolling, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """All keys: (numbers of lines, keys, how much shorter the lines sought are, starts and sizes of the substrings), where
    -1 in the third place stands for keys that are indexed."""
    length, every = end - start, np.arange(len(start))
    for drop in range(distance + 1):
        at, size = segments(length - drop, distance)
        for k in range(distance + 1):
            salt = (length - drop).astype(np.uint64) * np.uint64(2 * distance + 2) + np.uint64(k)
            if not drop:
                a = start + at[:, k]
                yield every, tn.mix(hasher(a, a + size[:, k]) ^ tn.mix(salt)), -1, a, size[:, k]
            low = np.maximum(np.maximum(0, at[:, k] - k), at[:, k] + drop - (distance - k))
            high = np.minimum(np.minimum(length - size[:, k], at[:, k] + k), at[:, k] + drop + (distance - k))
            for shift in range(int((high - low).max(initial=-1)) + 1):
                which = np.flatnonzero((low + shift <= high) & (length >= drop))
                a = start[which] + low[which] + shift
                yield which, tn.mix(hasher(a, a + size[which, k]) ^ tn.mix(salt[which])), drop, a, size[which, k]


def _among(frequent: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(keys), bool)
    return frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys


def _keys(docs: DataFrame, distance: int, least: int, frequent=None) -> DataFrame:
    """(key, id, size, part): size is the line's length where it is indexed, and its length negative where it probes; part
    spreads the rows of keys in the broadcast ``frequent``."""
    spread = partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in small(batches):
            texts = column(batch, "text")
            if len(known) > MOST_KNOWN:
                known.clear()
            for a, b in chunked(texts):
                _, _, start, end, hashes, _, points = lines_of(texts[a:b], least)
                ids, first = np.unique(hashes[:, 0], return_index=True)
                new = np.array([x not in known for x in ids.tolist()], bool)
                known.update(ids[new].tolist())
                ids, start, end = ids[new], start[first[new]], end[first[new]]
                for which, key, drop, _, _ in keys_of(start, end, tn.Rolling(points), distance):
                    size, key = (end - start)[which].astype(np.int32), key.view(np.int64)
                    part = (ids[which] % spread * _among(frequent.value, key) if frequent else np.zeros(len(key))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[which]), pa.array(size if drop < 0 else -size), pa.array(part)], ["key", "id", "size", "part"])

    return docs.mapInArrow(run, "key bigint, id bigint, size int, part int")


def _frequent(docs: DataFrame, distance: int, least: int) -> np.ndarray:
    """The most frequent keys, in order; a bounded number of them."""
    sampled = _keys(docs.where(F.expr(f"pmod(xxhash64(doc_id), {SAMPLED}) = 0")), distance, least).select("key", "id", "size").distinct().groupBy("key").count()
    sampled = cut(sampled)
    total = sampled.agg(F.sum("count")).first()[0] or 0
    most = max(LEAST_FREQUENT, total / (SHARE * partitions(docs.sparkSession)))
    return np.sort(np.array([r[0] for r in sampled.where(F.col("count") > most).select("key").collect()], np.int64))


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole runs of equal values in the first ``by`` columns, of rows in order: some batches' rows at once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if not len(new[0]):
            continue
        fresh = np.any([x[1:] != x[:-1] for x in new[:by]], axis=0)
        same = bool(held) and all(x[0] == y[-1] for x, y in zip(new[:by], held[-1]))
        cuts = np.flatnonzero(fresh)
        if same and not len(cuts):
            held.append(new)
            continue
        last = int(cuts[-1]) + 1 if len(cuts) else 0
        held.append([x[:last] for x in new])
        yield [np.concatenate(x) for x in zip(*held)]
        held = [[x[last:] for x in new]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _pairs_of(run: np.ndarray, size: np.ndarray, ident: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different lines, a probing and an indexed one, of each run; a pair may come repeatedly."""
    edge = np.append(np.searchsorted(run, np.arange(run[-1] + 1 if len(run) else 0)), len(run))
    count = np.concatenate(([0], np.cumsum(size > 0)))
    n = np.diff(count[edge])
    where_indexed, probes = np.flatnonzero(size > 0), np.flatnonzero((size < 0) & (n > 0)[run])
    base, width = count[edge[:-1]][run[probes]], n[run[probes]]
    done, upto = 0, np.cumsum(width)
    while done < len(probes):
        most = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + 50 * BLOCK, "right"))
        part = slice(done, max(most, done + 1))
        p = np.repeat(probes[part], width[part])
        q = where_indexed[tn.gather(base[part], width[part])]
        # of two lines of one length each finds the other: once is enough
        fit = (ident[p] != ident[q]) & ((-size[p] != size[q]) | (ident[p] > ident[q]))
        yield p[fit], q[fit]
        done = part.stop


def _meet(frequent, most_pairs: int):
    """Of rows (key, id, size) in order, candidate pairs (a, b, 0), a < b, and the rows (key, id, size) of keys that make too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "size"]
        for key, ident, size in _runs(batches, 1):
            # a line that many tasks have met comes from each of them, and counts once
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]) | (size[1:] != size[:-1])))
            key, ident, size = key[fresh], ident[fresh], size[fresh]
            number = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            indexed = np.bincount(number, size > 0)
            many = indexed * np.bincount(number, size < 0) > most_pairs
            many |= _among(frequent.value, key[np.searchsorted(number, np.arange(len(many)))])
            more = many[number]
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(ident[more]), pa.array(size[more])], names)
            key, ident, size = key[~more], ident[~more], size[~more]
            number = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else key
            for p, q in _pairs_of(number, size, ident):
                if len(p):
                    pair = np.unique(np.column_stack((np.minimum(ident[p], ident[q]), np.maximum(ident[p], ident[q]))), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.zeros(len(pair), np.int32))], names)

    return run


def _further(distance: int):
    """Of rows (key, id, h2, size, line, doc_id, at) the same with the keys of what the line has besides the key's segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4000):
            lines, sought = column(batch, "line"), int64s(batch, "key").view(np.uint64)
            indexed = int64s(batch, "size") > 0
            points, start = tn.join(lines)
            end = start + np.fromiter(map(len, lines), np.int64, len(lines))
            row, drops, rest = [], [], []
            for which, key, drop, a, size in keys_of(start, end, tn.Rolling(points), distance):
                hit = (key == sought[which]) & (indexed[which] == (drop < 0))
                for r, x, n in zip(which[hit].tolist(), (a - start[which])[hit].tolist(), size[hit].tolist()):
                    row.append(r), drops.append(drop), rest.append(lines[r][:x] + lines[r][x + n :])
            row, drops = np.array(row, np.int64), np.array(drops, np.int64)
            points, start = tn.join(rest)
            end = start + np.fromiter(map(len, rest), np.int64, len(rest))
            places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for which, key, drop, _, _ in keys_of(start, end, tn.Rolling(points), distance):
                which, key = which[fit := drops[which] == drop], key[fit]
                places.append(row[which]), keys.append(tn.mix(key ^ tn.mix(sought[row[which]], 1)))
            both = np.unique(np.column_stack((np.concatenate(places).astype(np.uint64), np.concatenate(keys))), axis=0)
            out = batch.take(pa.array(both[:, 0].astype(np.int64)))
            yield out.set_column(0, "key", pa.array(both[:, 1].view(np.int64)))

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``, so that a probing and an indexed line of a key meet in one block, which has a bounded number of lines."""
    of = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK_LINES)).cast("int")
    many = rows.groupBy("key").agg(of(F.count_if(F.col("size") > 0)).alias("ni"), of(F.count_if(F.col("size") < 0)).alias("np")).where("ni > 1 or np > 1")
    sized = rows.join(many, "key", "left").fillna(1, ["ni", "np"])
    own = F.when(F.col("size") > 0, F.expr("transform(sequence(0, np - 1), j -> cast(pmod(id, ni) as int) * np + j)")).otherwise(F.expr("transform(sequence(0, ni - 1), i -> i * np + cast(pmod(id, np) as int))"))
    return sized.withColumn("block", F.explode(own)).drop("ni", "np")


def _later(distance: int):
    """Of rows (key, block, id, h2, size, line, doc_id, at) in order, those (id, h2) that an earlier line of their block is near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches, 2):
            key, block, ident, h2, size, line, doc_id, at = columns
            number = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            order = np.empty(len(key), np.int64)
            order[np.lexsort((h2, ident, at, doc_id))] = np.arange(len(key))
            _, line_of = np.unique(np.column_stack((ident, h2)), axis=0, return_inverse=True)
            line_of = line_of.reshape(-1)
            gone = np.zeros(len(key), bool)  # by number of the line
            for p, q in _pairs_of(number, size, ident):
                later, earlier = np.where(order[p] > order[q], p, q), np.where(order[p] > order[q], q, p)
                # each line is compared with the earliest that it meets first, and with twice as many each time
                turn = np.lexsort((order[earlier], line_of[later]))
                later, earlier = later[turn], earlier[turn]
                owner = line_of[later]
                nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
                low, high = 0, 2
                while low <= nth.max(initial=-1):
                    todo = np.flatnonzero((nth >= low) & (nth < high) & ~gone[owner])
                    for x in range(0, len(todo), BLOCK):
                        k = todo[x : x + BLOCK]
                        near = edit_distances(list(line[later[k]]), list(line[earlier[k]]), distance) <= distance
                        gone[owner[k[near]]] = True
                    low, high = high, high * 2
            found = np.unique(np.column_stack((ident, h2))[gone[line_of]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "h2"])

    return run


def edit_distances(a: list[str], b: list[str], most: int = DISTANCE) -> np.ndarray:
    """Of each pair the edit distance, or most + 1 if it is more: a bit-vector of the band around the diagonal, one word a
    pair, goes along all second texts at once."""
    m, n = (np.fromiter(map(len, x), np.int64, len(a)) for x in (a, b))
    out = np.full(len(a), most + 1)
    tiny = (m <= most) | (n <= most)
    for k in np.flatnonzero(tiny):
        out[k] = _table(a[k], b[k])
    todo = np.flatnonzero(~tiny & (np.abs(m - n) <= most))
    todo = todo[np.argsort(n[todo], kind="stable")]
    for at in range(0, len(todo), BLOCK):
        part = todo[at : at + BLOCK]
        out[part] = _banded([a[k] for k in part], [b[k] for k in part], m[part], n[part], most)
    return np.minimum(out, most + 1)


def _table(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _banded(a: list[str], b: list[str], m: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Of pairs in the order of n. In column i the top bit stands for row i + most, each lower bit for a row less. The value
    of the top bit's row is followed down the diagonal until that is the last row, then along this."""
    u = np.uint64
    x, first = tn.join(a)
    y, second = tn.join(b)
    plus, minus = np.full(len(a), u(((1 << 64) - 1) >> (63 - most) << (63 - most))), np.zeros(len(a), u)
    score = np.full(len(a), most, np.int64)
    for i in range(int(n.max(initial=0))):
        k = slice(int(np.searchsorted(n, i, "right")), None)
        c, match = y[second[k] + i], np.zeros(len(n[k]), u)
        for back in range(2 * most + 2):
            row = i + most - back
            if row >= 0:
                inside = row < m[k]
                same = inside & (x[first[k] + np.where(inside, row, 0)] == c)
                match |= same.astype(u) << u(63 - back)
        p, q = plus[k], minus[k]
        diagonal = (((match & p) + p) ^ p) | match | q
        up, down = q | ~(diagonal | p), diagonal & p
        along = i - (m[k] - most)  # steps along the last row
        bit = u(1) << (62 - np.maximum(along, 0)).astype(u)
        score[k] += np.where(along < 0, (diagonal >> u(63)) == 0, ((up & bit) != 0).astype(np.int64) - ((down & bit) != 0))
        lower = diagonal >> u(1)
        plus[k], minus[k] = down | ~(lower | up), lower & up
    return score


def _verify(distance: int):
    """Of pairs of lines the ids of the later ones of those that are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = edit_distances(column(batch, "ta"), column(batch, "tb"), distance) <= distance
            yield batch.select(["id", "h2"]).filter(pa.array(near))

    return run


def _lines(docs: DataFrame, least: int, wanted: DataFrame) -> DataFrame:
    """(id, h2, line): the text of each line of ``wanted``, and of some others, a few times from each task at most."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        bits = shared.value
        for batch in small(batches):
            texts = column(batch, "text")
            if len(known) > MOST_KNOWN:
                known.clear()
            for a, b in chunked(texts):
                row, _, start, end, hashes, begins, _ = lines_of(texts[a:b], least)
                ids, first = np.unique(hashes[:, 1], return_index=True)
                maybe = passes(bits, hashes[first, 0])
                ids, first = ids[maybe], first[maybe]
                fresh = [k for k, x in enumerate(ids.tolist()) if x not in known]
                known.update(ids[fresh].tolist())
                at = first[fresh]
                shift = begins[row[at]]
                lines = [texts[a + r][s:e] for r, s, e in zip(row[at].tolist(), (start[at] - shift).tolist(), (end[at] - shift).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at, 0]), pa.array(hashes[at, 1]), pa.array(lines, pa.string())], ["id", "h2", "line"])

    return docs.mapInArrow(run, "id bigint, h2 bigint, line string")


def _places(docs: DataFrame) -> DataFrame:
    """(id, h2, doc_id, at) of every line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = column(batch, "text")
            for a, b in chunked(texts):
                row, number, _, _, hashes, _, _ = lines_of(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), batch.column(0).take(pa.array(row + a)), pa.array(number.astype(np.int32))], ["id", "h2", "doc_id", "at"])

    return docs.mapInArrow(run, "id bigint, h2 bigint, doc_id bigint, at int")


def near_later(docs: DataFrame, first: DataFrame, distance: int = DISTANCE, least: int = LEAST_CHARS) -> DataFrame:
    """(id, h2) of all lines, of ``least`` and of ``distance`` + 1 characters at least, that an earlier other line, by ``first``, is
    within ``distance`` edits of. Candidates go by the first half of a line's hash; lines that share it count apart from then on."""
    least = max(least, distance + 1)
    frequent = _frequent(docs, distance, least)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    met = _keys(docs, distance, least, shared).repartition("key", "part").drop("part").sortWithinPartitions("key", "id", "size")
    found = cut(met.mapInArrow(_meet(shared, MOST_PAIRS), "a bigint, b bigint, size int").distinct())
    pairs, more = found.where("size = 0").drop("size"), found.where("size <> 0").selectExpr("a as key", "b as id", "size")
    wanted = cut(pairs.selectExpr("a as id").union(pairs.selectExpr("b as id")).union(more.select("id")).distinct())
    texts = _lines(docs, least, wanted).join(wanted, "id", "left_semi").dropDuplicates(["id", "h2"])
    lines = cut(texts.join(first.select("id", "h2", "first.*"), ["id", "h2"]))
    a, b = (lines.select(F.col("id").alias(x), F.struct("doc_id", "at", "id", "h2").alias(f"place_{x}"), F.col("line").alias(f"t{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select(F.greatest("place_a", "place_b").alias("later"), "ta", "tb").select("later.id", "later.h2", "ta", "tb")
    later = both.mapInArrow(_verify(distance), "id bigint, h2 bigint")
    if more.limit(1).count():
        rows = "key bigint, id bigint, h2 bigint, size int, line string, doc_id bigint, at int"
        apart = more.join(lines, "id").select("key", "id", "h2", "size", "line", "doc_id", "at").mapInArrow(_further(distance), rows)
        blocks = _blocks(cut(apart)).select("key", "block", "id", "h2", "size", "line", "doc_id", "at").repartition("key", "block").sortWithinPartitions("key", "block")
        later = later.union(blocks.mapInArrow(_later(distance), "id bigint, h2 bigint"))
    return later.distinct()


def duplicates(docs: DataFrame, distance: int = DISTANCE, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, removed): for each document that loses lines, their numbers, from 0, in order."""
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")
    places = _places(slim)
    first = places.groupBy("id", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = near_later(slim, first, distance, least)
    known = first.join(later.withColumn("near", F.lit(True)), ["id", "h2"], "left").where("n > 1 or near")
    gone = places.join(known, ["id", "h2"]).where("near or struct(doc_id, at) <> first")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        new = []
        for text, removed in zip(column(batch, "text"), column(batch, "removed")):
            gone = set(removed or ())
            new.append("\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone]) if text and gone else text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))


def without_duplicates(docs: DataFrame, distance: int = DISTANCE, least: int = LEAST_CHARS) -> DataFrame:
    """``docs``, the columns of documents, without the lines removed; a document that these leave blank goes."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    types = dict(docs.dtypes)
    whole = docs.join(duplicates(docs, distance, least), "doc_id", "left")
    left = whole.mapInArrow(_drop, ", ".join([*(f"{c} {types[c]}" for c in DOCUMENT_COLUMNS), "removed array<int>"]))
    kept = left.where(F.col("removed").isNull() | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(F.col("removed").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, removed, n_removed) of every document that loses lines."""
    return duplicates(table(spark, sf_dir, "documents")).withColumn("n_removed", F.size("removed"))
