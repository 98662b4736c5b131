"""Removal of benchmark passages from training documents with an FM-index of each training shard.

A shard is what a task reads at once. Its words are numbered by the benchmark's vocabulary, so a wavelet matrix
of few levels holds its Burrows-Wheeler transform; a word that no benchmark item holds ends a run, and a run
shorter than the shortest phrase can hold none, so neither is indexed: nothing that could match is left out. All
phrases, which are the runs of ``words`` words of the items, are searched backwards together; rows of the ranges
found are walked to sampled suffix positions; and the spans that result are merged.

Words are maximal runs of letters and digits in lower case, so case, punctuation and line breaks don't matter.

Cases: an item of fewer than ``words`` words is one phrase, and one of fewer than ``least`` words counts only where it makes
up whole lines, as so few words are common property elsewhere; an item without words is not searched for; a null or empty
text has no spans; a null item is skipped, and without any item nothing is found; texts of any length are searched whole; every occurrence counts, ties don't arise; repeated rows are reported each; a row with
a null ``doc_id`` is searched too and reported under null; only ``doc_id`` and ``text`` are read, further columns
of whatever name are not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textnum as tn
from plumbline.llm.common import DOCUMENT_COLUMNS, chunked, column, cut, small, table

#: Words of a phrase, and the least that a shorter item must have to be found within a line.
WORDS, LEAST = 10, 5

#: Characters of benchmark text that make one table of phrases; more makes several, which each batch is searched for in turn.
BLOCK_CHARS = 32_000_000

#: Tables that are broadcast at once, which bounds what a worker holds; more take another pass that carries the spans on.
PASS_BLOCKS = 8

#: Every so many positions of a shard are stored with their row.
SAMPLE = 8

SPANS = "array<struct<start:int,end:int>>"
FOUND = f"doc_id bigint, spans {SPANS}, item_ids array<bigint>, n_words bigint, cleaned string"


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes; 0 ends a run, and the zeros count as different symbols in order of position."""
    n, stop = len(symbols), symbols == 0
    rank = np.where(stop, np.cumsum(stop) - 1, stop.sum() - 1 + symbols)
    k = 1
    while True:
        key = rank << 32
        key[: n - k] |= rank[k:] if k < n else 0
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit of the symbol a level."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(sequence) - int(bit.sum()))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        self.base = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = ones[at]
            at = np.where((symbol >> level) & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, at) - self.base[symbol]


class FMIndex:
    """Of a sequence of symbols 1..top, in which 0 ends every run, the last one too."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.tree = WaveletMatrix(self.last, top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        first = np.concatenate(([True], symbols[:-1] == 0))
        self.marked = (order % sample == 0) | first[order]
        self.nth = np.cumsum(self.marked, dtype=np.int32)
        self.stored = order[self.marked].astype(np.int32)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length, a row each: the numbers of those that occur, and their ranges of rows."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, j]
            low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of rows, by steps back to a stored one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            c = self.last[rows[todo]]
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.stored[self.nth[rows] - 1] + steps


def phrases_of(items: list[tuple[int, str]], words: int = WORDS) -> dict:
    """What is searched for: the vocabulary's hashes in order, and for each length of phrase the distinct phrases and
    the pairs (phrase, item)."""
    row, _, _, hashes = tn.words([t for _, t in items])
    vocabulary = np.unique(hashes)
    ids = np.searchsorted(vocabulary, hashes) + 1
    edges = np.searchsorted(row, np.arange(len(items) + 1))
    by: dict[int, list] = {}
    for (item, _), a, b in zip(items, edges[:-1], edges[1:]):
        if b > a:
            n = min(words, b - a)
            windows = np.lib.stride_tricks.sliding_window_view(ids[a:b], n)
            by.setdefault(int(n), []).append((windows, np.full(len(windows), item)))
    out = {}
    for n, parts in by.items():
        every, owner = np.concatenate([p for p, _ in parts]), np.concatenate([o for _, o in parts])
        distinct, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack((which.reshape(-1), owner)), axis=0)
        out[n] = (distinct, pairs)
    return {"vocabulary": vocabulary, "by_length": out}


def line_edges(row: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of ``texts``, by (row, start, end), whether it is the first and the last of its line."""
    points, begins = tn.join(texts)
    upto = np.concatenate(([0], np.cumsum((points == 10) | (points == tn.STOP))))
    line = upto[begins[row] + starts]
    first = np.append(True, line[1:] != line[:-1])[: len(row)]
    return first, np.append(first[1:], True)[: len(row)]


def find(texts: list, sought: dict, least: int = LEAST) -> dict[int, tuple[list[tuple[int, int]], list[int], int]]:
    """By the number of the text, where any phrase occurs: merged spans, the items, and the number of words in spans."""
    vocabulary, by_length = sought["vocabulary"], sought["by_length"]
    if not by_length:
        return {}
    shortest = min(by_length)
    kept: list[list[np.ndarray]] = [[] for _ in range(6)]
    for a, b in chunked(texts):
        row, starts, ends, hashes = tn.words(texts[a:b])
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == hashes
        new = np.ones(len(row), bool)
        new[1:] = ~known[:-1] | (row[1:] != row[:-1])
        first = np.flatnonzero(known & new)
        after = np.append(~known[1:] | (row[1:] != row[:-1]), True) if len(row) else np.zeros(0, bool)
        length = np.flatnonzero(known & after) + 1 - first
        first, length = first[length >= shortest], length[length >= shortest]
        take = tn.gather(first, length + 1)
        stop = np.zeros(len(take), bool)
        stop[np.cumsum(length + 1) - 1] = True
        take = np.where(stop, take - 1, take)
        opens, closes = line_edges(row, starts, ends, texts[a:b]) if shortest < least else (known, known)
        for column_, values in zip(kept, (np.where(stop, 0, at[take] + 1), row[take] + a, starts[take], ends[take], opens[take], closes[take])):
            column_.append(values)
    symbols, row, starts, ends, opens, closes = (np.concatenate(k) for k in kept)
    if not len(symbols):
        return {}
    index = FMIndex(symbols, len(vocabulary))
    spots, owners = [], []
    for n, (phrases, pairs) in by_length.items():
        which, low, high = index.ranges(phrases)
        places = index.locate(tn.gather(low, high - low))
        phrase = np.repeat(which, high - low)
        if n < least:
            whole = opens[places] & closes[places + n - 1]
            places, phrase = places[whole], phrase[whole]
        spots.append(np.column_stack((row[places], starts[places], ends[places + n - 1], places, places + n)))
        a, b = np.searchsorted(pairs[:, 0], phrase), np.searchsorted(pairs[:, 0], phrase, "right")
        owners.append(np.column_stack((np.repeat(row[places], b - a), pairs[tn.gather(a, b - a), 1])))
    found = np.concatenate(spots)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    out: dict = {}
    for r, s, e, p, q in found.tolist():
        spans, _, _ = out.setdefault(r, ([], [], 0))
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], e), spans[-1][2], max(spans[-1][3], q))
        else:
            spans.append((s, e, p, q))
    owned: dict[int, list[int]] = {}
    for r, item in np.unique(np.concatenate(owners), axis=0).tolist():
        owned.setdefault(r, []).append(item)
    return {r: ([(s, e) for s, e, _, _ in spans], owned[r], sum(q - p for _, _, p, q in spans)) for r, (spans, _, _) in out.items()}


def without(text: str, spans: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return "".join([*out, text[at:]])


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS) or 1
    return [items.where(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}")) if n > 1 else items for k in range(n)]


def find_all(texts: list, tables: Iterable[dict], before: dict | None = None) -> dict[int, tuple[list[tuple[int, int]], list[int], int]]:
    """What ``find`` gives for all the tables, and those that gave ``before``, as if they were one."""
    out: dict = dict(before or {})
    for sought in tables:
        for r, new in find(texts, sought).items():
            if r not in out:
                out[r] = new
                continue
            merged: list[tuple[int, int]] = []
            for s, e in sorted(out[r][0] + new[0]):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            out[r] = (merged, sorted({*out[r][1], *new[1]}), sum(len(tn.words([texts[r][s:e]])[0]) for s, e in merged))
    return out


_LISTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pass(docs: DataFrame, blocks: list[DataFrame], words: int, rest: list[str], every: bool) -> DataFrame:
    """FOUND's columns and ``rest`` of every row, or only of those with spans; spans that ``docs`` has count too."""
    shared = [docs.sparkSession.sparkContext.broadcast(phrases_of([tuple(r) for r in items.collect()], words)) for items in blocks]
    names = [x.split()[0] for x in ("doc_id", "spans", "item_ids", "n_words", "cleaned")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, before = column(batch, "text"), {}
            if "spans" in batch.schema.names:
                for r, (spans, ids, n) in enumerate(zip(*(column(batch, c) for c in ("spans", "item_ids", "n_words")))):
                    if spans:
                        before[r] = ([(x["start"], x["end"]) for x in spans], ids, n)
            found = find_all(texts, (x.value for x in shared), before)
            rows = range(len(texts)) if every else sorted(found)
            none: tuple = ([], [], 0)
            part = [found.get(r, none) for r in rows]
            take = pa.array(list(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    pa.array([[{"start": s, "end": e} for s, e in x[0]] for x in part], _LISTS),
                    pa.array([x[1] for x in part], pa.list_(pa.int64())),
                    pa.array([x[2] for x in part], pa.int64()),
                    pa.array([without(texts[r], x[0]) if x[0] else texts[r] for r, x in zip(rows, part)], pa.string()),
                    *[batch.column(batch.schema.get_field_index(c)).take(take) for c in rest],
                ],
                [*names, *rest],
            )

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([FOUND, *(f"`{c}` {types[c]}" for c in rest)]))


def _search(docs: DataFrame, blocks: list[DataFrame], words: int, every: bool) -> DataFrame:
    """FOUND's columns: of every row, or only of those with spans."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *rest)
    while len(blocks) > PASS_BLOCKS:
        docs = cut(_pass(docs, blocks[:PASS_BLOCKS], words, ["text", *rest], True).drop("cleaned"))
        blocks = blocks[PASS_BLOCKS:]
    return _pass(docs, blocks, words, rest, every)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents that hold a phrase: merged spans in characters, the items, and the text without the spans."""
    return _search(docs.select("doc_id", "text"), _blocks(benchmark), words, False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs``, the columns of documents, with every span taken out of its text; no shuffle."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = _search(docs, _blocks(benchmark), words, True)
    return found.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length("cleaned").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
