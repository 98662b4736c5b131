"""Removal of sentences that runs of consecutive sentences repeat from elsewhere in the corpus.

A run is of ``RUN`` consecutive sentences, or of as many more as make ``LEAST_WORDS`` words. From each sentence the
shortest run that begins there, and the shortest that ends there, is hashed to 128 bits; equal runs meet by hash; the
first, by ``doc_id`` and position, stays, and the sentences that any other covers are removed. So a longer repeated
passage is covered to both its ends by overlapping runs, however short its sentences are. A single sentence of
``LONG_WORDS`` words is a run too, and so is one of ``LEAST_WORDS`` that is the whole of its text. Phrases, headings and notices of fewer words than that are common property and stay.

The first document of each run is found by an aggregation that combines before its shuffle, and runs that occur once end
there. The others' hashes make a filter of bounded size; what it lets through joins with the first documents, and Spark splits
that join where one run is very frequent. The filter lets some through that the join drops, and never keeps back a repeat.

A sentence ends after . ! ? (or their full-width forms) before white space, at a line break, or with the text. Case
and the kind of white space don't count.

Cases: null or empty text, or one of fewer than ``LEAST_WORDS`` words, has no runs, so copies of it stay; rows of null ``doc_id`` are left out
(and kept by ``without_repeats``); a repeat within a document counts, its first place stays; rows that share a
``doc_id`` are one document, whose places in different rows aren't repeats of each other, and a sentence number removed is
removed from all of them; texts of any length count whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textnum as tn
from plumbline.llm.common import DOCUMENT_COLUMNS, chunked, column, cut, passes, sieve, small, table

RUN, LEAST_WORDS = 2, 20
#: Words of a sentence that is a passage by itself.
LONG_WORDS = 50

_ENDS = np.array([ord(c) for c in ".!?。！？"], np.uint32)


def sentences(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence that isn't blank: the number of its text, start and end in its chunk's characters, number of words; and those characters."""
    points, begins = tn.join(texts)
    kind = tn.kinds(points)
    blank = (kind == tn.SPACE) | (kind == tn.END)
    after = np.append(blank[1:], True)
    stop = (kind == tn.END) | (points == 10) | (np.isin(points, _ENDS) & after)
    upto = np.flatnonzero(stop) + 1
    start = np.concatenate(([0], upto[:-1])) if len(upto) else upto
    # the blanks at both ends don't belong to it
    solid = np.flatnonzero(~blank)
    first = np.searchsorted(solid, start)
    last = np.searchsorted(solid, upto) - 1
    full = first <= last
    start, end = solid[first[full]], solid[last[full]] + 1
    norm = tn.lowered(points)
    norm[blank] = 32
    word = (kind == tn.LETTER) | (kind == tn.NUMBER)
    begun = np.concatenate(([0], np.cumsum(word & ~np.concatenate(([False], word[:-1])))))
    return np.searchsorted(begins, start, "right") - 1, start, end, begun[end] - begun[start], norm


def runs_of(texts: list, run: int = RUN, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each run: the number of its text, of its first and last sentence there, and its hashes; by chunks of texts."""
    for a, b in chunked(texts):
        row, start, end, words, norm = sentences(texts[a:b])
        n = len(row)
        if not n:
            continue
        flat = norm.tobytes().decode("utf-32-le", "surrogatepass")
        own = b"".join([xxhash.xxh3_128_digest(flat[s:e].encode("utf-8", "surrogatepass")) for s, e in zip(start.tolist(), end.tolist())])
        upto, every = np.concatenate(([0], np.cumsum(words))), np.arange(n)
        # a run is of the sentences first .. last
        last = np.maximum(every + run, np.searchsorted(upto, upto[:-1] + least_words)) - 1
        first = np.minimum(every + 1 - run, np.searchsorted(upto, upto[1:] - least_words, "right") - 1)
        begin, stop = np.searchsorted(row, row), np.searchsorted(row, row, "right")
        forth, back, alone = last < stop, first >= begin, (words >= long_words) | ((stop - begin == 1) & (words >= least_words))
        firsts, lasts = np.concatenate((every[forth], first[back], every[alone])), np.concatenate((last[forth], every[back], every[alone]))
        firsts, lasts = np.divmod(np.unique(firsts * n + lasts), n)
        hashes = b"".join([xxhash.xxh3_128_digest(own[16 * x : 16 * y + 16]) for x, y in zip(firsts.tolist(), lasts.tolist())])
        yield row[firsts] + a, firsts - begin[firsts], lasts - begin[firsts], np.frombuffer(hashes, np.int64).reshape(-1, 2)


def repeats(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, removed): for each document that loses any, the numbers of the sentences removed, from 0, in order."""

    def hashed(bits):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                for row, first, last, h in runs_of(column(batch, "text"), run, least_words):
                    # a run that the same text has before
                    order = np.lexsort((first, h[:, 1], h[:, 0], row))
                    again = np.zeros(len(row), bool)
                    again[order[1:]] = np.all([x[order[1:]] == x[order[:-1]] for x in (row, h[:, 0], h[:, 1])], axis=0)
                    keep = passes(bits.value, h[:, 0]) if bits else np.ones(len(row), bool)
                    columns = [batch.column(0).take(pa.array(row[keep])), *(pa.array(x[keep]) for x in (first.astype(np.int32), last.astype(np.int32), h[:, 0], h[:, 1], again))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "upto", "h1", "h2", "again"])

        return slim.mapInArrow(make, "doc_id bigint, at int, upto int, h1 bigint, h2 bigint, again boolean")

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")
    by = hashed(None).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("again").alias("twice"))
    firsts = cut(by.where("first <> last or twice").select("h1", "h2", "first"))
    bits = docs.sparkSession.sparkContext.broadcast(sieve(firsts.select(F.col("h1").alias("id"))))
    later = hashed(bits).join(firsts, ["h1", "h2"]).where("doc_id <> first or again")
    return later.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "upto")), lambda x: F.sequence(x["at"], x["upto"]))))).alias("removed"))


def strip_sentences(text: str, removed: list[int]) -> str:
    """``text`` without the sentences of these numbers, and without the white space after each."""
    _, starts, _, _, _ = sentences([text])
    gone, out, at = set(removed), [], 0
    edges = [*starts.tolist(), len(text)]
    for k in range(len(starts)):
        if k in gone:
            out.append(text[at : edges[k]])
            at = edges[k + 1]
    return "".join([*out, text[at:]]).rstrip()


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts, removed = column(batch, "text"), column(batch, "removed")
        new = [strip_sentences(t, r) if t and r else t for t, r in zip(texts, removed)]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(new, pa.string()))


def changed(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, removed, n_removed, text): the documents that lose sentences, with what is left of them."""
    gone = cut(repeats(docs, run, least_words))
    bits = docs.sparkSession.sparkContext.broadcast(sieve(gone.select(F.xxhash64("doc_id").alias("id"))))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, ids.to_numpy(np.int64)))

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null").where(maybe(F.xxhash64("doc_id")))
    lost = slim.join(gone, "doc_id").select("doc_id", "removed", F.size("removed").alias("n_removed"), "text")
    return lost.mapInArrow(_strip, "doc_id bigint, removed array<int>, n_removed int, text string")


def without_repeats(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs``, the columns of documents, with the repeated sentences removed; a document may become empty."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    types = dict(docs.dtypes)
    whole = docs.join(repeats(docs, run, least_words), "doc_id", "left")
    left = whole.mapInArrow(_strip, ", ".join([*(f"{c} {types[c]}" for c in DOCUMENT_COLUMNS), "removed array<int>"]))
    return left.withColumn("n_chars", F.when(F.col("removed").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def op9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(table(spark, sf_dir, "documents"))
