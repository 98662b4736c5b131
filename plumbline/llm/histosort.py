"""Shards of equal bytes, in the order of a key, by histogram sort.

Splitters are sought before any row moves. Each round counts, over all partitions, the exact bytes of rows below each
candidate boundary, and puts new candidates into the intervals that still hold a splitter's target, until the bytes below
each splitter are within ``tolerance`` of a shard from its target, or no key lies between. Then one exchange brings every
row to its shard, which is sorted there. Rounds read a table of keys and sizes that is written once; the driver holds
numbers for candidates only.

Rows with one key stay in one shard, so a key with more bytes than the tolerance makes a larger one. Within a shard rows are
ordered by key and then by size, so equal keys of equal size are in no fixed order.

Cases: null keys, and keys that are no whole numbers, are before all others, in the first shard; a null or empty text has 0 bytes, and its row still gets its
shard; a text longer than a shard makes a shard of its own size; repeated rows stay together; an empty table gives no
rows; all columns pass through, and one named like an added one (``shard``, ``n_bytes``) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, table

#: Bytes of text in a shard, the part of it by which a splitter may miss, and candidates for a splitter in a round.
SHARD_BYTES, TOLERANCE, PROBES = 16_000_000, 0.02, 15

#: The most shards; of more bytes than so many shards hold, each is larger. It bounds what the driver holds and broadcasts.
MOST_SHARDS = 100_000


def bytes_below(sizes: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Of each probe, in order, the exact bytes of the rows of ``sizes`` (k, n) whose key is less."""
    shared = sizes.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            k, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            np.add.at(total, np.searchsorted(shared.value, k, "right"), n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    counts = np.zeros(len(probes) + 1, np.int64)
    for batch in sizes.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).toArrow().to_batches():
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    shared.unpersist()
    return np.cumsum(counts)[:-1]


def probed(target: np.ndarray, low: np.ndarray, low_n: np.ndarray, high: np.ndarray, high_n: np.ndarray, probes: int) -> np.ndarray:
    """Candidates, in order, for the splitters whose keys are still between ``low`` and ``high``: some divide the interval evenly,
    some surround the place where even bytes would put the target."""
    width = (high.astype(np.uint64) - low.astype(np.uint64)).astype(np.float64)  # keys may span more than half of the range of int64
    part = (target - low_n) / np.maximum(1, high_n - low_n)
    steps = [part, *(np.full(len(low), k / (probes // 2 + 1)) for k in range(1, probes // 2 + 1))]
    steps += [part + sign * 0.5**s for s in range(6, 6 + 2 * (probes // 4), 2) for sign in (-1, 1)]
    inside = np.clip(np.concatenate([width * np.clip(s, 0, 1) for s in steps]), 1, 2.0**64 - 2**11).astype(np.uint64)
    ends = np.tile(high.astype(np.uint64) - low.astype(np.uint64), len(steps))
    return np.unique((np.tile(low.astype(np.uint64), len(steps)) + np.minimum(inside, np.maximum(ends, 2) - np.uint64(1))).astype(np.int64))


def splitters(sizes: DataFrame, shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE, probes: int = PROBES, most: int = MOST_SHARDS, count=bytes_below) -> np.ndarray:
    """Keys, in order, at which shards begin, the first shard's left out; ``count`` tells the bytes below keys."""
    least, greatest, total, nulls = sizes.agg(F.min("k"), F.max("k"), F.sum("n"), F.sum(F.when(F.col("k").isNull(), F.col("n")))).first()
    keyed = sizes.where("k is not null")
    return search(lambda asked: count(keyed, asked), least, greatest, total or 0, nulls or 0, shard_bytes, tolerance, probes, most)


def search(count, least: int | None, greatest: int | None, total: int, nulls: int, shard_bytes: int, tolerance: float, probes: int, most: int = MOST_SHARDS) -> np.ndarray:
    """The rounds of ``splitters``, where ``count`` gives the bytes below each of some keys in order."""
    shards = min(most, -(-total // shard_bytes))
    if least is None or least == greatest or shards < 2:
        return np.zeros(0, np.int64)
    # of each splitter: the greatest probe known below its target with its count, and the least known above
    target = np.array([t * total // shards for t in range(1, shards)], np.int64)
    low, low_n = np.full(shards - 1, least, np.int64), np.full(shards - 1, nulls, np.int64)
    high, high_n = np.full(shards - 1, greatest, np.int64), np.full(shards - 1, total, np.int64)
    slack, done = tolerance * total / shards, [np.zeros(0, np.int64)]
    while len(target):
        asked = probed(target, low, low_n, high, high_n, probes)
        counts = count(asked) + nulls
        at = np.searchsorted(counts, target, "right")
        below, above = np.maximum(at - 1, 0), np.minimum(at, len(asked) - 1)
        up = (at > 0) & (asked[below] > low)
        low, low_n = np.where(up, asked[below], low), np.where(up, counts[below], low_n)
        down = (at < len(asked)) & (asked[above] < high)
        high, high_n = np.where(down, asked[above], high), np.where(down, counts[above], high_n)
        nearer = target - low_n <= high_n - target
        best, miss = np.where(nearer, low, high), np.where(nearer, target - low_n, high_n - target)
        found = (np.abs(miss) <= slack) | ((high.astype(np.uint64) - low.astype(np.uint64)) <= 1)
        done.append(best[found])
        target, low, low_n, high, high_n = (x[~found] for x in (target, low, low_n, high, high_n))
    keys = np.unique(np.concatenate(done))
    return keys[keys > least]


def sharded(rows: DataFrame, key: str, size: F.Column, shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` with ``shard``, from 0, and ``n_bytes``: a partition for each shard, sorted by ``key``."""
    sized = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "n_bytes")), F.coalesce(size, F.lit(0)).cast("bigint").alias("n_bytes"))
    sizes = cut(sized.select(F.col(key).try_cast("bigint").alias("k"), F.col("n_bytes").alias("n")))
    at = splitters(sizes, shard_bytes, tolerance)
    shared = rows.sparkSession.sparkContext.broadcast(at)

    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        known = k.notna().to_numpy()
        out = np.zeros(len(k), np.int32)
        out[known] = np.searchsorted(shared.value, k[known].to_numpy(np.int64), "right")
        return pd.Series(out)

    placed = sized.withColumn("shard", shard_of(F.col(key).try_cast("bigint")))
    return placed.repartitionById(len(at) + 1, F.col("shard")).sortWithinPartitions("shard", key, "n_bytes")


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the order of ``doc_id``, in shards of SHARD_BYTES of text."""
    return sharded(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))
