"""What the operators of this subpackage share: reading tables, cutting lineage, cutting batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the vectorised text passes hold at once; a longer text makes a chunk of its own.
CHUNK_CHARS = 1 << 18

#: Bits of a sieve for each id in it, the most bits that it has, and the shifts that give an id's places.
SIEVE_BITS, MOST_SIEVE, SHIFTS = 8, 1 << 27, (0, 29)

#: The columns of the documents table, which every filtering stage returns.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share; where it is unset and there is one machine only, a new one."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="plumbline-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that its lineage ends."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tokenizers(spark: SparkSession) -> str:
    """The folder of the public vocabularies, on the driver."""
    return spark.conf.get("spark.plumbline.tokenizers", "/opt/tokenizers").rstrip("/")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunked(texts: list, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` of at most ``most`` characters, or of one text; null counts as empty."""
    a = total = 0
    for k, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if k > a and total + n > most:
            yield a, k
            a, total = k, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, so that a worker holds the texts of few as Python strings."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def int64s(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column that has no nulls."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def sieve(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ``ids``, in words of 64 bits: SIEVE_BITS for each id and at most MOST_SIEVE, with two places for each id. A fuller
    filter lets more ids through that aren't there; it never keeps back one that is."""
    size = min(MOST_SIEVE, 1 << max(10, (ids.count() * SIEVE_BITS - 1).bit_length()))
    # an id is a hash already, so its own bits, from two places, are as good as others
    place = F.explode(F.array(*(F.shiftrightunsigned("id", k).bitwiseAND(F.lit(size - 1).cast("bigint")) for k in SHIFTS)))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    out = np.zeros(size // 64, np.int64)
    for table_ in words.toArrow().to_batches():
        out[table_.column(0).to_numpy()] = table_.column(1).to_numpy()
    return out


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out, u, words = np.ones(len(ids), bool), ids.view(np.uint64), bits.view(np.uint64)
    for k in SHIFTS:
        p = (u >> np.uint64(k)) & np.uint64(64 * len(words) - 1)
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return out
