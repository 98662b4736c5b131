"""Documents with every odd case at once: nulls, empty and long texts, repeats, and columns whose names clash."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", key string, id bigint, a int, b int, at string, removed string, size int, hi bigint, lo bigint, g string, distance double, score double, spans string, shard string, n_bytes string"

EN = "the river ran over the stones and the old man sat there with his dog while they talked of the weather and the war. "
DE = "der fluss lief über die steine und der alte mann saß dort mit seinem hund während sie über das wetter und den krieg sprachen. "


def docs(spark: SparkSession, rows: list, extra: bool = False) -> DataFrame:
    """Rows of text, or (doc_id, text), (doc_id, text, lang, source); further columns are filled with what must not matter."""
    full = []
    for k, r in enumerate(rows):
        r = (k, r) if r is None or isinstance(r, str) else tuple(r)
        doc_id, text, lang, source = (*r, "en", "s")[:4] if len(r) < 3 else (*r, "s")[:4]
        full.append((doc_id, text, lang, source, len(text) if text else None))
    if not extra:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*r, "k", 7, 1, 2, "x", "y", 3, 4, 5, "g", 0.5, 0.5, "z", "w", "v") for r in full], SCHEMA + EXTRA)


def odd(spark: SparkSession, extra: bool = True) -> DataFrame:
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, EN * 3), (4, EN * 3), (5, EN * 3), (None, EN * 3), (6, (EN + "\n") * 2000), (7, "x" * 100_000), (8, "!?! ... 123"), (9, DE, None, None), (10, "a\U0001f600b \x00 c\r\nd"), (11, EN, "en", None)]
    return docs(spark, rows, extra)


def empty(spark: SparkSession) -> DataFrame:
    return docs(spark, [], extra=True)
