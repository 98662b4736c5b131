"""The queries of the ten corpus operations, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import warc
from plumbline.llm.bpe import op8_bpe
from plumbline.llm.decontaminate import op4_decontamination
from plumbline.llm.histosort import op3_histogram_sort
from plumbline.llm.language import op7_language
from plumbline.llm.linededup import op1_lines
from plumbline.llm.outliers import op6_outliers
from plumbline.llm.secrets import op5_secrets
from plumbline.llm.simhash import op10_simhash
from plumbline.llm.spans import op9_spans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lines": op1_lines,
        "op2_warc": warc.op2_warc,
        "op3_histogram_sort": op3_histogram_sort,
        "op4_decontamination": op4_decontamination,
        "op5_secrets": op5_secrets,
        "op6_outliers": op6_outliers,
        "op7_language": op7_language,
        "op8_bpe": op8_bpe,
        "op9_spans": op9_spans,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL}
