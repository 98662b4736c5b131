"""Remote inference as an operator: requests in, responses out, through a responder that the caller gives.

Requests of a partition are sent by a bounded pool of threads and retried with growing pauses; a request that fails for
good has status ``error`` and no text. A responder is any picklable callable of (model, messages) that returns a text,
or raises ``Retry`` for an error that may pass. ``stub`` is one that needs no network.
"""

from __future__ import annotations

import json
import random
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORKERS, RETRIES, PAUSE = 50, 3, 1.0


class Retry(Exception):
    """Too many requests, or a failure of the server."""


def stub(model: str, messages: str) -> str:
    """A digit that depends on the model and the messages only."""
    return str(1 + zlib.crc32(f"{model}|{messages}".encode()) % 5)


def ask(responder: Callable[[str, str], str], model: str, messages: str, retries: int, pause: float) -> tuple[str | None, str]:
    for attempt in range(retries + 1):
        try:
            return responder(model, messages), "ok"
        except Retry:
            if attempt < retries:
                time.sleep(pause * 2**attempt * (1 + random.random()))
        except Exception:  # noqa: BLE001 - whatever the backend raises is a failed request, which its status tells
            break
    return None, "error"


def respond(requests: DataFrame, responder: Callable[[str, str], str] = stub, workers: int = WORKERS, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """``requests`` (with ``model`` and ``messages``) with ``response`` and ``status``. No shuffle; messages go as JSON."""
    fields = ", ".join(f"`{c}` {t}" for c, t in requests.drop("messages").dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                got = list(pool.map(lambda x: ask(responder, x[0], x[1], retries, pause), zip(batch["model"], batch["_m"])))
                yield batch.drop(columns="_m").assign(response=[r for r, _ in got], status=[s for _, s in got])

    return requests.withColumn("_m", F.to_json("messages")).drop("messages").mapInPandas(run, f"{fields}, response string, status string")


def decoded(messages: str) -> list[dict]:
    return json.loads(messages)
