"""Sending prompts to models from Spark tasks; failures come back as rows, never as exceptions."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Reply:
    text: str = ""
    finish_reason: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    reasoning_tokens: int = 0
    total_tokens: int = 0


class Transient(Exception):
    """Raised by a client for errors worth another attempt."""


# A client answers (model, system, prompt, temperature); it must be picklable.
Client = Callable[[str, str, str, float | None], Reply]

REPLY_FIELDS = [
    StructField("text", StringType()), StructField("finish_reason", StringType()),
    StructField("prompt_tokens", LongType()), StructField("completion_tokens", LongType()),
    StructField("reasoning_tokens", LongType()), StructField("total_tokens", LongType()),
    StructField("ok", BooleanType()), StructField("error", StringType()),
]


def _attempt(client: Client, call: tuple, attempts: int, backoff: float, longest: float) -> tuple:
    for tried in range(1, attempts + 1):
        try:
            r = client(*call)
            total = r.total_tokens or r.prompt_tokens + r.completion_tokens
            return (
                r.text.strip(), r.finish_reason, r.prompt_tokens, r.completion_tokens, r.reasoning_tokens, total, True, ""
            )
        except Transient as error:
            failure = error
            if tried < attempts:
                time.sleep(random.uniform(0, min(longest, backoff * 2**tried)))
        except Exception as error:  # noqa: BLE001 - one bad call must not end the job
            failure = error
            break
    return ("", "", 0, 0, 0, 0, False, f"{type(failure).__name__}: {failure}")


#: Calls that are worth a task of their own.
CALLS_PER_TASK = 32


def shares(rows: int, parallel: int, cores: int) -> tuple[int, int]:
    """Spark tasks and calls in flight per task for so many calls; together at most ``parallel`` in flight."""
    tasks = max(1, min(parallel, cores, -(-rows // CALLS_PER_TASK)))
    return tasks, max(1, parallel // tasks)


def ask(
    tasks: DataFrame, client: Client, parallel: int = 8, attempts: int = 5, backoff: float = 2.0, longest: float = 60.0,
    rows: int | None = None,
) -> DataFrame:
    """Add the reply fields to tasks with columns model, system, prompt and temperature.

    At most ``parallel`` calls are in flight at a time over the whole job: the rows are dealt out to as many
    Spark tasks as ``shares`` says, and each keeps its share of calls going. ``rows`` saves counting them.
    Keys of the tasks identify the rows.
    """
    cores = tasks.sparkSession.sparkContext.defaultParallelism
    dealt, each = shares(tasks.count() if rows is None else rows, parallel, cores)
    schema = StructType([*tasks.schema.fields, *REPLY_FIELDS])
    names = [f.name for f in REPLY_FIELDS]
    if set(names) & set(tasks.columns):
        raise ValueError(f"task columns must not be named like reply fields: {sorted(set(names) & set(tasks.columns))}")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(each) as pool:
            for batch in batches:
                calls = [
                    (m, s or "", p, None if pd.isna(t) else float(t))
                    for m, s, p, t in zip(batch["model"], batch["system"], batch["prompt"], batch["temperature"])
                ]
                rows = list(pool.map(lambda c: _attempt(client, c, attempts, backoff, longest), calls))
                yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return tasks.repartition(dealt).mapInPandas(answer, schema)
