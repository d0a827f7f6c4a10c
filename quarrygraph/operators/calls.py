"""Calls of an outside model for a column of prompts: several in flight in each task, each with a deadline, errors as data."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Fixed value: seconds that a call may take.
DEADLINE = 120.0
#: Calls in flight in a task, and attempts of a call that fails.
IN_FLIGHT, ATTEMPTS = 8, 2


def with_replies(
    rows: DataFrame, prompt: Column, connect: Callable[[], Callable[[str], str]], in_flight: int = IN_FLIGHT, deadline: float = DEADLINE, attempts: int = ATTEMPTS, reply: str = "reply", error: str = "error",
) -> DataFrame:
    """``rows`` with ``reply``, the model's answer to the prompt, ``error``, why there is none, ``attempts`` and ``seconds``.

    ``connect`` is called once in each task and gives the client, a function of the prompt that threads can call at once. At most
    ``in_flight`` calls run in a task at a time, and as many rows are held; rows leave in their order. A call that raises is tried
    ``attempts`` times in all; one that has no answer ``deadline`` seconds after it was handed to a thread is given up (``timed out``)
    and its thread left to end by itself. Neither fails the task: the row goes on with its error. A null prompt isn't sent. A task that is run again
    calls again. An empty table makes no calls; columns of ``rows`` with the new names give way."""
    rows = rows.drop(reply, error, "attempts", "seconds")
    fields = [StructField(f.name, f.dataType) for f in rows.schema]
    added = [StructField(reply, StringType()), StructField(error, StringType()), StructField("attempts", IntegerType()), StructField("seconds", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, late = None, 0
        pool = ThreadPoolExecutor(in_flight)

        def call(text: str, until: float) -> tuple[str | None, str | None, int]:
            problem, n = None, 0
            while n < attempts and time.monotonic() < until:
                n += 1
                try:
                    return client(text), None, n
                except Exception as e:  # noqa: BLE001 whatever the client raises is data here
                    problem = f"{type(e).__name__}: {e}"
            return None, problem or "timed out", n

        def finished(began: float, future: Future | None) -> tuple:
            nonlocal pool, late
            if future is None:
                return None, "no prompt", 0, 0.0
            try:
                found = future.result(max(0.0, began + deadline - time.monotonic()))
            except Late:
                found = None, "timed out", 1
                if not future.cancel():
                    late += 1
                if late >= in_flight:  # all threads hang: others take their place
                    pool.shutdown(wait=False, cancel_futures=False)
                    pool, late = ThreadPoolExecutor(in_flight), 0
            return *found, time.monotonic() - began

        try:
            for batch in batches:
                waiting: deque[tuple[float, Future | None]] = deque()
                done = []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    if client is None:
                        client = connect()
                    if len(waiting) >= in_flight:
                        done.append(finished(*waiting.popleft()))
                    began = time.monotonic()
                    waiting.append((began, None if text is None else pool.submit(call, text, began + deadline)))
                done += [finished(*x) for x in waiting]
                columns = list(zip(*done, strict=True)) or [()] * 4
                kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[:-1], *(f.name for f in added)])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return rows.select("*", prompt.alias("_prompt")).mapInArrow(run, StructType([*fields, *added]))


def or_fallback(reply: Column, error: Column, fallback: Column) -> Column:
    """The reply, or what stands in for it where the call failed or said nothing."""
    return F.when(error.isNull() & (F.trim(F.coalesce(reply, F.lit(""))) != ""), reply).otherwise(fallback)
