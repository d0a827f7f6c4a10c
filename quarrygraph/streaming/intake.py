"""Error intake as a stream, and the bounded retry machine over a status column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators.triage import classified, route, trace_fields
from quarrygraph.sources.shared import materialize

#: Fixed value: retrievals of one report.
RETRIES = 3


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the Parquet table ``name`` in ``folder``, be it one file or a folder of files that grows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def error_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports from the JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def triaged(reports: DataFrame, message: str = "error_message", trace: str = "stack_trace") -> DataFrame:
    """Reports with trace fields, class and route: for batches and streams alike."""
    fields = trace_fields(F.coalesce(F.col(trace), F.lit("")))
    return reports.withColumns(fields).withColumn("classification", classified(F.col(message))).withColumn("route", route(F.col("classification")))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that has arrived so far, batch by batch; a restart goes on after the last finished batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """An extension: counts in tumbling windows, with a watermark for late rows."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


#: The states' table of :func:`retry_states`.
STATES = "retries int, status string, action string"
#: Where an event without a time stands: behind those that have one.
_NEVER = (1 << 63) - 1


def retry_states(events: DataFrame, key: str = "event_id", most: int = RETRIES, limit: str = "1 hour") -> DataFrame:
    """The retry machine on a stream: (key, retries, status, action) of each report once it has ended.

    ``events``: (key, kind, passed, at). ``report`` opens one, ``ticket`` ends it as ``similar_ticket`` without any retrieval, ``attempt`` is
    the result of one retrieval: the first that passed ends the report as ``fixed``, the ``most``-th that didn't as ``gave_up``. A report that
    hears of nothing until the watermark is ``limit`` past its last event ends as ``timed_out``, with the retrievals it has had. What comes
    for a report that has ended is left out. Each report's state is two numbers in Spark's state store, so a query that is
    stopped goes on from its checkpoint; ended reports keep theirs. The events of a batch are taken by time, then reports before tickets and attempts.
    Rows with a null key or kind, or an unknown kind, are left out. ``at`` must have a watermark."""
    import pandas as pd

    kind_of_key = events.schema[key].dataType.simpleString()
    wait = pd.Timedelta(limit)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        retries, ended = state.get if state.exists else (0, False)
        status = None
        if state.hasTimedOut:
            status = None if ended else "timed_out"
        else:
            rows = sorted((x for batch in batches for x in zip(batch["micros"].tolist(), batch["what"].tolist(), strict=True)), key=lambda x: (x[0], abs(x[1])))
            for _, what in rows:
                if ended or status:
                    break
                if what == 2:
                    status = "similar_ticket"
                elif what:
                    retries += 1
                    status = "fixed" if what > 0 else "gave_up" if retries >= most else None
            if not (ended or status):
                last = max((x // 1000 for x, _ in rows if x < _NEVER), default=state.getCurrentWatermarkMs())
                state.setTimeoutTimestamp(max(last + int(wait.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        state.update((retries, ended or status is not None))
        if status:
            yield pd.DataFrame({key: [keys[0]], "retries": [retries], "status": [status], "action": ["create_ticket"]})

    # two numbers of each event, so that a report costs no pandas operations: 0 a report, 1 and -1 attempts that passed and didn't, 2 a ticket
    what = F.when(F.col("kind") == "report", 0).when(F.col("kind") == "ticket", 2).when(F.col("passed"), 1).otherwise(-1)
    known = events.where(F.col(key).isNotNull() & F.col("kind").isin("report", "ticket", "attempt")).select(key, what.alias("what"), F.coalesce(F.unix_micros("at"), F.lit(_NEVER)).alias("micros"), "at")
    return known.groupBy(key).applyInPandasWithState(step, f"{key} {kind_of_key}, {STATES}", "retries int, ended boolean", "append", "EventTimeTimeout")


def retry(reports: DataFrame, has_ticket: str, attempt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The states of reports: those with a similar ticket end in a ticket at once; the others are retrieved and tested by
    ``attempt`` (which adds a boolean ``passed``) until they pass or have had ``RETRIES`` retrievals, then end in a ticket too."""
    done = reports.where(F.col(has_ticket)).withColumns({"retries": F.lit(0), "status": F.lit("similar_ticket")})
    waiting = reports.where(~F.col(has_ticket)).withColumn("retries", F.lit(0))
    for turn in range(1, RETRIES + 1):
        tried = materialize(attempt(waiting.withColumn("retries", F.lit(turn))), "attempt")
        done = done.unionByName(tried.where("passed").drop("passed").withColumn("status", F.lit("fixed")))
        waiting = tried.where("not passed").drop("passed")
    return done.unionByName(waiting.withColumn("status", F.lit("gave_up"))).withColumn("action", F.lit("create_ticket"))
