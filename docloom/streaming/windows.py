"""Windowed streams: rate limits, de-duplication and answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom import rules
from docloom.operators.guarding import guard_responses


def as_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times become instants; watermarks need them."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def stream_rate_limit(
    requests: DataFrame, window_seconds: int = 60, max_requests: int = 60, late: str = "5 minutes"
) -> DataFrame:
    """Callers over the limit per tumbling window, with counts; health checks are exempt.

    The count is combined map-side, so one very busy caller is one state row.
    """
    counted = (
        as_event_time(requests)
        .where(F.coalesce(F.col("path") != rules.RATE_LIMIT_EXEMPT_PATH, F.lit(True)))
        .withColumn("caller", F.coalesce(F.col("user_id").cast("string"), F.col("ip")))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", f"{window_seconds} seconds"), "caller")
        .agg(F.count(F.lit(1)).alias("n_requests"))
    )
    return counted.where(F.col("n_requests") > max_requests).select(
        "caller",
        F.col("window.start").alias("window_start"),
        "n_requests",
        (F.col("n_requests") - max_requests).alias("n_limited"),
        F.lit(window_seconds).alias("retry_after"),
    )


def dedup_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """First delivery of every event; repeats inside the lateness bound are dropped."""
    return as_event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


ANSWER = "request_id string, answer string, usage string"


class AnswerProcessor(StatefulProcessor):
    """Holds the tokens of a running answer until its ``done`` row closes it."""

    def __init__(self, seconds: int | None = None) -> None:
        self.millis = None if seconds is None else seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getListState("tokens", "seq long, content string", self.millis)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        text = batch[(batch["type"] == "token") & batch["content"].fillna("").ne("")]
        if len(text):
            self.tokens.appendList([(int(s), c) for s, c in zip(text["seq"], text["content"])])
        done = batch[batch["type"] == "done"]
        if not len(done):
            return
        held = sorted(self.tokens.get()) if self.tokens.exists() else []
        self.tokens.clear()
        if held:
            usage = done.sort_values("seq")["usage"].iloc[-1]
            yield pd.DataFrame(
                {"request_id": [key[0]], "answer": ["".join(c for _, c in held)], "usage": [usage]}
            )

    def close(self) -> None:
        pass


def stream_answers(events: DataFrame, seconds: int | None = None) -> DataFrame:
    """Answer and usage per request, as soon as its ``done`` row has come.

    ``events``: ``request_id, seq, type, content, usage``. A request without token
    text gives no row, like in the batch form ``assemble_answers``. With ``seconds``,
    tokens of a request that is never closed are dropped after that time; for the
    trigger of such a stream see ``stream_status``.
    """
    return (
        events.select("request_id", "seq", "type", "content", "usage")
        .where(F.col("type").isin("token", "done"))
        .groupBy("request_id")
        .transformWithStateInPandas(
            statefulProcessor=AnswerProcessor(seconds),
            outputStructType=ANSWER,
            outputMode="Append",
            timeMode="None" if seconds is None else "ProcessingTime",
        )
    )


def stream_guarded_answers(
    events: DataFrame, domains: DataFrame, seconds: int | None = None
) -> DataFrame:
    """The same with ``domain`` and ``guarded``; ``domains`` is a static ``request_id, domain``."""
    named = stream_answers(events, seconds).join(domains, "request_id")
    return guard_responses(named.withColumnRenamed("answer", "response")).withColumnRenamed(
        "response", "answer"
    )
