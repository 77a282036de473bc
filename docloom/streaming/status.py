"""Ingestion status machine, as a batch job and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom import rules

OUTPUT = "document_id string, status string, chunk_count int, error_message string"
STATE = "status string, chunk_count int, error_message string"


def allowed(current: Column, target: Column) -> Column:
    """Whether a document may move from one status to another."""
    hit = F.lit(False)
    for a, b in rules.STATUS_TRANSITIONS:
        hit = hit | ((current == a) & (target == b))
    return hit


def status_machine(registry: DataFrame, events: DataFrame) -> DataFrame:
    """Final status of every registered document after its ordered events.

    ``registry``: ``document_id``; ``events``: ``document_id, ts, seq, status,
    chunk_count, error_message``. A path through the machine has at most two
    accepted events: the first ``processing`` or ``failed`` from the start, and
    the first ``completed`` or ``failed`` after it. Both are minima, so each
    event log shrinks map-side and no log is gathered into one task.
    """
    at = F.struct("ts", "seq")
    payload = F.struct(at.alias("at"), "status", "chunk_count", "error_message")

    def first_step(start: str) -> Column:
        return allowed(F.lit(start), F.col("status"))

    step1 = events.groupBy("document_id").agg(
        F.min(F.when(first_step(rules.STATUS_START), payload)).alias("one")
    )
    step2 = (
        events.join(step1.where("one.status = 'processing'"), "document_id")
        .where((at > F.col("one.at")) & first_step("processing"))
        .groupBy("document_id")
        .agg(F.min(payload).alias("two"))
    )
    joined = (
        registry.select("document_id")
        .join(step1, "document_id", "left")
        .join(step2, "document_id", "left")
    )
    message = lambda step: F.when(
        F.col(f"{step}.error_message") != "", F.col(f"{step}.error_message")
    )
    return joined.select(
        "document_id",
        F.coalesce("two.status", "one.status", F.lit(rules.STATUS_START)).alias("status"),
        F.coalesce("two.chunk_count", "one.chunk_count").alias("chunk_count"),
        F.coalesce(message("two"), message("one")).alias("error_message"),
    )


class StatusProcessor(StatefulProcessor):
    """Keeps one small status row per document, for ``seconds`` after its last event if given."""

    def __init__(self, seconds: int | None = None) -> None:
        self.millis = None if seconds is None else seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", STATE, self.millis)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (rules.STATUS_START, None, None)
        status, count, error = held
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for row in batch.itertuples(index=False):
            if (status, row.status) not in rules.STATUS_TRANSITIONS:
                continue
            status = row.status
            if not pd.isna(row.chunk_count):
                count = int(row.chunk_count)
            if row.error_message:
                error = row.error_message
        self.state.update((status, count, error))
        out = pd.DataFrame(
            {"document_id": [key[0]], "status": [status], "chunk_count": [count],
             "error_message": [error]}
        )
        out["chunk_count"] = out["chunk_count"].astype("Int32")
        yield out

    def close(self) -> None:
        pass


def stream_status(events: DataFrame, seconds: int | None = None) -> DataFrame:
    """Status changes as a stream (RocksDB state store, update mode).

    A document's log arrives spread over micro-batches; only its status row is
    kept between them. With ``seconds`` (a day: ``rules.TASK_TTL_SECONDS``) it is
    dropped that long after the document's last event. Such a stream goes on without
    data, so run it with a time trigger, or with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    return (
        events.select("document_id", "ts", "seq", "status", "chunk_count", "error_message")
        .groupBy("document_id")
        .transformWithStateInPandas(
            statefulProcessor=StatusProcessor(seconds),
            outputStructType=OUTPUT,
            outputMode="Update",
            timeMode="None" if seconds is None else "ProcessingTime",
        )
    )
