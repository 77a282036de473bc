"""Token stream events: text frames to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

EVENT = "type string, content string, usage string"


def decode_stream_events(bodies: DataFrame) -> DataFrame:
    """``request_id, body`` to ``request_id, seq, type, content, usage``.

    Frames end with a blank line, so an unfinished last frame is not decoded.
    Frames without ``data:`` or with text that is not a JSON object are skipped.
    """
    frames = F.split("body", "\n\n")
    closed = F.slice(frames, 1, F.size(frames) - 1)
    return (
        bodies.select("request_id", F.posexplode(closed).alias("seq", "frame"))
        .withColumn("frame", strip(F.col("frame")))
        .where(F.startswith("frame", F.lit("data:")))
        .withColumn("payload", strip(F.substr("frame", F.lit(6))))
        .where(F.startswith("payload", F.lit("{")))
        .withColumn("event", F.from_json("payload", EVENT))
        .where(F.col("event.type").isNotNull())
        .select("request_id", F.col("seq").cast("bigint").alias("seq"), "event.*")
    )


def frame(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def encode_stream_events(metadata: DataFrame, tokens: DataFrame) -> DataFrame:
    """Frames per request: metadata first, then non-empty tokens, then ``done``.

    ``metadata``: ``request_id`` plus the columns to publish; ``tokens``:
    ``request_id, seq, content``. The order of the rows is ``(part, seq)``.
    """
    fields = [c for c in metadata.columns if c != "request_id"]
    first = metadata.select(
        "request_id",
        F.lit(0).alias("part"),
        F.lit(0).cast("bigint").alias("seq"),
        frame(
            F.to_json(F.struct(F.lit("metadata").alias("type"), "request_id", *fields))
        ).alias("frame"),
    )
    middle = tokens.where(F.col("content") != "").select(
        "request_id",
        F.lit(1).alias("part"),
        F.col("seq").cast("bigint").alias("seq"),
        frame(F.to_json(F.struct(F.lit("token").alias("type"), "content"))).alias("frame"),
    )
    last = metadata.select(
        "request_id",
        F.lit(2).alias("part"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit('data: {"type":"done"}\n\n').alias("frame"),
    )
    return first.unionByName(middle).unionByName(last)
