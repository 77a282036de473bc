"""Guard jobs over tables of queries, responses and token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import guards as G
from docloom.operators.ordered import concat_ordered


def sanitise_queries(queries: DataFrame, guards: Sequence[G.PreGuard] | None = None) -> DataFrame:
    """Replace ``query`` by its clean form and add ``warnings``."""
    clean, warnings = G.apply_pre(F.col("query"), F.col("domain"), guards)
    return queries.withColumns({"query": clean, "warnings": warnings})


def guard_responses(
    responses: DataFrame, guards: Sequence[G.PostGuard] | None = None
) -> DataFrame:
    """Add ``guarded``: one projection per guard, in order."""
    out = responses.withColumn("guarded", F.col("response"))
    for guard in G.POST_GUARDS if guards is None else guards:
        out = out.withColumn("guarded", guard(F.col("guarded"), F.col("domain")))
    return out


def assemble_answers(events: DataFrame) -> DataFrame:
    """Answer text per request from its token rows, with the usage of its ``done`` row.

    ``events``: ``request_id, seq, type, content, usage``. Requests without any
    token text give no row.
    """
    tokens = events.where((F.col("type") == "token") & (F.col("content") != ""))
    answers = concat_ordered(tokens, ["request_id"], "seq", "content", "")
    done = (
        events.where(F.col("type") == "done")
        .groupBy("request_id")
        .agg(F.max_by("usage", "seq").alias("usage"))
    )
    return answers.join(done, "request_id", "left").withColumnRenamed("content", "answer")


def guard_token_stream(events: DataFrame, domains: DataFrame) -> DataFrame:
    """Token rows passed through, plus what the guards add before and after them.

    ``domains``: ``request_id, domain``. An added notice in front becomes row -1
    and added text at the end the row after the last token. The footer follows
    the text as it was streamed.
    """
    tokens = events.where((F.col("type") == "token") & (F.col("content") != "")).select(
        "request_id", "seq", "content"
    )
    last = tokens.groupBy("request_id").agg(F.max("seq").alias("last_seq"))
    answers = concat_ordered(tokens, ["request_id"], "seq", "content", "")
    guarded = guard_responses(
        answers.join(domains, "request_id").withColumnRenamed("content", "response")
    )
    notice = F.lit(rules.FORWARD_LOOKING_NOTICE)
    has_notice = F.startswith("guarded", notice) & ~F.startswith("response", notice)
    body = F.when(has_notice, F.substring("guarded", len(rules.FORWARD_LOOKING_NOTICE) + 1, 2**31 - 1)).otherwise(F.col("guarded"))
    shared = F.length(F.rtrim("response", F.lit(rules.WHITESPACE)))
    added = guarded.join(last, "request_id").select(
        "request_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit(-1).cast("bigint").alias("seq"),
                    F.when(has_notice, notice).alias("content"),
                ),
                F.struct(
                    (F.col("last_seq") + 1).alias("seq"),
                    F.when(
                        F.length(body) > F.length("response"),
                        F.substring(body, shared + 1, F.length(body)),
                    ).alias("content"),
                ),
            )
        ).alias("row"),
    )
    extra = added.select("request_id", "row.*").where(F.col("content") != "")
    return tokens.unionByName(extra)
