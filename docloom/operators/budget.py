"""Fitting ranked chunks to the model's context window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.text import count_tokens


def chunk_budget(
    system_tokens: Column,
    query_tokens: Column,
    n_ctx: int = rules.CONTEXT_TOKENS,
    answer_tokens: int = rules.ANSWER_TOKENS,
    extra_reserve: int = 0,
) -> Column:
    """Tokens left for chunks; may be zero or negative."""
    fixed = system_tokens + query_tokens + F.lit(answer_tokens + extra_reserve + rules.SCAFFOLD_TOKENS)
    return F.lit(n_ctx) - fixed


def fit_budget(hits: DataFrame, n_ctx: int = rules.CONTEXT_TOKENS,
               answer_tokens: int = rules.ANSWER_TOKENS, extra_reserve: int = 0) -> DataFrame:
    """Mark the chunks that fit, in rank order, and add the counters.

    ``hits``: ``query_id, rank, chunk_tokens, system_tokens, query_tokens``. Every
    chunk has at least one token, so running sums rise strictly and the first
    chunk that does not fit drops itself and all after it.
    """
    left = chunk_budget(
        F.col("system_tokens"), F.col("query_tokens"), n_ctx, answer_tokens, extra_reserve
    )
    ranked = Window.partitionBy("query_id").orderBy("rank")
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fixed = F.lit(n_ctx) - F.col("_left")
    return (
        hits.withColumn("_left", left)
        .withColumn("running_tokens", F.sum("chunk_tokens").over(running))
        .withColumn("kept", F.col("running_tokens") <= F.col("_left"))
        .withColumn(
            "tokens_chunks",
            F.coalesce(F.sum(F.when(F.col("kept"), F.col("chunk_tokens"))).over(whole), F.lit(0)),
        )
        .withColumn("truncated", ~F.min("kept").over(whole))
        .withColumn("budget_tokens", F.greatest(F.col("_left"), F.lit(0)))
        .withColumn("tokens_reserved", F.lit(answer_tokens + extra_reserve).cast("bigint"))
        .withColumn("tokens_total", fixed + F.col("tokens_chunks"))
        .withColumn("utilisation", F.round(F.col("tokens_total") / F.lit(max(1, n_ctx)), 6))
        .drop("_left")
    )


def estimate_tokens(hits: DataFrame, answer_tokens: int = rules.ANSWER_TOKENS) -> DataFrame:
    """Prompt estimate per query without fitting; ``system_tokens`` and
    ``query_tokens`` are constant per query."""
    return hits.groupBy("query_id").agg(
        (
            F.max("system_tokens")
            + F.max("query_tokens")
            + F.sum("chunk_tokens")
            + F.lit(rules.SCAFFOLD_TOKENS + answer_tokens)
        ).alias("estimated_tokens")
    )


def with_token_counts(hits: DataFrame, system_prompt: Column, query: str = "query",
                      text: str = "text") -> DataFrame:
    return (
        hits.withColumn("chunk_tokens", count_tokens(F.col(text)))
        .withColumn("query_tokens", count_tokens(F.col(query)))
        .withColumn("system_tokens", count_tokens(system_prompt))
    )
