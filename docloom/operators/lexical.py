"""BM25 over chunks, with collection statistics that are kept and updated by deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import vectors as V
from docloom.functions.arrays import let
from docloom.operators.retrieval import sparse_topk

#: Saturation of repeated terms, and how much the length of a chunk counts.
K1, B = 1.2, 0.75


def term_statistics(chunks: DataFrame, text: str = "text", removed: bool = False) -> DataFrame:
    """``token, chunks, tokens``: chunks with the token and its occurrences; all of them under NULL.

    A chunk that is NULL or has no word counts as one of length 0. ``removed`` gives the delta of
    chunks that leave the collection. Counted map-side; one row per token moves from a task.
    """
    counts = F.coalesce(V.term_weights(F.col(text), lambda n: n), F.array())
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["weight"])
    whole = F.array(F.struct(F.lit(None).cast("string").alias("token"), total.alias("weight")))
    sign = -1 if removed else 1
    return (
        chunks.select(F.inline(F.concat(whole, counts)))
        .groupBy("token")
        .agg((sign * F.count("*")).alias("chunks"), (sign * F.sum("weight")).cast("bigint").alias("tokens"))
    )


def merge_statistics(*parts: DataFrame) -> DataFrame:
    """Statistics of a collection and its deltas; tokens that no chunk has any more are left out."""
    every = reduce(DataFrame.unionByName, parts).groupBy("token")
    return every.agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).where("chunks > 0")


def bm25_topk(
    chunks: DataFrame,
    queries: DataFrame,
    statistics: DataFrame,
    k: int = rules.TOP_K_SPARSE,
    text: str = "text",
    query: str = "query",
) -> DataFrame:
    """Best ``k`` chunks per query by BM25; a token asked for twice counts twice.

    The rarity of a token is part of the query's weights and its saturation of the chunk's, so
    the score is the sum of products that sparse search computes, under the same filters. Only
    tokens of the queries meet the statistics, and one row of them reaches the driver. Ids of queries
    are unique; a query without a token of the collection has no hits.
    """
    whole = statistics.where("token is null").first()
    n = whole["chunks"] if whole else 0
    average = (whole["tokens"] / n if n else 0.0) or 1.0

    def saturated(counts):
        length = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["weight"])
        return let(
            F.lit(K1) * (1 - B + B * length / F.lit(average)),
            lambda damp: F.transform(
                counts,
                lambda c: F.struct(
                    c["token"].alias("token"),
                    (c["weight"] * (K1 + 1) / (c["weight"] + damp)).alias("weight"),
                ),
            ),
        )

    weighed = chunks.withColumn("terms", let(V.term_weights(F.col(text), lambda c: c), saturated))
    rarity = F.log1p((F.lit(n) - F.col("chunks") + 0.5) / (F.col("chunks") + 0.5))
    asked = queries.select("query_id", F.inline(V.term_weights(F.col(query), lambda c: c)))
    terms = (
        asked.join(statistics.where("token is not null"), "token")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("token", (F.col("weight") * rarity).alias("weight"))).alias("terms"))
    )
    return sparse_topk(weighed, queries.drop("terms").join(terms, "query_id"), k)
