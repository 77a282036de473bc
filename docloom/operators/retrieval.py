"""Ranked retrieval: dense, sparse, fused, reranked and end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.functions.arrays import let
from docloom.functions.domains import KNOWN
from docloom.operators.encoding import add_vectors_by_domain
from docloom.operators.scoring import closest_before, score_topk, with_list_filters
from docloom.session import materialise, small_batches


def dense_topk(
    chunks: DataFrame, queries: DataFrame, k: int = rules.TOP_K_DENSE, **limits
) -> DataFrame:
    """Best ``k`` chunks per query by cosine of unit vectors, under the query's filters."""
    return score_topk(chunks, queries, ("dense",), k, **limits)


def sparse_topk(
    chunks: DataFrame, queries: DataFrame, k: int = rules.TOP_K_SPARSE, **limits
) -> DataFrame:
    """Best ``k`` chunks per query by the sum of weight products over shared tokens."""
    return score_topk(chunks, queries, ("sparse",), k, **limits)


def filtered_candidates(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Number of chunks each query may see.

    Filters only look at four columns. Queries bound to a document join on it;
    the others are answered from a small roll-up by domain, access tag and type.
    An absent or empty filter adds no condition.
    """
    queries = with_list_filters(queries)
    free = lambda c: F.col(c).isNull() | (F.col(c) == "")
    open_list = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    facets = chunks.groupBy("document_id", "domain", "acl", "chunk_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    asked = queries.select(
        "query_id",
        F.col("domain").alias("q_domain"),
        F.col("document_id").alias("q_document"),
        F.col("acl").alias("q_acl"),
        F.col("chunk_types").alias("q_types"),
    )
    visible = (
        (free("q_domain") | (F.col("domain") == F.col("q_domain")))
        & (open_list("q_acl") | F.array_contains("q_acl", F.col("acl")))
        & (open_list("q_types") | F.array_contains("q_types", F.col("chunk_type")))
    )
    by_document = asked.where(~free("q_document")).join(
        facets, (F.col("q_document") == F.col("document_id")) & visible
    )
    # Each facet counts under its domain and, for queries open to all domains, under none.
    rollup = (
        facets.withColumn("facet", F.explode(F.array(F.struct("domain"), F.struct(F.lit("").alias("domain")))))
        .groupBy(F.col("facet.domain").alias("key"), "acl", "chunk_type")
        .agg(F.sum("n").alias("n"))
        .withColumn("domain", F.col("key"))
    )
    each = asked.where(free("q_document")).withColumn("wanted", F.coalesce("q_domain", F.lit("")))
    by_facet = each.join(rollup, (F.col("wanted") == F.col("key")) & visible)
    found = by_document.select("query_id", "n").unionByName(by_facet.select("query_id", "n"))
    counts = found.groupBy("query_id").agg(F.sum("n").alias("n_candidates"))
    return queries.select("query_id").join(counts, "query_id", "left").fillna(0, ["n_candidates"])


# --- near duplicates ----------------------------------------------------------


def near_dup_chunks(existing: DataFrame, incoming: DataFrame, threshold: float) -> DataFrame:
    """For every incoming chunk the closest existing one at or above ``threshold``.

    One row per incoming chunk at most, so a large group of copies stays linear.
    """
    hits = score_topk(
        existing,
        incoming.select(F.col("chunk_id").alias("query_id"), "dense"),
        ("dense",),
        1,
        {"threshold": threshold},
    )
    return _as_matches(hits)


def _as_matches(hits: DataFrame) -> DataFrame:
    return hits.select(
        F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("duplicate_of"), "score"
    )


def near_dup_within(chunks: DataFrame, threshold: float) -> DataFrame:
    """The same inside one table: only chunks with a smaller id count as existing.

    Equal vectors are folded map-side into their smallest id first, so copies are
    compared once, however many there are. A copy then takes its representative,
    or the match of its representative when that one is just as close.
    """
    small_batches(chunks.sparkSession)
    # Written once: the search and both ways to look at copies read it.
    coded = materialise(
        chunks.select("chunk_id", "dense").withColumns(
            {"_a": F.xxhash64("dense"), "_b": F.hash("dense")}
        ),
        "coded",
    )
    first = coded.groupBy("_a", "_b").agg(F.min("chunk_id").alias("_first"))
    distinct = coded.join(
        first.select(F.col("_first").alias("chunk_id")), "chunk_id", "left_semi"
    ).select("chunk_id", "dense")
    found = _as_matches(closest_before(distinct, threshold))
    copies = (
        coded.select("chunk_id", "_a", "_b")
        .join(first, ["_a", "_b"])
        .where(F.col("chunk_id") != F.col("_first"))
    )
    closer = found.where(F.col("score") >= 1.0).select(
        F.col("chunk_id").alias("_first"), F.col("duplicate_of").alias("_closer")
    )
    folded = copies.join(closer, "_first", "left").select(
        "chunk_id",
        F.coalesce("_closer", "_first").alias("duplicate_of"),
        F.lit(1.0).alias("score"),
    )
    return found.unionByName(folded)


# --- fusion and reranking ---------------------------------------------------------


def rrf_fuse(
    hits: DataFrame,
    stages: tuple[str, ...] = ("dense", "sparse"),
    k: int = rules.RRF_K,
    top_k: int | None = rules.TOP_K_FUSED,
) -> DataFrame:
    """Reciprocal rank fusion of any number of lists.

    ``hits``: ``query_id, chunk_id, stage, rank``. Ties keep first-seen order:
    list by list in the order of ``stages``, then by rank.
    """
    numbers = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    lists = hits.where(F.col("stage").isin(*stages)).withColumn("list_no", numbers[F.col("stage")])
    # A rank of 0 or less counts as the place after the end of its list. A list holds
    # at most top-k rows, and the lists arrive partitioned this way from the ranking.
    length = F.count(F.lit(1)).over(Window.partitionBy("query_id", "stage"))
    placed = lists.withColumn(
        "_place", F.when(F.col("rank") > 0, F.col("rank")).otherwise(length + 1)
    )
    carried = [c for c in ("document_id",) if c in hits.columns]
    fused = placed.groupBy("query_id", "chunk_id").agg(
        *[F.min(c).alias(c) for c in carried],
        F.round(F.sum(1.0 / (F.lit(k) + F.col("_place"))), 12).alias("_sum"),
        F.min(F.struct("list_no", "rank")).alias("_seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("_sum"), "_seen", "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select(
        "query_id", "chunk_id", *carried, F.lit("rrf").alias("stage"),
        F.round("_sum", 6).alias("score"), "rank",
    )


def overlap_score(query: Column, passage: Column) -> Column:
    """Default pair scorer: share of the distinct query tokens found in the passage."""
    return let(
        F.array_distinct(T.tokens(query)),
        lambda wanted: F.when(
            F.size(wanted) > 0,
            F.size(F.array_intersect(wanted, T.tokens(passage))) / F.size(wanted),
        ).otherwise(F.lit(0.0)),
    )


def rerank_topk(
    candidates: DataFrame,
    k: int = rules.TOP_K_RERANKED,
    scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """Score each (query, passage) and keep the best ``k``; ties keep the incoming rank.

    ``candidates``: ``query_id, chunk_id, query, text, rank``. ``scorer`` may be
    a pandas UDF around any pair model.
    """
    scored = candidates.withColumn("score", F.round(scorer(F.col("query"), F.col("text")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "chunk_id")
    return (
        scored.withColumn("_new", F.row_number().over(order))
        .where(F.col("_new") <= (k or rules.TOP_K_RERANKED))
        .drop("rank")
        .withColumnRenamed("_new", "rank")
        .withColumn("stage", F.lit("reranked"))
    )


def stage_totals(hits: DataFrame) -> DataFrame:
    """Distinct chunks per query and stage."""
    return hits.groupBy("query_id", "stage").agg(F.countDistinct("chunk_id").alias("total"))


def build_sources(kept: DataFrame) -> DataFrame:
    """The best-ranked chunk of every document of a query, in rank order."""
    first = Window.partitionBy("query_id", "document_id").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        kept.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .drop("_n")
        .withColumn("source_no", F.row_number().over(order))
    )


def hybrid_hits(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Dense and sparse winners from a single pass over the chunk table."""
    carry = "document_id" if "document_id" in chunks.columns else None
    return score_topk(chunks, queries, ("dense", "sparse"), rules.TOP_K_DENSE, carry=carry)


def hybrid_search(
    chunks: DataFrame,
    queries: DataFrame,
    texts: Callable[[DataFrame], DataFrame] | None = None,
    scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """Dense and sparse search, fusion and reranking for a table of queries.

    Each chunk is scored once for both legs. The fused hits (at most 40 rows per
    query) are written down, because two steps need them: ``texts(documents)``
    returns the chunk rows of the documents that were hit, and those are joined
    back. By default the chunk table itself is filtered by those documents.
    """
    fused = materialise(rrf_fuse(hybrid_hits(chunks, queries)), "fused")
    hit = fused.select("document_id").distinct()
    rows = texts(hit) if texts else chunks.join(hit, "document_id", "left_semi")
    candidates = (
        fused.drop("stage", "score", "document_id")
        .join(rows, "chunk_id")
        .join(queries.select("query_id", "query").distinct(), "query_id")
    )
    return rerank_topk(candidates, scorer=scorer)


def semantic_cache_lookup(
    cache: DataFrame,
    queries: DataFrame,
    now: Column,
    threshold: float = rules.SEMANTIC_CACHE_THRESHOLD,
    ttl_seconds: int = rules.SEMANTIC_CACHE_TTL_SECONDS,
) -> DataFrame:
    """The most similar cached question that is fresh and close enough, per query."""
    fresh = cache.where(F.col("created_at") > now - F.expr(f"interval {ttl_seconds} seconds"))
    return score_topk(fresh, queries, ("dense",), 1, {"threshold": threshold}).drop(
        "stage", "rank"
    )


def with_vectors_by_domain(queries: DataFrame, text: str = "query") -> DataFrame:
    """A row per query and domain it may search, encoded the way that domain's chunks are.

    A query without a domain searches all of them. Ranks are taken over all rows of
    a query id, so the best chunks of every domain meet in one list.
    """
    open_ = F.col("domain").isNull() | (F.col("domain") == "")
    each = F.when(open_, F.array(*[F.lit(d) for d in KNOWN])).otherwise(F.array("domain"))
    return add_vectors_by_domain(queries.withColumn("domain", F.explode(each)), text)


def with_vectors(queries: DataFrame, domain: str, text: str = "query") -> DataFrame:
    """Encode a query table the way its chunks are encoded."""
    return queries.withColumn("dense", V.encode_dense(F.col(text), domain)).withColumn(
        "terms", V.term_weights(F.col(text))
    )
