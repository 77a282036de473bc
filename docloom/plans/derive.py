"""Inputs of the registered queries, derived from the given tables only.

Each function reads whole tables; text is decorated, never cut, so that the
structural rules (headers, lists, tables, footnotes, doses) meet real cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import spread


#: An entity pattern that holds the boundary after sentences that end in a vowel.
HELD_BOUNDARY = "[aeiou][.] [A-Z]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of_lang(lang: Column) -> Column:
    return F.when(lang == "en", "financial").when(lang == "de", "medical").otherwise("general")


def decorate(line: Column, i: Column) -> Column:
    """Turn the i-th line of a document into one of ten paragraph shapes."""
    lit = F.lit
    rows = F.array_join(
        F.transform(
            F.split(line, r"\. "),
            lambda s: F.concat(lit("| "), s, lit(" | "), F.length(s).cast("string"), lit(" |")),
        ),
        "\n",
    )
    shapes = [
        F.concat(lit("ASSESSMENT AND PLAN:\n\n"), line),
        F.concat(lit("- "), F.replace(line, lit(". "), lit(".\n- "))),
        F.concat(lit("Item 7A. Market Risk\n\n"), line),
        F.concat(lit("| term | chars |\n| --- | :---: |\n"), rows),
        F.concat(lit("(1) "), line),
        line,
        F.concat(
            lit("## Medications & Dosage\n\n- Metformin 500 mg twice daily\n- "),
            line,
            lit("\n• aspirin 81 mg"),
        ),
        F.concat(
            lit("HbA1c 7.2% and eGFR 45 mL/min were noted. "),
            line,
            lit(" Dr. Smith saw No. 5. Inc. Reports follow."),
        ),
        F.concat(lit("1. Chief Complaint\n\n"), line),
        F.concat(line, lit(" Type 2 Diabetes Mellitus (E11.9), BRCA1 and hba1c 7.2% again.")),
    ]
    out = F.when(i % 10 == 0, shapes[0])
    for n, shape in enumerate(shapes[1:-1], start=1):
        out = out.when(i % 10 == n, shape)
    return out.otherwise(shapes[-1])


def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, domain, source, content``: every line of every document, decorated."""
    lines = F.transform(F.split("text", "\n"), decorate)
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        domain_of_lang(F.col("lang")).alias("domain"),
        "source",
        F.array_join(lines, "\n\n").alias("content"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        domain_of_lang(F.col("lang")).alias("domain"),
        "source",
        F.col("text").alias("content"),
    )


def searchable_documents(
    spark: SparkSession,
    sf_dir: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Every document as one chunk with filter columns from ``labels``.

    ``prepare`` sees the rows before they are shuffled to their labels: it encodes
    and drops the text, or keeps the texts of some chunks only.
    """
    rows = prepare(
        raw_documents(spark, sf_dir).select(
            "doc_id",
            F.col("document_id").alias("chunk_id"),
            F.concat(F.lit("set-"), F.col("source")).alias("document_id"),
            "domain",
            "source",
            F.col("content").alias("text"),
        )
    )
    return (
        rows.join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(
            *rows.columns,
            F.when(F.col("quality") == 1, "public")
            .when(F.col("quality") == 0, "internal")
            .otherwise("restricted")
            .alias("acl"),
            F.when(F.col("toxic") == 1, "table").otherwise("narrative").alias("chunk_type"),
        )
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query with one of five filter shapes."""
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs])
    shape = F.col("item_id") % 5
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.when(shape == 0, "financial").when(shape == 4, "").alias("domain"),
        F.when(shape == 1, F.concat(F.lit("set-src"), (F.col("item_id") % 20).cast("string"))).alias(
            "document_id"
        ),
        F.when(shape == 2, strings("public", "internal"))
        .when(shape == 4, F.expr("cast(array() as array<string>)"))
        .alias("acl"),
        F.when(shape == 3, strings("table")).alias("chunk_types"),
        F.when(shape == 4, F.lit(0)).when(shape == 3, F.lit(7)).alias("top_k"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat session per conversation; owner, domain and activity follow from its messages."""
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id"))
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.sum(F.length("text")).alias("chars"),
            F.max((F.col("role") == "system").cast("int")).alias("has_system"),
        )
        .select(
            F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
            F.concat(F.lit("u"), F.col("n_messages").cast("string")).alias("user_id"),
            F.when(F.col("chars") % 3 == 0, "financial")
            .when(F.col("chars") % 3 == 1, "medical")
            .otherwise("general")
            .alias("domain"),
            F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
            (F.col("has_system") == 1).alias("is_archived"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("chars")).alias("updated_at"),
            F.expr("cast(array() as array<string>)").alias("pinned"),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a model response; some carry doses, topics, outlooks or nothing."""
    extra = (
        F.when(F.col("turn") % 5 == 0, " Take 20 mg daily for anxiety and depression.")
        .when(F.col("turn") % 5 == 1, " We expect the outlook to improve.")
        .when(F.col("turn") % 5 == 2, " 5 units were ordered.  \n")
        .otherwise("")
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id"), F.col("turn")).alias("response_id"),
        F.when(F.col("conv_id") % 3 == 0, "financial")
        .when(F.col("conv_id") % 3 == 1, "medical")
        .otherwise("general")
        .alias("domain"),
        F.when(F.col("role") == "system", F.lit(" \n")).otherwise(
            F.concat(F.col("text"), extra)
        ).alias("response"),
    )


def stream_bodies(
    spark: SparkSession, sf_dir: str, conversations: DataFrame | None = None
) -> DataFrame:
    """Every message as the body of a token stream: one token event per sentence."""
    event = lambda kind, content: F.concat(
        F.lit("data: "),
        F.to_json(F.struct(F.lit(kind).alias("type"), content.alias("content"))),
        F.lit("\n\n"),
    )
    pieces = F.transform(F.split("text", r"(?<=\. )"), lambda s: event("token", s))
    usage = F.concat(
        F.lit('data: {"type":"done","usage":"'), F.length("text").cast("string"), F.lit('"}\n\n')
    )
    talk = table(spark, sf_dir, "conversations") if conversations is None else conversations
    return talk.select(
        F.concat_ws(":", F.col("conv_id"), F.col("turn")).alias("request_id"),
        F.concat(
            F.lit(': keep-alive\n\ndata: {"type":"metadata","content":"'),
            F.col("role"),
            F.lit('"}\n\n'),
            F.array_join(pieces, ""),
            F.lit("data: [DONE]\n\ndata: not json\n\n"),
            usage,
            F.lit('data: {"type":"token","content":"cut'),
        ).alias("body"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registry rows."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("document_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "financial")
        .when(F.col("o_orderpriority") == "5-LOW", "medical")
        .otherwise("general")
        .alias("domain"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias(
            "original_name"
        ),
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "completed")
        .otherwise("processing")
        .alias("status"),
        F.when(F.col("o_orderstatus") == "O", F.floor(F.col("o_totalprice") / 10000)).alias(
            "chunk_count"
        ),
        F.when(F.col("o_totalprice") > 300000, "parser error").alias("error_message"),
        (F.col("o_orderpriority") == "3-MEDIUM").alias("is_deleted"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users."""
    segment = F.col("c_mktsegment")
    arrays = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.when(segment == "BUILDING", "admin")
        .when(segment == "MACHINERY", "viewer")
        .otherwise("user")
        .alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(segment == "FURNITURE", arrays("financial", "general"))
        .when(segment == "MACHINERY", arrays("medical"))
        .otherwise(arrays("general"))
        .alias("allowed_domains"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("ip"),
        F.when(F.col("event_type") == "view", "/health").otherwise("/query").alias("path"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a status log per user id."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("document_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "pending")
        .when(kind == "view", "processing")
        .when(kind == "purchase", "completed")
        .when((kind == "error") & (F.col("value") > 60), "failed")
        .otherwise("completed")
        .alias("status"),
        F.when(kind == "purchase", F.floor("value").cast("int")).alias("chunk_count"),
        F.when(kind == "error", F.col("props")).alias("error_message"),
    )
