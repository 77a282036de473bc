"""Context blocks, prompts, fallback answers and per-request metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.domains import KNOWN
from docloom.functions.guards import asks_diagnosis
from docloom.functions.text import strip


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values[:-1]], values[-1])


def mask_ids(kept: DataFrame) -> DataFrame:
    """Number the kept chunks of a query and hide their document ids."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("position", F.row_number().over(order)).withColumn(
        "document_id", F.concat(F.lit("Document "), F.col("position").cast("string"))
    )


def _layout(domain: str, values: list[Column], text: Column) -> Column:
    """Labelled lines, a blank line and the text."""
    labels = rules.CONTEXT_LABELS[domain]
    lines = [F.concat(F.lit(labels[0]), values[0], F.lit("]"))]
    lines += [F.concat(F.lit(lab), val) for lab, val in zip(labels[1:], values[1:], strict=True)]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), text, F.lit("\n"))


def general_block() -> Column:
    return _layout("general", [_position(), _source(), _section()], strip(F.col("text")))


def financial_block() -> Column:
    rows = F.when(
        F.col("row_range") != "", F.concat(F.lit(" (rows "), F.col("row_range"), F.lit(")"))
    )
    before, after = rules.TABLE_HINT.split("{rows}")
    hint = F.concat(F.lit(before), F.coalesce(rows, F.lit("")), F.lit(after))
    body = F.when(F.col("chunk_type") == "table", hint).otherwise(F.lit(""))
    values = [
        _position(),
        _source(),
        _section(),
        _first(F.col("filing_date"), F.coalesce("date", F.lit(rules.NOT_AVAILABLE))),
        F.col("chunk_type"),
        _score(),
    ]
    return _layout("financial", values, F.concat(body, strip(F.col("text"))))


def medical_block() -> Column:
    names = F.array_join("entities", ", ")
    body = F.when(F.col("chunk_type") == "medication", rules.MEDICATION_HINT).otherwise("")
    values = [
        _position(),
        _source(),
        _section(),
        _first(F.col("publication_date"), F.coalesce("date", F.lit(rules.NOT_AVAILABLE))),
        F.col("chunk_type"),
        _first(names, F.lit(rules.NO_ENTITIES)),
        _score(),
    ]
    return _layout("medical", values, F.concat(body, strip(F.col("text"))))


def _position() -> Column:
    return F.col("position").cast("string")


def _source() -> Column:
    return F.coalesce("source", "filename", F.lit(rules.UNKNOWN_SOURCE))


def _section() -> Column:
    return _first(F.col("section"), F.lit(rules.NOT_AVAILABLE))


def _score() -> Column:
    # Unlike printf-style formatting on the JVM this rounds exact halves to even.
    return F.replace(F.format_number("score", 4), F.lit(","), F.lit(""))


BLOCKS: dict[str, Callable[[], Column]] = {
    "general": general_block,
    "financial": financial_block,
    "medical": medical_block,
}
OPTIONAL = {
    "source": "string", "filename": "string", "section": "string", "row_range": "string",
    "filing_date": "string", "publication_date": "string", "date": "string",
    "entities": "array<string>",
}


SOURCES = "array<struct<rank:int,document_id:string>>"


def context_blocks(kept: DataFrame) -> DataFrame:
    """Add ``block``: the chunk as its domain presents it, numbered by kept rank.

    ``kept``: ``query_id, domain, rank, chunk_type, text, score`` and any of the
    optional columns; missing ones count as absent values.
    """
    rows = mask_ids(kept)
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    block = F.lit(None).cast("string")
    for domain, build in BLOCKS.items():
        block = F.when(F.col("domain") == domain, build()).otherwise(block)
    return rows.withColumn("block", block)


def render_prompts(
    queries: DataFrame,
    kept: DataFrame,
    today: str,
    system_prompts: dict[str, str] | None = None,
) -> DataFrame:
    """One prompt per query; a query without kept chunks gets the fixed empty text.

    ``queries``: ``query_id, query, domain``. At most a handful of chunks per
    query survive reranking, so the ordered list per query is small.
    """
    prompts = rules.SYSTEM_PROMPTS | (system_prompts or {})
    ordered = F.sort_array(F.collect_list(F.struct("position", "block")))
    contexts = (
        context_blocks(kept)
        .groupBy("query_id")
        .agg(
            F.array_join(F.transform(ordered, lambda r: r["block"]), "\n").alias("context"),
            F.count(F.lit(1)).alias("n_blocks"),
        )
    )
    rows = queries.join(contexts, "query_id", "left").fillna(0, ["n_blocks"])

    def prompt(domain: str) -> Column:
        own = prompts.get(domain, prompts["general"])
        domain = domain if domain in rules.DOMAINS else "general"
        before, after = rules.CONTEXT_HEADING[domain].replace("{today}", today).split("{n}")
        note = (
            F.when(asks_diagnosis(F.col("query")), rules.NOTE_DIAGNOSIS).otherwise("")
            if domain == "medical"
            else F.lit(None).cast("string")
        )
        question = F.concat_ws("\n", strip(F.col("query")), note)
        # Only the medical frame keeps a line for the note, even when it is empty.
        gap = "\n" if domain == "medical" else "\n\n"
        return F.concat(
            F.lit(f"{own}\n\n---\n\n{before}"),
            F.col("n_blocks").cast("string"),
            F.lit(f"{after}\n\n"),
            F.coalesce("context", F.lit(rules.EMPTY_CONTEXT[domain])),
            F.lit(f"\n\n---\n\n{rules.QUERY_HEADING[domain]}\n\n"),
            question,
            F.lit(f"{gap}{rules.INSTRUCTION[domain]}\n"),
        )

    text = F.lit(None).cast("string")
    for domain in KNOWN:
        text = F.when(F.col("domain") == domain, prompt(domain)).otherwise(text)
    return rows.select("query_id", "domain", "n_blocks", text.alias("prompt"))


def fallback_answers(queries: DataFrame, kept: DataFrame) -> DataFrame:
    """The fixed answer for every query that kept no chunk; guards do not apply."""
    return queries.join(kept.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", F.lit(rules.NO_CONTEXT_ANSWER).alias("answer")
    )


def request_metadata(
    queries: DataFrame, budgeted: DataFrame, fused_totals: DataFrame
) -> DataFrame:
    """Counters, warnings and sources per request.

    ``queries``: ``query_id, domain, query_tokens, warnings``; ``budgeted``: the
    output of ``fit_budget`` with ``document_id``; ``fused_totals``: ``query_id,
    chunks_retrieved``.
    """
    first = Window.partitionBy("query_id", "document_id", "kept").orderBy("rank")
    used = F.sum(F.col("kept").cast("bigint"))
    source = F.when(F.col("kept") & (F.col("_n") == 1), F.struct("rank", "document_id"))
    facts = (
        budgeted.withColumn("_n", F.row_number().over(first))
        .groupBy("query_id")
        .agg(
            used.alias("chunks_used"),
            (F.count(F.lit(1)) - used).alias("chunks_dropped"),
            F.sort_array(F.collect_list(source)).alias("sources"),
        )
    )
    return (
        queries.join(facts, "query_id", "left")
        .join(fused_totals, "query_id", "left")
        .fillna(0, ["chunks_used", "chunks_dropped", "chunks_retrieved"])
        .withColumn("sources", F.coalesce("sources", F.expr("cast(array() as " + SOURCES + ")")))
    )
