"""Documents to chunks.

``chunk_documents`` keeps the whole chunking of a document inside its row and
explodes once at the end, so no shuffle happens before the chunk table exists.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions.arrays import built_once, let
from docloom.functions.domains import normalise_domain
from docloom.functions.ids import chunk_id, table_id
from docloom.operators import elements as E
from docloom.operators import entities as N
from docloom.operators import tables as B

SENTENCES: dict[str, Callable[[Column], Column]] = {
    "general": T.sentences_general,
    "financial": T.sentences_financial,
    "medical": N.sentences_medical,
}

def text_windows(
    text: Column, domain: str, max_chars: int | None = None, overlap: int = rules.CHUNK_OVERLAP
) -> Column:
    """Sentence windows of running text under the domain's size and boundary rules."""
    size = max_chars or rules.CHUNK_CHARS[domain]
    if size > rules.HARD_CAP_CHARS:
        raise ValueError(f"a window holds at most {rules.HARD_CAP_CHARS} characters")
    return T.windows(SENTENCES[domain](text), size, overlap)


def unit_chunks(
    unit: Column, position: Column, domain: str, cap_tables: bool = False
) -> Column:
    """The chunks of the unit at this position of its document, in order."""
    null = F.lit(None).cast("string")

    def chunk(kind: Column, text: Column, tid: Column = null, rows: Column = null) -> Column:
        return F.struct(
            kind.alias("chunk_type"),
            text.alias("text"),
            unit["section"].alias("section"),
            unit["section_raw"].alias("section_raw"),
            unit["page"].alias("page"),
            tid.alias("table_id"),
            rows.alias("row_range"),
        )

    kind, text = unit["kind"], unit["text"]
    plain = F.array(chunk(kind, T.strip(text)))
    flow = F.when(
        kind == "narrative",
        F.transform(text_windows(text, domain), lambda w: chunk(F.lit("narrative"), w)),
    ).when(
        kind == "header",
        F.transform(
            T.hard_cut(text, rules.HARD_CAP_CHARS, rules.CHUNK_OVERLAP),
            lambda w: chunk(F.lit("header"), w),
        ),
    )
    if domain == "financial":
        limit = rules.HARD_CAP_CHARS if cap_tables else rules.MAX_TABLE_CHARS

        def pieces(all_pieces: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                # Footnotes belong to the last piece of the table.
                noted = F.when(
                    i == F.size(all_pieces) - 1, F.concat(T.strip(p["text"]), unit["notes"])
                ).otherwise(T.strip(p["text"]))
                return chunk(F.lit("table"), noted, table_id(F.col("document_id"), position, text), p["row_range"])

            return F.transform(all_pieces, one)

        cut = let(B.split_table(text, limit), pieces)
        if cap_tables:
            cut = F.flatten(
                F.transform(
                    cut,
                    lambda c: F.transform(
                        text_windows(c["text"], "general", rules.HARD_CAP_CHARS),
                        lambda w: c.withField("text", w),
                    ),
                )
            )
        flow = flow.when(kind == "table", cut)
    if domain == "medical":
        medication = (unit["section"] == rules.SECTION_MEDICATIONS) | N.has_dose(text)
        flow = flow.when(
            kind == "list",
            F.array(
                chunk(
                    F.when(medication, F.lit("medication")).otherwise(F.lit("list")),
                    T.strip(text),
                )
            ),
        )
    return flow.otherwise(plain)


@built_once
def document_chunks(domain: str, cap_tables: bool = False, content: str = "content") -> Column:
    """All chunks of one document as an array; the position is the chunk index."""
    gathered = E.document_units(domain, content)
    return F.flatten(
        let(
            gathered,
            lambda us: F.transform(us, lambda u, i: unit_chunks(u, i, domain, cap_tables)),
        )
    )


def _explode_chunks(
    documents: DataFrame, array: Column, medical: Column, max_chunks: int | None
) -> DataFrame:
    """One row per chunk; a cap, if the caller gives one, is applied inside the row."""
    kept = array if max_chunks is None else F.slice(array, 1, F.lit(max_chunks))
    rows = documents.select(
        *[c for c in documents.columns if c != "content"],
        F.posexplode(kept).alias("chunk_index", "_chunk"),
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "_chunk"],
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        "_chunk.*",
    ).withColumnRenamed("page", "page_number")
    none = F.expr("cast(array() as array<string>)")
    found = F.when(F.col("chunk_type") != "header", N.extract_entities(F.col("text")))
    return rows.withColumn("entities", F.when(medical, F.coalesce(found, none)))


def chunk_domain(
    documents: DataFrame,
    domain: str,
    cap_tables: bool = False,
    max_chunks: int | None = None,
) -> DataFrame:
    """Chunk table of documents that all use one domain's chunker.

    In: ``document_id, content`` plus any further columns, which are kept. With
    ``max_chunks`` only the first chunks of a document are kept; by default all are.
    """
    array = document_chunks(domain, cap_tables)
    return _explode_chunks(documents, array, F.lit(domain == "medical"), max_chunks)


Chunker = Callable[[DataFrame, int | None], DataFrame]
CHUNKERS: dict[str, Chunker] = {}  # domains with a chunker of their own


def register_chunker(domain: str, chunker: Chunker) -> None:
    """Use ``chunker`` (documents and chunk cap in, chunk table out) for ``domain``."""
    CHUNKERS[domain] = chunker


def chunk_documents(documents: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """Chunk every document with the chunker of its ``domain``.

    The built-in chunkers run in one pass over the documents, chosen per row;
    only domains with a registered chunker are split off. A NULL or unknown domain
    is chunked as general text and named so.
    """
    built_in = [d for d in rules.DOMAINS if d not in CHUNKERS]
    documents = documents.withColumn("domain", normalise_domain(F.col("domain")))
    domain = F.col("domain")
    parts = []
    if built_in:
        choices = [F.when(domain == d, document_chunks(d)) for d in built_in]
        array = F.coalesce(*choices)
        mine = documents if not CHUNKERS else documents.where(domain.isin(built_in))
        medical = F.lit("medical" in built_in) & (domain == "medical")
        parts.append(_explode_chunks(mine, array, medical, max_chunks))
    parts += [
        chunker(documents.where(domain == name), max_chunks)
        for name, chunker in CHUNKERS.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cap_chunks(chunks: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` chunks of every document, over a stored chunk table.

    The rank filter becomes a per-task group limit before the shuffle, so a
    document with very many chunks sends at most ``limit`` rows per task.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return (
        chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    )


def ingestion_summary(chunks: DataFrame, upserted: str = "upserted") -> DataFrame:
    """Chunks, written and failed counts per document; ``upserted`` is a boolean column."""
    return chunks.groupBy("document_id", "domain").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum(F.col(upserted).cast("bigint")).alias("upserted"),
        (F.count(F.lit(1)) - F.sum(F.col(upserted).cast("bigint"))).alias("failed"),
    )


def chunk_payload(chunks: DataFrame) -> DataFrame:
    """Payload columns: values of the ``extra`` map win over the chunk's own columns."""
    extra = lambda key: F.try_element_at(F.col("extra"), F.lit(key))
    chunk_index = F.coalesce(extra("chunk_index").cast("int"), F.col("chunk_index"), F.lit(0))
    document = F.coalesce(extra("document_id"), F.col("document_id"), F.lit(""))
    own_id = F.coalesce(extra("chunk_id"), F.col("chunk_id"))
    return chunks.select(
        F.coalesce(F.when(own_id != "", own_id), F.concat_ws(":", document, chunk_index)).alias(
            "chunk_id"
        ),
        document.alias("document_id"),
        chunk_index.alias("chunk_index"),
        F.coalesce(extra("chunk_type"), F.col("chunk_type"), F.lit("narrative")).alias(
            "chunk_type"
        ),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(extra("section"), F.col("section")).alias("section"),
        F.coalesce(extra("source"), F.col("source")).alias("source"),
        F.coalesce(extra("domain"), F.col("domain"), F.lit("general")).alias("domain"),
        F.coalesce(extra("acl"), F.col("acl"), F.lit("public")).alias("acl"),
    )
