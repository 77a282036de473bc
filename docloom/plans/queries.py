"""The registered queries: each applies one operator to whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import domains as D
from docloom.functions import guards as G
from docloom.functions import ids, vectors
from docloom.functions import text as T
from docloom.operators import access, budget, cells, chunking, elements, encoding, entities
from docloom.operators import guarding, id_filters, lexical, registry, render, retrieval, tables
from docloom.plans import derive
from docloom.session import materialise, scratch_path, small_batches, spread
from docloom.sources import collections as store
from docloom.sources import events, files
from docloom.streaming import ingest, status, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WIDTH = rules.VECTOR_WIDTH["general"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str, sep: str = "|"):
    return F.array_join(F.col(column), sep)


# --- sources and sinks ---------------------------------------------------------


@query
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.table(spark, sf, "documents")
    kind = (
        F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".HTML")
        .when(F.col("lang") == "de", ".exe").otherwise("")
    )
    named = docs.select(
        "doc_id",
        F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), kind).alias("name"),
        (F.col("n_chars") * 2000).alias("size_bytes"),
        F.when(F.col("lang") == "fr", "text/html").otherwise("application/pdf").alias("mime"),
    )
    return named.select(
        "doc_id",
        files.extension(F.col("name")).alias("ext"),
        files.upload_problem(F.col("name"), F.col("size_bytes"), F.col("mime")).alias("problem"),
    )


@query
def join_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = derive.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("page_no"), "text"
    )
    return files.join_pages(pages)


@query
def elements_from_json(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(derive.table(spark, sf, "documents"))
    kinds = ["Title", "NarrativeText", "ListItem", "Footer", "Table", "Unheard"]
    parts = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.element_at(F.array(*[F.lit(k) for k in kinds]), i % 6 + 1).alias("type"),
            line.alias("text"),
            F.struct((i + 1).alias("page_number")).alias("metadata"),
        ),
    )
    content = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("["), F.col("text")))
        .when(F.col("lang") == "de", F.col("text"))
        .otherwise(F.concat(F.lit(" \n"), F.to_json(parts)))
    )
    found = docs.select("doc_id", elements.elements(content, "financial").alias("e"))
    return found.select("doc_id", F.posexplode("e").alias("pos", "e")).select(
        "doc_id", "pos", "e.kind", "e.text", F.col("e.page").alias("page_number")
    )


@query
def html_tables_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    for old, new in (
        ("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><th>link</th><td>"),
        ("</li>", "</td></tr>"), ("<p>", "<TR><td class='x'>"), ("</p>", "</td></TR>"),
    ):
        html = F.replace(html, F.lit(old), F.lit(new))
    pages = spread(derive.table(spark, sf, "pages"))
    rows = pages.select("page_id", F.posexplode(tables.html_rows(html)).alias("row_no", "cells"))
    return rows.select(
        "page_id", "row_no", F.size("cells").alias("n_cells"),
        tables.render_row(F.col("cells")).alias("row_text"),
    )


@query
def route_collections(spark: SparkSession, sf: str) -> DataFrame:
    return store.route_collections(derive.raw_documents(spark, sf)).select(
        "document_id", "domain", "collection"
    )


@query
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Through a store: all documents are loaded, then labelled ones replaced, in two versions at once."""
    whole = ["chunk_id", "document_id", "domain"]
    docs = derive.raw_documents(spark, sf).select(
        "doc_id", ids.chunk_id(F.col("document_id"), F.lit(0)).alias("chunk_id"), "document_id", "domain", "content"
    )
    labels = derive.table(spark, sf, "labels")
    first = docs.select(*whole, F.lit(0).alias("seq"), F.md5("content").alias("content_md5"))
    changed = docs.join(labels, "doc_id").select(
        *whole, F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "content"
    )
    incoming = changed.select(
        *whole, "seq",
        F.md5(F.concat("content", F.lit("!"), F.col("seq").cast("string"))).alias("content_md5"),
    )
    chunks = store.ChunkStore(spark, scratch_path(spark, "collections"), buckets=8)
    chunks.append(first)
    chunks.upsert(incoming)
    return chunks.read().select("chunk_id", "seq", "content_md5")


@query
def delete_document(spark: SparkSession, sf: str) -> DataFrame:
    chunks = derive.raw_documents(spark, sf).select("doc_id", "document_id", "domain")
    doomed = derive.table(spark, sf, "labels").where("toxic = 1")
    named = doomed.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"))
    held = store.ChunkStore(spark, scratch_path(spark, "collections"), buckets=8)
    held.append(chunks.withColumn("chunk_id", ids.chunk_id(F.col("document_id"), F.lit(0))))
    held.delete(named)
    return held.read().select("doc_id", "document_id", "domain")


@query
def wipe_collections(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.raw_documents(spark, sf).select("document_id", "domain")
    return store.wipe_collections(docs, ("financial", "medical"))


@query
def archive_layout(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.raw_documents(spark, sf)
    name = F.concat("source", F.lit(".txt"))
    return docs.select(
        "document_id", files.archive_key(F.col("domain"), F.col("document_id"), name).alias("key")
    )


@query
def latest_task_status(spark: SparkSession, sf: str) -> DataFrame:
    log = derive.status_events(spark, sf).withColumnRenamed("document_id", "task_id")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return store.latest_task_status(log, now).select("task_id", "seq", "status", "chunk_count")


@query
def decode_stream_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.decode_stream_events(derive.stream_bodies(spark, sf))


@query
def encode_stream_events(spark: SparkSession, sf: str) -> DataFrame:
    talk = derive.table(spark, sf, "conversations")
    request = F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("request_id")
    meta = talk.groupBy(request).agg(
        F.count(F.lit(1)).alias("chunks_used"), F.max("turn").alias("chunks_dropped")
    )
    tokens = talk.select(request, F.col("turn").alias("seq"), F.col("role").alias("content"))
    return events.encode_stream_events(meta, tokens)


# --- projections, filters, predicates --------------------------------------------


def _raw_domains(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    raw = (
        F.when(segment == "HOUSEHOLD", " Medical \t").when(segment == "MACHINERY", "legal")
        .when(segment == "AUTOMOBILE", "FINANCIAL").when(segment == "BUILDING", "general")
    )
    header = F.when(F.col("c_acctbal") > 5000, "medical").when(F.col("c_acctbal") > 2000, "")
    return derive.table(spark, sf, "customer").select(
        "c_custkey", raw.alias("raw_domain"), header.alias("header")
    )


@query
def normalise_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_domains(spark, sf).select(
        "c_custkey", D.normalise_domain(F.col("raw_domain")).alias("domain")
    )


@query
def validate_domain(spark: SparkSession, sf: str) -> DataFrame:
    accepted, rejected = access.split_domains(_raw_domains(spark, sf))
    return accepted.select("c_custkey", "domain", F.lit(True).alias("accepted")).unionByName(
        rejected.select(
            "c_custkey", F.lit(None).cast("string").alias("domain"), F.lit(False).alias("accepted")
        )
    )


@query
def resolve_domain(spark: SparkSession, sf: str) -> DataFrame:
    form = F.coalesce(F.lower(T.strip(F.col("raw_domain"))), F.lit("general"))
    return _raw_domains(spark, sf).select(
        "c_custkey",
        D.ingest_domain(form, F.col("header")).alias("ingest_domain"),
        D.query_domain(F.col("header"), form).alias("query_domain"),
    )


@query
def filtered_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.filtered_candidates(
        derive.searchable_documents(spark, sf).drop("text"), derive.benchmark_queries(spark, sf)
    )


@query
def authorised_requests(spark: SparkSession, sf: str) -> DataFrame:
    asked = derive.registry(spark, sf).select("document_id", "user_id", "domain")
    return access.authorised_requests(asked, derive.users(spark, sf), ("admin", "user"))


def _line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence-like piece of every document as a chunk."""
    return derive.raw_documents(spark, sf).select(
        "document_id", "domain", F.posexplode(F.split("content", r"[.\n] ?")).alias("chunk_index", "text")
    )


@query
def cap_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.cap_chunks(_line_chunks(spark, sf), 100).select("document_id", "chunk_index", "text")


@query
def chunk_payload(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.raw_documents(spark, sf)
    extra = F.when(
        F.col("domain") == "financial",
        F.create_map(
            F.lit("source"), F.concat(F.lit("meta-"), F.col("source")), F.lit("acl"), F.lit("internal"),
            F.lit("chunk_type"), F.lit("table"),
        ),
    )
    rows = docs.select(
        F.when(F.col("domain") != "medical", ids.chunk_id(F.col("document_id"), F.lit(0))).alias("chunk_id"),
        "document_id", F.col("doc_id").cast("int").alias("chunk_index"),
        F.lit(None).cast("string").alias("chunk_type"), F.col("content").alias("text"),
        F.lit(None).cast("string").alias("section"), "source", "domain",
        F.lit(None).cast("string").alias("acl"), extra.alias("extra"),
    )
    return chunking.chunk_payload(rows)


@query
def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    return registry.list_documents(derive.registry(spark, sf), limit=5, skip=2).select(
        "user_id", "position", "document_id", "status", "total"
    )


@query
def mask_ids(spark: SparkSession, sf: str) -> DataFrame:
    hits = _dense_hits(spark, sf).withColumn("document_id", F.col("chunk_id"))
    return render.mask_ids(hits).select("query_id", "rank", "document_id", "position")


@query
def document_status(spark: SparkSession, sf: str) -> DataFrame:
    return registry.document_status(derive.registry(spark, sf)).drop("updated_at")


@query
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "es", "  ").otherwise(F.col("text")).alias("query"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"),
        F.split("text", "\n").alias("pinned"),
        (F.col("n_chars") % 130).cast("int").alias("limit"),
        (F.col("n_chars") % 7 - 2).cast("int").alias("skip"),
    )
    checked = access.validate_rows(docs)
    return checked.select("doc_id", F.inline("violations"))


# --- chunking -----------------------------------------------------------------------


@query
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return derive.structured_documents(spark, sf).select(
        "doc_id", F.posexplode(T.paragraphs(F.col("content"))).alias("pos", "text")
    )


def _classified(spark: SparkSession, sf: str, domain: str) -> DataFrame:
    return (
        derive.structured_documents(spark, sf)
        .select("doc_id", F.posexplode(elements.document_elements(domain)).alias("pos", "e"))
        .select("doc_id", "pos", "e.kind", "e.text")
    )


@query
def classify_general(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf, "general")


@query
def classify_financial(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf, "financial")


@query
def classify_medical(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf, "medical")


@query
def clinical_section(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.structured_documents(spark, sf)
    paras = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("content"))).alias("pos", "text"))
    return paras.select("doc_id", "pos", elements.clinical_section(F.col("text")).alias("section"))


def _units(spark: SparkSession, sf: str, domain: str) -> DataFrame:
    return (
        derive.structured_documents(spark, sf)
        .select("doc_id", F.posexplode(elements.document_units(domain)).alias("unit_no", "u"))
        .select("doc_id", "unit_no", "u.*")
    )


@query
def carry_section(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf, "medical").select("doc_id", "unit_no", "kind", "section", "section_raw")


@query
def flush_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf, "general").select("doc_id", "unit_no", "kind", "text", "section")


def _sentences(spark: SparkSession, sf: str, domain: str) -> DataFrame:
    return derive.structured_documents(spark, sf).select(
        "doc_id", F.posexplode(chunking.SENTENCES[domain](F.col("content"))).alias("pos", "sentence")
    )


@query
def sentences_general(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf, "general")


@query
def sentences_financial(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf, "financial")


@query
def sentences_medical(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf, "medical")


@query
def sentences_around_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Span-safe sentences with a pattern whose matches hold sentence boundaries."""
    sentences = entities.sentences_medical(F.col("content"), [derive.HELD_BOUNDARY])
    return derive.structured_documents(spark, sf).select(
        "doc_id", F.posexplode(sentences).alias("pos", "sentence")
    )


@query
def window_pack(spark: SparkSession, sf: str) -> DataFrame:
    packed = chunking.text_windows(F.col("content"), "general")
    return derive.raw_documents(spark, sf).select(
        "doc_id", F.posexplode(packed).alias("window_no", "text")
    )


@query
def hard_cut(spark: SparkSession, sf: str) -> DataFrame:
    cut = T.hard_cut(F.col("content"), 512, 32)
    return derive.raw_documents(spark, sf).select("doc_id", F.posexplode(cut).alias("pos", "slice"))


def _order_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One pipe table per supplier with a row per line item, joined in blocks."""
    from docloom.operators.ordered import concat_ordered

    items = derive.table(spark, sf, "lineitem").select(
        "l_suppkey",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
        F.concat_ws(
            " ", F.lit("|"), F.col("l_orderkey"), F.lit("|"), F.col("l_linenumber"), F.lit("|"),
            F.col("l_returnflag"), F.lit("|"), F.col("l_quantity").cast("int"), F.lit("|"),
        ).alias("text"),
    )
    body = concat_ordered(items, ["l_suppkey"], "at", "text", "\n")
    head = F.lit("| order | line | flag | quantity |\n| --- | ---: | :---: | --- |\n")
    return body.select("l_suppkey", F.concat(head, F.col("text")).alias("text"))


@query
def parse_pipe_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = _order_tables(spark, sf).select(
        "l_suppkey", F.posexplode(tables.pipe_rows(F.col("text"))).alias("row_no", "cells")
    )
    return rows.select("l_suppkey", "row_no", joined("cells").alias("cells"))


@query
def split_tables(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _order_tables(spark, sf)
        .select("l_suppkey", F.posexplode(tables.split_table(F.col("text"))).alias("piece_no", "p"))
        .select("l_suppkey", "piece_no", "p.text", "p.row_range")
    )


@query
def table_ids(spark: SparkSession, sf: str) -> DataFrame:
    return derive.structured_documents(spark, sf).select(
        "doc_id", ids.table_id(F.col("document_id"), F.lit(0), F.col("content")).alias("table_id")
    )


@query
def attach_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf, "financial").select(
        "doc_id", "unit_no", "kind", "text", "notes", "section"
    )


@query
def medication_items(spark: SparkSession, sf: str) -> DataFrame:
    return (
        chunking.chunk_domain(derive.structured_documents(spark, sf), "medical")
        .where(F.col("chunk_type").isin("medication", "list"))
        .select("doc_id", "chunk_type", "section", "text")
    )


@query
def extract_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.extract_entities(F.col("content"))
    return derive.structured_documents(spark, sf).select(
        "doc_id", F.posexplode(found).alias("pos", "entity")
    )


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as intervals per order: start from the part, length from the quantity."""
    return derive.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("document_id"),
        (F.col("l_partkey") * 40 + F.col("l_linenumber")).alias("start"),
        (F.col("l_partkey") * 40 + F.col("l_linenumber") + F.col("l_quantity").cast("bigint")).alias("end"),
    )


@query
def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    return entities.merge_spans(_spans(spark, sf), block_chars=4096).select(
        "document_id", "start", F.col("end").alias("stop")
    )


@query
def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.chunk_domain(derive.structured_documents(spark, sf), "general")
    return chunks.select("doc_id", "chunk_index", "chunk_type", "section", "text")


@query
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _line_chunks(spark, sf).select(
        "document_id", "chunk_index",
        ids.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
    )


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.chunk_documents(derive.structured_documents(spark, sf))
    return chunks.select(
        "domain", "document_id", "chunk_index", "chunk_id", "chunk_type", "section",
        "section_raw", "table_id", "row_range", joined("entities").alias("entities"), "text",
    )


@query
def ingestion_summary(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _line_chunks(spark, sf).withColumn("upserted", F.length("text") > 20)
    return chunking.ingestion_summary(chunks)


# --- encoding --------------------------------------------------------------------------


@query
def encode_dense(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    docs = derive.raw_documents(spark, sf)
    vector = docs.select("doc_id", vectors.encode_dense(F.col("content"), "general").alias("v"))
    return (
        # The outer form keeps the optimizer from evaluating the encoder in a filter too.
        vector.select("doc_id", F.posexplode_outer("v").alias("bucket", "x"))
        .where("x <> 0")
        .select("doc_id", "bucket", F.round(F.col("x").cast("double"), 6).alias("value"))
    )


@query
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x, i: x * (i + 1))
    return (
        derive.table(spark, sf, "embeddings")
        .select("vec_id", F.posexplode(vectors.l2_normalise(scaled)).alias("i", "x"))
        .select("vec_id", "i", F.round("x", 6).alias("x"))
    )


@query
def encode_sparse(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.raw_documents(spark, sf)
    return encoding.encode_sparse(docs, "doc_id", "content").select(
        "doc_id", "token", F.round("weight", 6).alias("weight")
    )


@query
def sparse_pool(spark: SparkSession, sf: str) -> DataFrame:
    logits = derive.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("token"),
        (F.col("l_quantity") - 25).alias("logit"),
    )
    return encoding.sparse_pool(logits).select(
        "document_id", "token", F.round("weight", 6).alias("weight")
    )


@query
def quantise_int8(spark: SparkSession, sf: str) -> DataFrame:
    coded = encoding.quantise_int8(derive.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return coded.select("vec_id", "clip", F.posexplode("quantised").alias("i", "q")).select(
        "vec_id", "clip", "i", F.col("q").cast("int").alias("q")
    )


# --- retrieval ----------------------------------------------------------------------------


def _dense_hits(spark: SparkSession, sf: str) -> DataFrame:
    coded = lambda rows, text: rows.withColumn(
        "dense", vectors.encode_dense(F.col(text), "general")
    ).drop(text)
    docs = derive.searchable_documents(spark, sf, lambda rows: coded(rows, "text"))
    return retrieval.dense_topk(docs, coded(derive.benchmark_queries(spark, sf), "query"))


def _sparse_hits(spark: SparkSession, sf: str) -> DataFrame:
    coded = lambda rows, text: rows.withColumn(
        "terms", vectors.term_weights(F.col(text))
    ).drop(text)
    docs = derive.searchable_documents(spark, sf, lambda rows: coded(rows, "text"))
    return retrieval.sparse_topk(docs, coded(derive.benchmark_queries(spark, sf), "query"))


def _both_hits(spark: SparkSession, sf: str) -> DataFrame:
    coded = lambda rows: encoding.add_vectors(rows, "general").drop("text")
    docs = derive.searchable_documents(spark, sf, coded)
    asked = derive.benchmark_queries(spark, sf)
    return retrieval.hybrid_hits(docs, retrieval.with_vectors(asked, "general"))


def _with_text(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    """Hits with their chunk's columns; only texts of chunks that were hit leave the scan.

    ``hits`` are written rows: at most 40 per query.
    """
    held = id_filters.id_filter(hits, "chunk_id")
    docs = derive.searchable_documents(
        spark, sf, lambda rows: id_filters.passing(rows, held, "chunk_id")
    )
    return hits.drop("document_id").join(docs, "chunk_id")


@query
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense_hits(spark, sf).select("query_id", "chunk_id", "score", "rank")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return derive.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense")
    )


@query
def dense_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(_vectors(spark, sf))
    asked = _vectors(spark, sf).withColumnRenamed("chunk_id", "query_id")
    return retrieval.dense_topk(rows, asked, 10).select("query_id", "chunk_id", "score", "rank")


@query
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(_vectors(spark, sf))
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    centres = cells.fit_cells(cells.sample_vectors(rows, 64))
    return cells.ann_topk(rows, asked, centres, 10).select("query_id", "chunk_id", "score", "rank")


@query
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the approximate search against the exact one, for ids that 20 divides."""
    rows = _vectors(spark, sf)
    asked = rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    centres = cells.fit_cells(cells.sample_vectors(rows, 64))
    exact = retrieval.dense_topk(spread(rows), asked, 10)
    return cells.cell_recall(exact, cells.ann_topk(rows, asked, centres, 10), 10)


@query
def sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse_hits(spark, sf).select("query_id", "chunk_id", "score", "rank")


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 with the statistics of two parts of the collection put together."""
    chunks = derive.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    english = F.col("lang").eqNullSafe("en")
    parts = (chunks.where(english), chunks.where(~english))
    held = lexical.merge_statistics(*(lexical.term_statistics(p) for p in parts))
    asked = derive.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = lexical.bm25_topk(chunks, asked, materialise(held, "statistics"))
    return found.select("query_id", "chunk_id", "score", "rank")


@query
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf_fuse(_both_hits(spark, sf)).select("query_id", "chunk_id", "score", "rank")


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    fused = materialise(retrieval.rrf_fuse(_both_hits(spark, sf)), "fused")
    asked = derive.benchmark_queries(spark, sf).select("query_id", "query")
    rows = _with_text(spark, sf, fused.drop("score", "stage"))
    return retrieval.rerank_topk(rows.join(asked, "query_id"))


@query
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("query_id", "chunk_id", "score", "rank")


@query
def near_dup_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.raw_documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.col("content").alias("text")
    )
    coded = docs.withColumn("dense", vectors.encode_dense(F.col("text"), "general")).drop("text")
    return retrieval.near_dup_within(coded, 0.95)


@query
def admin_documents(spark: SparkSession, sf: str) -> DataFrame:
    page = registry.admin_documents(
        derive.registry(spark, sf), derive.users(spark, sf), status="failed", limit=500, skip=10
    )
    return page.select("document_id", "user_id", "email", "name", "domain")


@query
def session_domain_check(spark: SparkSession, sf: str) -> DataFrame:
    asked = derive.messages(spark, sf).select(
        F.when(F.col("role") == "system", F.lit("unknown")).otherwise(F.col("session_id")).alias("session_id"),
        F.concat(F.lit("u"), (F.col("turn") + 3).cast("string")).alias("user_id"),
        "turn",
        F.when(F.length("content") % 2 == 0, "financial").otherwise("general").alias("domain"),
    )
    return registry.session_domain_check(asked, derive.sessions(spark, sf))


@query
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.raw_documents(spark, sf)
    cut = lambda df: chunking.chunk_domain(
        df.select("document_id", "content"), "general"
    )
    coded = encoding.add_vectors(cut(docs), "general")
    asked = guarding.sanitise_queries(
        derive.table(spark, sf, "benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("query"),
            F.lit("general").alias("domain"),
        )
    ).drop("domain")
    # Only the documents that were hit are cut again to fetch their text.
    found = retrieval.hybrid_search(
        coded,
        retrieval.with_vectors(asked, "general"),
        lambda hit: cut(docs.join(hit, "document_id", "left_semi")).select(
            "chunk_id", "document_id", "text"
        ),
    )
    counted = budget.with_token_counts(found, F.lit(rules.SYSTEM_PROMPTS["general"]))
    return budget.fit_budget(counted, n_ctx=1800).select(
        "query_id", "rank", "chunk_id", "document_id", "score", "chunk_tokens", "kept"
    )


@query
def cross_domain_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every domain's chunks with its own encoder; a query searches one domain or all."""
    docs = derive.raw_documents(spark, sf).select("document_id", "domain", "content")
    chunks = encoding.add_vectors_by_domain(chunking.chunk_documents(docs))
    shape = F.col("item_id") % 4
    asked = derive.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.when(shape == 0, "financial")
        .when(shape == 1, "medical")
        .when(shape == 2, "general")
        .alias("domain"),
    )
    found = retrieval.hybrid_hits(chunks, retrieval.with_vectors_by_domain(asked))
    return retrieval.rrf_fuse(found).select("query_id", "chunk_id", "score", "rank")


# --- aggregations and window-style operators ---------------------------------------------


@query
def stage_totals(spark: SparkSession, sf: str) -> DataFrame:
    hits = materialise(_both_hits(spark, sf), "hits")
    fused = retrieval.rrf_fuse(hits).select("query_id", "chunk_id", "stage")
    return retrieval.stage_totals(hits.select("query_id", "chunk_id", "stage").unionByName(fused))


def _fit(spark: SparkSession, sf: str, fused: DataFrame | None = None) -> DataFrame:
    """Fused hits as ranked chunks under a small budget."""
    fused = fused or materialise(retrieval.rrf_fuse(_both_hits(spark, sf)), "fused")
    asked = derive.benchmark_queries(spark, sf).select("query_id", "query")
    rows = _with_text(spark, sf, fused).drop("domain", "doc_id").join(asked, "query_id")
    counted = budget.with_token_counts(rows, F.lit(rules.SYSTEM_PROMPTS["general"]))
    return budget.fit_budget(counted, n_ctx=4096)


@query
def build_sources(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.build_sources(_fit(spark, sf).where("kept")).select(
        "query_id", "source_no", "document_id", "chunk_id", "rank", "score"
    )


@query
def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return budget.estimate_tokens(_fit(spark, sf))


@query
def assemble_answers(spark: SparkSession, sf: str) -> DataFrame:
    return guarding.assemble_answers(events.decode_stream_events(derive.stream_bodies(spark, sf)))


@query
def request_metadata(spark: SparkSession, sf: str) -> DataFrame:
    asked = guarding.sanitise_queries(
        derive.benchmark_queries(spark, sf).select(
            "query_id", "query", D.normalise_domain(F.col("domain")).alias("domain")
        )
    ).withColumn("query_tokens", T.count_tokens(F.col("query")))
    fused = materialise(retrieval.rrf_fuse(_both_hits(spark, sf)), "fused")
    totals = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_retrieved"))
    meta = render.request_metadata(asked, _fit(spark, sf, fused), totals)
    names = F.transform("sources", lambda s: s["document_id"])
    return meta.select(
        "query_id", "domain", "query_tokens", "chunks_retrieved", "chunks_used", "chunks_dropped",
        joined("warnings").alias("warnings"), F.array_join(names, "|").alias("sources"),
    )


@query
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(spark, sf).select(
        "query_id", "rank", "chunk_id", "kept", "tokens_chunks", "tokens_total",
        "budget_tokens", "truncated", "utilisation",
    )


@query
def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return derive.raw_documents(spark, sf).select(
        "doc_id", T.count_tokens(F.col("content")).alias("n_tokens")
    )


@query
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    return registry.history_window(derive.messages(spark, sf), 5).select("session_id", "turn", "role")


@query
def message_page(spark: SparkSession, sf: str) -> DataFrame:
    talk = derive.messages(spark, sf)
    cursors = talk.groupBy("session_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("before")
    )
    return registry.message_page(talk, cursors, 3).select("session_id", "turn", "role", "has_more")


@query
def list_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return registry.list_sessions(derive.sessions(spark, sf), limit=5, skip=1).select(
        "user_id", "position", "session_id", "domain", "title"
    )


@query
def update_sessions(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("role") == "user"
    updates = (
        derive.table(spark, sf, "conversations")
        .join(
            derive.sessions(spark, sf).select(
                F.substr("session_id", F.lit(2)).cast("bigint").alias("conv_id"), "session_id", "user_id"
            ),
            "conv_id",
        )
        .select(
            "session_id",
            F.when(F.col("conv_id") % 4 == 3, "stranger").otherwise(F.col("user_id")).alias("user_id"),
            F.col("turn").alias("seq"),
            F.when(user, F.col("text")).alias("title"),
            F.when(F.col("role") == "assistant", F.length("text") % 2 == 0).alias("is_archived"),
            F.lit(None).cast("array<string>").alias("pinned"),
            ((F.col("turn") == 7) & user).alias("deleted"),
        )
    )
    return registry.update_sessions(derive.sessions(spark, sf), updates).select(
        "session_id", "user_id", "title", "is_archived"
    )


# --- text rules, guards, rendering ----------------------------------------------------------


@query
def sanitise_queries(spark: SparkSession, sf: str) -> DataFrame:
    asked = derive.raw_documents(spark, sf).select("doc_id", F.col("content").alias("query"), "domain")
    return guarding.sanitise_queries(asked).select(
        "doc_id", "query", joined("warnings").alias("warnings")
    )


@query
def diagnosis_flag(spark: SparkSession, sf: str) -> DataFrame:
    asked = derive.raw_documents(spark, sf).select(
        "doc_id", "domain",
        F.when(F.col("source").isin("src1", "src2", "src3"), F.concat("content", F.lit(" Should I take it?")))
        .otherwise(F.col("content")).alias("query"),
    )
    _, warned = G.flag_diagnosis(F.col("query"), F.col("domain"))
    return asked.select("doc_id", (F.size(warned) > 0).alias("flagged"))


@query
def guard_responses(spark: SparkSession, sf: str) -> DataFrame:
    return guarding.guard_responses(derive.responses(spark, sf)).select(
        "response_id", "domain", "guarded"
    )


@query
def guard_token_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = events.decode_stream_events(derive.stream_bodies(spark, sf))
    domains = derive.responses(spark, sf).select(F.col("response_id").alias("request_id"), "domain")
    return guarding.guard_token_stream(rows, domains)


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    month = F.concat(F.lit("2024-0"), (F.col("doc_id") % 9 + 1).cast("string"))
    return _reranked(spark, sf).withColumn("date", F.when(F.col("acl") == "public", month))


@query
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return render.context_blocks(_kept(spark, sf)).select("query_id", "position", "block")


@query
def render_prompts(spark: SparkSession, sf: str) -> DataFrame:
    asked = derive.benchmark_queries(spark, sf).select(
        "query_id", "query",
        F.when(F.col("query_id") % 3 == 0, "financial").when(F.col("query_id") % 3 == 1, "medical")
        .otherwise("general").alias("domain"),
    )
    return render.render_prompts(asked, _kept(spark, sf), "2024-01-31")


@query
def fallback_answers(spark: SparkSession, sf: str) -> DataFrame:
    asked = derive.benchmark_queries(spark, sf).select("query_id")
    return render.fallback_answers(asked, _reranked(spark, sf).where(F.col("score") >= 0.6))


# --- streams and status -----------------------------------------------------------------------


@query
def status_machine(spark: SparkSession, sf: str) -> DataFrame:
    known = derive.table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("document_id")
    )
    return status.status_machine(known, derive.status_events(spark, sf))


@query
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return access.rate_limit(derive.requests(spark, sf), 86400, 5).select(
        "request_id", "caller", "n_in_window", "limited", "retry_after"
    )


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files.

    A plain path must be a folder and a file filter only sees the names of files; a pattern finds both.
    """
    schema = derive.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")


@query
def dedup_events(spark: SparkSession, sf: str) -> DataFrame:
    log = _stream(spark, sf, "events")
    twice = log.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    out, state = scratch_path(spark, "dedup"), scratch_path(spark, "state")
    running = (
        windows.dedup_events(twice)
        .select("event_id", "user_id", "event_type")
        .writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    running.awaitTermination()
    return spark.read.parquet(out)


def _drained(spark: SparkSession, running, label: str, mode: str = "append") -> str:
    """Run a stream over all that is there and return where its rows are."""
    out = scratch_path(spark, label)
    writer = running.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "state"))
    # By the batch's number: one that is delivered again replaces its own rows.
    keep = lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
    writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return out


#: Stateful processors in Python keep their state in RocksDB.
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query
def stream_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The token streams of all conversations, closed by ``done`` and guarded."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    bodies = derive.stream_bodies(spark, sf, _stream(spark, sf, "conversations"))
    domains = derive.table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id"), F.col("turn")).alias("request_id"),
        F.when(F.col("conv_id") % 3 == 0, "financial")
        .when(F.col("conv_id") % 3 == 1, "medical")
        .otherwise("general")
        .alias("domain"),
    )
    guarded = windows.stream_guarded_answers(events.decode_stream_events(bodies), domains)
    return spark.read.parquet(_drained(spark, guarded, "answers")).drop("batch")


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    docs = _stream(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        derive.domain_of_lang(F.col("lang")).alias("domain"),
        F.lit(1).alias("seq"),
        F.col("text").alias("content"),
    )
    chunks = store.ChunkStore(spark, scratch_path(spark, "collections"), buckets=4)
    ingest.start_ingest(docs, chunks, scratch_path(spark, "state"), "seq").awaitTermination()
    return chunks.read().select("domain", "document_id", "chunk_index", "chunk_id", "chunk_type")


@query
def semantic_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Labels age the cached vectors; every vector is also a question."""
    cache = derive.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("label") * 600).alias("created_at"),
    )
    asked = _vectors(spark, sf).withColumnRenamed("chunk_id", "query_id")
    now = F.lit("2024-01-01 01:30:00").cast("timestamp")
    return retrieval.semantic_cache_lookup(cache, asked, now)
