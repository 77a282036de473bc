"""Document files in, originals out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import rules
from docloom.operators.ordered import concat_ordered


def extension(name: Column) -> Column:
    """Lower-case file extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1))


def upload_problem(name: Column, size_bytes: Column, mime_type: Column | None = None) -> Column:
    """Why an upload is refused, or NULL."""
    ext = extension(name)
    reasons = F.when(
        ~ext.isin(*rules.ALLOWED_EXTENSIONS), F.concat(F.lit("Unsupported file type: "), ext)
    )
    if mime_type is not None:
        reasons = reasons.when(
            ~mime_type.isin(*rules.ALLOWED_MIME_TYPES),
            F.concat(F.lit("Unsupported file type: "), mime_type),
        )
    return reasons.when(size_bytes > rules.MAX_UPLOAD_BYTES, "File size exceeds limit of 50 MB.")


def scan_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files below ``path``.

    The reject side needs only names and lengths, so it never reads a file's
    content; on the accepted side the size rule is pushed into the scan.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .withColumn("problem", upload_problem(F.col("path"), F.col("length")))
    )
    accepted = (
        listing.where(F.col("length") <= rules.MAX_UPLOAD_BYTES)
        .where("problem is null")
        .select("path", "length", decode_text(F.col("content")).alias("content"))
    )
    rejected = listing.where("problem is not null").select("path", "length", "problem")
    return accepted, rejected


def decode_text(content: Column) -> Column:
    """UTF-8 text with bad bytes replaced; missing content is empty text."""
    return F.coalesce(F.make_valid_utf8(content.cast("string")), F.lit(""))


def join_pages(pages: DataFrame) -> DataFrame:
    """``document_id, page_no, text`` to one text per document, pages apart by a blank line."""
    return concat_ordered(pages, ["document_id"], "page_no", "text", "\n\n")


def archive_key(domain: Column, document_id: Column, filename: Column) -> Column:
    return F.concat_ws("/", domain, document_id, filename)


def archive_originals(documents: DataFrame, root: str) -> bool:
    """Write originals below ``root/domain=../document_id=..``; a failure is only reported."""
    try:
        documents.write.mode("append").partitionBy("domain", "document_id").parquet(root)
        return True
    except Exception as error:  # the main ingest must not fail with the archive
        print(f"archive skipped: {error}")
        return False
