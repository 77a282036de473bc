"""From raw documents to packed training sequences, one stage after another.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and, but
for the last, returns these columns for the documents it leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, near_duplicates, packing, quality, substrings
from docloom.llm.common import keep, table, without
from docloom.llm.queries import tokenizer
from docloom.operators.id_filters import unused
from docloom.session import scratch_path, ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that the factorisation machine rejects.

    Every row is scored by its own text; null and empty texts, null and repeated ids are
    scored like any other, and an empty table gives no rows.
    """
    ship_package(spark)
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, and the name of its column; written, so that numbers stay."""
    (name,) = unused(docs, "_row")
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one row of every class, that with the least id.

    Rows are told apart by a number, not by their ids: rows with one id and different
    texts stay, of repeated rows one does, null ids come last. Null texts and texts
    without words resemble nothing. An empty table gives no rows.
    """
    ship_package(spark)
    rows, row = _numbered(docs)
    classes = near_duplicates.near_duplicate_classes(rows, key=row)
    held = keep(classes.join(rows.select(row, F.col("doc_id").alias("_id")), row), "classes")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", F.col(row).alias("_best"))).alias("_first")
    several = held.groupBy("class_id").agg(first, F.count("*").alias("_size")).where("_size > 1")
    best = keep(several.select("class_id", "_first._best"), "best")
    dropped = held.join(best, "class_id").where(F.col(row) != F.col("_best")).select(row)
    return without(rows, keep(dropped, "dropped"), row).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated windows out of the texts; a document of which nothing is left goes."""
    ship_package(spark)
    others = tuple(c for c in docs.columns if c != "n_chars")
    cut = substrings.remove_repeats(docs, carried=others)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return (
        cut.where("n_removed = 0 or n_removed < n_words")
        .withColumn("text", text)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .select(docs.columns)
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out rows of whose words the benchmark holds one in twenty or more.

    Every row is judged by its own text, whatever its id; null and empty texts stay,
    and an empty benchmark or table changes nothing.
    """
    ship_package(spark)
    rows, row = _numbered(docs)
    hits = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), key=row)
    dropped = hits.where(decontamination.contaminated()).select(row)
    return without(rows, keep(dropped, "contaminated"), row).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left as pieces of sequences of at most 2,048 tokens.

    Null texts count as empty (their end id alone), repeated rows are packed each, and an
    empty table gives no rows.
    """
    ship_package(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and tokenizers have no SQL twin; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
